"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, built by cyclic boosting: round after round, feature after feature, a
shallow tree on one feature is fitted to what is left and added to its table.  The pairs of features that explain most
of the rest get tables of their own in the same way.  A score is the sum of one entry of each table: vectorised bin
additions.

Features come from one scan of the whole texts, in whole-array steps, into a narrow table.  Training reads at most
``max_rows`` labelled rows, those with the smallest hash of their id, on the driver; that bound is a parameter.  All
rows are scored.  Labels, language, source and id are never inputs of a score.

Defined results: a null text counts as empty; empty texts are scored like any other.  Without labelled rows, or with
one class only, the score is the smoothed share of the class.  Null labels and ids are not learned from.  Repeated rows
are scored one by one.  Other columns are neither read nor returned by ``score_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidframe.llm.hashing import mix, run_hashes
from lucidframe.llm.text import bounded_batches, narrow, slices, table
from lucidframe.session import materialize

FEATURES = ("words", "word_bytes", "upper", "digits", "symbols", "marks", "stops", "non_ascii", "distinct_words", "same_neighbours", "distinct_triples", "line_words", "top_word", "capital_words", "hung_words")
#: Labelled rows that training reads at most.
MAX_ROWS = 20_000

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 symbol, 5 !?, 6 stop or comma, 7 non-ASCII, 8 line end, 9 space
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A] = 1, 2, 3
_KIND[[ord(c) for c in "#*$%&|<>"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in ".,;:"]] = 6
_KIND[0x80:] = 7
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 9
_KIND[0x0A] = 8


def text_features(texts: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES for each text."""
    raw = b"\n".join(t or b"" for t in texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    kind = _KIND[data]
    stops = np.cumsum([len(t or b"") + 1 for t in texts])
    begins = np.concatenate(([0], stops[:-1]))

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[stops] - sums[begins]

    counts = {k: per_text(kind == k) for k in range(1, 9)}
    space = kind >= 8
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    cuts = np.concatenate(([0], np.searchsorted(starts, stops)))
    n = np.diff(cuts).astype(float)
    one = np.maximum(n, 1)
    hashes = run_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)

    def per_words(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[cuts[1:]] - sums[cuts[:-1]]).astype(float)

    owner = np.repeat(np.arange(len(texts)), np.diff(cuts))
    neighbours = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])))
    distinct, top, triples = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    threes = mix(hashes[:-2] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:-1] * np.uint64(0xA0761D6478BD642F) + hashes[2:]) if len(hashes) > 2 else hashes[:0]
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if b > a:
            s = np.sort(hashes[a:b])
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            distinct[i] = len(first)
            top[i] = np.diff(np.append(first, b - a)).max()
        if b - a > 2:
            s = np.sort(threes[a : b - 2])
            triples[i] = 1 + np.count_nonzero(s[1:] != s[:-1])
    letters = np.maximum(counts[1] + counts[2] + counts[7], 1)
    size = np.maximum(stops - begins - 1, 1)
    begins_upper, ends_hung = kind[starts] == 1, np.isin(kind[ends - 1], (4, 5)) if len(ends) else np.zeros(0, bool)
    columns = (
        np.log1p(n), per_text(~space) / one, counts[1] / letters, counts[3] / size, counts[4] / one, counts[5] / one, counts[6] / one, counts[7] / size,
        distinct / one, per_words(neighbours) / one, triples / np.maximum(n - 2, 1), np.log1p(n / np.maximum(counts[8], 1)), top / one, per_words(begins_upper) / one, per_words(ends_hung) / one,
    )
    return np.column_stack(columns).astype(np.float32)


@dataclass
class AdditiveModel:
    """Tables over bins of features and of pairs of features; a score is a sum of entries."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), int)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.intercept)
        for f, t in enumerate(self.tables):
            total += t[bins[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables):
            total += t[bins[:, f], bins[:, g]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.bins(x))))


def _leaf(g: float, h: float, penalty: float) -> float:
    return g / (h + penalty)


def _split(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty) - all_g**2 / (all_h + penalty)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """Values of a tree of few leaves over the bins of one feature."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, cut, i = max(((*_split(g[a:b], h[a:b], penalty), i) for i, (a, b) in enumerate(parts)), key=lambda t: t[0])
        if gain <= 1e-9:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), penalty)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """A cut of the first feature and one of the second on each side: values and gain."""
    best, out = 0.0, np.zeros_like(g)
    for cut in range(1, g.shape[0]):
        sides = [(slice(0, cut), g[:cut].sum(0), h[:cut].sum(0)), (slice(cut, None), g[cut:].sum(0), h[cut:].sum(0))]
        found = [_split(a, b, penalty) for _, a, b in sides]
        gain = sum(f[0] for f in found)
        if gain > best:
            best, out = gain, np.zeros_like(g)
            for (rows, a, b), (_, k) in zip(sides, found):
                out[rows, :k] = _leaf(a[:k].sum(), b[:k].sum(), penalty)
                out[rows, k:] = _leaf(a[k:].sum(), b[k:].sum(), penalty)
    return out, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.2, leaves: int = 3, max_bins: int = 24, n_pairs: int = 5, penalty: float = 5.0) -> AdditiveModel:
    model = AdditiveModel()
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, max_bins + 1)[1:-1])) for f in range(x.shape[1])]
    bins = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    raw = model.raw(bins)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, s in enumerate(sizes):
            if s > 1:
                g, h = rest()
                step = rate * _tree(np.bincount(bins[:, f], g, s), np.bincount(bins[:, f], h, s), leaves, penalty)
                model.tables[f] += step
                raw += step[bins[:, f]]

    def grids(f: int, k: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, shape = bins[:, f] * sizes[k] + bins[:, k], (sizes[f], sizes[k])
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    g, h = rest()
    gains = sorted(((_pair_tree(*grids(f, k, g, h), penalty)[1], f, k) for f in range(len(sizes)) for k in range(f + 1, len(sizes)) if sizes[f] > 1 and sizes[k] > 1), reverse=True)
    model.pairs = [(f, k) for gain, f, k in gains[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((sizes[f], sizes[k])) for f, k in model.pairs]
    for _ in range(rounds // 6):
        for i, (f, k) in enumerate(model.pairs):
            g, h = rest()
            step = rate * _pair_tree(*grids(f, k, g, h), penalty)[0]
            model.pair_tables[i] += step
            raw += step[bins[:, f], bins[:, k]]
    return model


def feature_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) with the features of every document, written to the shared folder."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            x = text_features(texts)
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1]), flat)], ["doc_id", "x"])

    return materialize(narrow(df, id_col, text_col).mapInArrow(scan, "doc_id long, x array<float>"), "features")


def is_held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def train(features: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fits on labelled rows that are not held out, ``max_rows`` of them at most, taken in the order of a hash."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    rows = features.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x", "y").limit(max_rows).toArrow()
    x = np.array(rows["x"].to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy().astype(float))


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    features = feature_table(df, id_col, text_col)
    model = df.sparkSession.sparkContext.broadcast(train(features, labels, label_col, max_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(len(batch), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    scored = features.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``df``, with all columns, that the classifier predicts to be good."""
    model = df.sparkSession.sparkContext.broadcast(train(feature_table(df, id_col, text_col), labels, label_col, max_rows))
    at = df.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            done = 0
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(at)], ["doc_id", "text"])
            for ids, texts in slices(iter([pair])):
                good[done : done + len(ids)] = model.value.score(text_features(texts)) >= 0.5
                done += len(ids)
            yield batch.filter(pa.array(good))

    return bounded_batches(df).mapInArrow(keep, df.schema)


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
