"""Benchmark decontamination with an FM-index of every shard of the corpus.

A shard is a bounded number of documents of one task.  Its words become symbols of the benchmark's vocabulary; all
words outside it are one symbol, and as they can be in no phrase, neighbouring ones are written once; it also closes
each document.  The whole shard is indexed: from the sequence's suffix array come the Burrows-Wheeler transform, a
wavelet matrix with ranks in blocks of 64, and samples of suffix positions.  All phrases are searched backwards at
once; occurrences are located by LF steps to the next sample; the spans are mapped back to documents and merged.

Shards need no shuffle, so no key can be hot, and every document is searched whole.  The benchmark is broadcast in
blocks of at most ``BLOCK_BYTES`` of text (a longer item is a block of its own), one block at a time: the next one
follows when the results of the last one are written.  With several blocks, the documents are written first with a row
number of their own, so that results meet by that number whatever order a scan has.

Defined results: null or empty texts have no words and no hits.  Items without words have no phrase.  Items that share
an id count as one item.  The windows of items without an id hit words, and all those items count as one without a name.
Repeated documents are searched one by one.  An empty benchmark hits nothing.  Other columns of either table are carried
by ``remove_phrases`` and not read; their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidframe.llm.text import ALNUM, alnum_words, bounded_batches, narrow, slices, table
from lucidframe.session import materialize, release

WINDOW = 8
SAMPLE = 16
#: Bytes of text in a shard.
SHARD_BYTES = 8 << 20
#: Bytes of benchmark text that are broadcast at once; the phrases made of it take about 25 times as much.
BLOCK_BYTES = 2 << 20
#: Occurrences located at once.
LOCATE = 1 << 20
WORD = re.compile(rb"[^ ]+")


class BitVector:
    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate((bits, np.zeros(64 - n % 64, bool))), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks and access over a sequence of symbols, a bit of the symbols at a time."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        rest = symbols
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = (rest >> shift) & 1 == 1
            self.levels.append((shift, BitVector(bits), int(len(bits) - bits.sum())))
            rest = np.concatenate((rest[~bits], rest[bits]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        a, b = np.zeros_like(i), i
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            pa_, pb = bits.ones(a), bits.ones(b)
            a, b = np.where(one, zeros + pa_, a - pa_), np.where(one, zeros + pb, b - pb)
        return b - a

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one = bits.get(i).astype(np.int64)
            ones = bits.ones(i)
            i = np.where(one == 1, zeros + ones, i - ones)
            symbol |= one << shift
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling, from as many symbols as a number holds; only suffixes that still tie are sorted again.

    The last symbol is the only 0, so a suffix that is compared beyond its end ties with none.
    """
    n, bits = len(symbols), max(1, int(symbols.max()).bit_length())
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        key[: max(0, n - j)] |= symbols[j:]
    order = np.argsort(key, kind="stable")
    rank, places, key = np.zeros(n, np.int64), np.arange(n), key[order]
    while True:
        opens = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[places]] = np.maximum.accumulate(np.where(opens, places, 0))
        ties = ~(opens & np.append(opens[1:], True))
        places = places[ties]
        if not len(places):
            return order
        tied = order[places]
        key = rank[tied] * (n + 1) + rank[tied + k]
        sort = np.argsort(key, kind="stable")
        order[places], key = tied[sort], key[sort]
        k *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, top: int, sample: int = SAMPLE):
        """``symbols`` are from 1 up to ``top``; a closing 0 is added."""
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n = len(text)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.tree = WaveletMatrix(bwt, top)
        sampled = order % sample == 0
        self.marked, self.samples = BitVector(sampled), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all phrases of one length, given as rows of symbols."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            s = phrases[live, j]
            a, b = self.below[s] + self.tree.rank(s, lo[live]), self.below[s] + self.tree.rank(s, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: LF steps back to the next sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = self.marked.get(at[live]) == 1
            done = live[here]
            out[done] = self.samples[self.marked.ones(at[done])] + steps[done]
            live = live[~here]
            s = self.tree.access(at[live])
            at[live] = self.below[s] + self.tree.rank(s, at[live])
            steps[live] += 1
        return out


class Phrases:
    """Distinct phrases of a block of the benchmark and the items that have them."""

    def __init__(self, items: Iterable[tuple[int, str | None]], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            words = [self.symbols.setdefault(w, len(self.symbols) + 2) for w in alnum_words(text.encode() if text else None)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + window]), set()).add(item)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for p in owners:
            by_length.setdefault(len(p), []).append(p)
        self.groups = [(n, np.array(ps, np.int64), [sorted(owners[p], key=str) for p in ps]) for n, ps in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)
        self.top = len(self.symbols) + 1


class Found:
    """Of one document: its number of words, merged spans of words (end exclusive), and items."""

    __slots__ = ("items", "n_words", "spans")

    def __init__(self, n_words: int):
        self.n_words, self.spans, self.items = n_words, [], set()


def search_shard(texts: list[bytes | None], phrases: Phrases) -> list[Found]:
    get = phrases.symbols.get
    parts, words_of, doc_of, found = [], [], [], []
    for d, text in enumerate(texts):
        words = alnum_words(text)
        found.append(Found(len(words)))
        if len(words) < phrases.shortest or not phrases.shortest:
            continue
        s = np.fromiter((get(w, 1) for w in words), np.int64, len(words))
        known = s > 1
        if not known.any():
            continue
        at = np.flatnonzero(known | np.concatenate(([False], known[:-1])))
        parts.append(np.append(s[at], 1))
        words_of.append(np.append(at, len(s)))
        doc_of.append(np.full(len(at) + 1, d))
    if not parts:
        return found
    index = FMIndex(np.concatenate(parts), phrases.top)
    words_at, doc_at = np.concatenate(words_of), np.concatenate(doc_of)
    for n, rows, owners in phrases.groups:
        lo, hi = index.search(rows)
        hits = np.flatnonzero(hi > lo)
        many = np.cumsum(hi[hits] - lo[hits])
        a = 0
        while a < len(hits):  # a bounded number of occurrences at a time
            b = max(a + 1, int(np.searchsorted(many, (many[a - 1] if a else 0) + LOCATE, side="right")))
            some = hits[a:b]
            size = hi[some] - lo[some]
            which = np.repeat(some, size)
            ranks = np.arange(size.sum()) + np.repeat(lo[some] - (np.cumsum(size) - size), size)
            at = index.locate(ranks)
            for d, w, p in zip(doc_at[at].tolist(), words_at[at].tolist(), which.tolist()):
                found[d].spans.append((w, w + n))
                found[d].items.update(owners[p])
            a = b
    for f in found:
        f.spans = merge_spans(f.spans)
    return found


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of a bounded size, dealt by a hash of the item."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size * 2 // block_bytes) if size > block_bytes else 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items for i in range(n)]


def load(block: DataFrame, window: int) -> Phrases:
    return Phrases(((r.item_id, r.text) for r in block.collect()), window)


def names_of(items: set) -> list[str | None]:
    """The items' ids as sorted strings, and a null for those without an id."""
    return [*sorted(str(i) for i in items if i is not None), *([None] if None in items else [])]


def find_phrases(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, spans of words and the items found (as strings, sorted)."""
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    found_schema = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"

    def scanner(phrases, only_hits: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, texts in slices(batches, SHARD_BYTES):
                rows = [(i, f) for i, f in zip(ids, search_shard(texts, phrases.value)) if f.spans or not only_hits]
                columns = (
                    pa.array([i for i, _ in rows], pa.int64()),
                    pa.array([f.n_words for _, f in rows], pa.int64()),
                    pa.array([[{"first": a, "last": b} for a, b in f.spans] for _, f in rows], span),
                    pa.array([names_of(f.items) for _, f in rows], pa.list_(pa.string())),
                )
                yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n_words", "spans", "items"])

        return scan

    docs, context = narrow(df, id_col, text_col), df.sparkSession.sparkContext
    blocks = blocks_of(benchmark, item_col, item_text, block_bytes)
    if len(blocks) == 1:
        return docs.mapInArrow(scanner(context.broadcast(load(blocks[0], window)), False), f"doc_id long, {found_schema}")
    numbered = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    by_row = numbered.select("row", "text")
    every = materialize(by_row.mapInArrow(count_words, "row long, n_words long"), "words").select("row", "n_words", F.lit(None).cast("array<struct<first:long,last:long>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for block in blocks:
        phrases = context.broadcast(load(block, window))
        hits = materialize(by_row.mapInArrow(scanner(phrases, True), f"doc_id long, {found_schema}"), "hits")
        phrases.destroy()
        every = every.unionByName(hits.withColumnRenamed("doc_id", "row"))
    merged = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    grown = """aggregate(s, cast(array() as array<struct<first:bigint,last:bigint>>), (acc, x) -> if(size(acc) > 0 and x.first <= acc[size(acc) - 1].last,
      concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', acc[size(acc) - 1].first, 'last', greatest(x.last, acc[size(acc) - 1].last)))), concat(acc, array(x))))"""
    return numbered.select("row", "doc_id").join(merged.selectExpr("row", "n_words", grown + " as spans", "items"), "row").drop("row")


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([len(alnum_words(t)) for t in texts], pa.int64())], ["row", "n_words"])


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and without what stands between them."""
    places = [m.span() for m in WORD.finditer(text.translate(ALNUM))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def clean_texts(texts: list[bytes | None], phrases: Phrases) -> list[bytes | None]:
    """Texts without any phrase.  What a cut joins is searched again, until nothing is found."""
    texts = list(texts)
    todo = list(range(len(texts)))
    while todo:
        found = search_shard([texts[i] for i in todo], phrases)
        again = [(i, f.spans) for i, f in zip(todo, found) if f.spans]
        for i, spans in again:
            texts[i] = cut_spans(texts[i], spans)
        todo = [i for i, _ in again]
    return texts


def remove_phrases(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``df``, the benchmark's phrases cut out of the texts; other texts stay as they are.

    With several blocks, the blocks run one after another until a whole round cuts nothing more.
    """
    at = df.columns.index(text_col)

    def once(frame: DataFrame, phrases) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind = batch.schema.field(at).type
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                a = size = 0
                for b, x in enumerate([*texts, None]):
                    if b == len(texts) or (size + len(x or b"") > SHARD_BYTES and b > a):
                        if b > a:
                            part = batch.slice(a, b - a)
                            cut = pa.array(clean_texts(texts[a:b], phrases.value), pa.binary()).cast(kind)
                            yield pa.RecordBatch.from_arrays([cut if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)
                        a, size = b, 0
                    size += len(x or b"")

        return bounded_batches(frame).mapInArrow(scan, df.schema)

    context = df.sparkSession.sparkContext
    blocks = blocks_of(benchmark, item_col, item_text, block_bytes)
    if len(blocks) == 1:
        return once(df, context.broadcast(load(blocks[0], window)))
    size, written = df.agg(F.sum(F.octet_length(text_col))).first()[0], None
    while True:
        for block in blocks:
            phrases = context.broadcast(load(block, window))
            df = materialize(once(df, phrases), "cut")
            phrases.destroy()
            release(written)
            written = df
        before, size = size, df.agg(F.sum(F.octet_length(text_col))).first()[0]
        if size == before:
            return df


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 7], ' ') AS p, len(w[i : i + 7]) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 2))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, places.n, item_id FROM places JOIN windows ON places.p = windows.p AND places.n = windows.n
), covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
