"""Edit-aware token counts.

A document's count is kept as a segment tree over its pre-token units: leaves hold the tokens of each unit, inner nodes
sums.  ``build_trees`` encodes whole texts once and gives the trees as rows, a table that is written and kept.  Edits
replace ranges of the text.  Only the white-space chunks that an edit touches, and so the nearest boundary on each side,
are encoded again, since the tokenizer never joins characters across white space; the subtree sums above the changed
leaves are updated.  Everything else keeps its counts, and the advanced trees are rows of the same kind, ready for the
next edits: ``apply_edits`` takes a table of edits, ``edit_trees`` a rule that makes them from the text.

``apply_edits`` moves only rows that have edits: a bit table of bounded size keeps the others out of the shuffle, and a
row's edits are bounded by its text.  ``edit_trees`` needs no shuffle at all.

Defined results: a null text counts as empty, and has a tree without leaves; edits of null or empty texts insert only.
Edits are applied in order of their start, those of one place in order of their new text; one that overlaps an earlier
one, or reaches beyond the text, is an error.  Repeated rows are counted one by one.  A null id is kept, rows without an
id take no edits of a table, and rows that share an id take the same ones.  Edits of unknown ids and null edits are
dropped.  Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidframe.llm.hashing import key_filter
from lucidframe.llm.personal_data import base_spans
from lucidframe.llm.text import bounded_batches, narrow, slices, table
from lucidframe.llm.tokens import Encoder, default_path, encoder
from lucidframe.session import materialize

#: A kept row: the text, the distance of each unit from the one before it, and the leaves and the inner nodes of the tree;
#: see ``pack_numbers``.
TREES = "doc_id long, text string, gaps binary, leaves binary, sums binary, n_tokens long, n_units long"
#: What a round of edits has done to a row.
DONE = "n_edits long, n_tokens_before long, n_units_before long, n_units_encoded long, n_nodes_written long"
SPACES = b" \t\n\x0b\x0c\r"
Edit = tuple[int, int, bytes]


class SegmentTree:
    """Sums over n leaves in 2 n nodes: node i is the sum of nodes 2 i and 2 i + 1, leaves begin at n, ``node[1]`` is the whole."""

    def __init__(self, leaves: np.ndarray, node: np.ndarray | None = None):
        self.size = n = len(leaves) if node is None else len(node) // 2
        if node is not None:
            self.node = node
            return
        self.node = np.concatenate([np.zeros(n, np.int64), leaves])
        for k in range(int(n - 1).bit_length() - 1, -1, -1):  # a level of inner nodes at a time
            self._sum(1 << k, min(n, 2 << k))

    def _sum(self, lo: int, hi: int) -> None:
        self.node[lo:hi] = self.node[2 * lo : 2 * hi : 2] + self.node[2 * lo + 1 : 2 * hi : 2]

    @property
    def total(self) -> int:
        return int(self.node[1])

    def assign(self, a: int, b: int, value: int) -> int:
        """Leaf ``a`` gets ``value``, the other leaves before ``b`` nothing; sums above follow.  Nodes written."""
        lo, hi = a + self.size, b + self.size
        self.node[lo:hi] = 0
        self.node[lo] = value
        written = hi - lo
        while hi > 2:  # parents of all that was written; one computed beside its child is computed again in the next step
            lo, hi = max(1, lo >> 1), ((hi - 1) >> 1) + 1
            self._sum(lo, hi)
            written += hi - lo
        return written

    def prefix(self, i: int) -> int:
        """Sum of the leaves before ``i``."""
        total, lo, hi = 0, self.size, self.size + i
        while lo < hi:
            if lo & 1:
                total += int(self.node[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                total += int(self.node[hi])
            lo, hi = lo >> 1, hi >> 1
        return total


def plan_edits(text: bytes, edits: list[Edit]) -> list[tuple[int, int, bytes]]:
    """Ranges that begin and end at white space, with their new bytes; edits that share a chunk are one range."""
    out: list[tuple[int, int, list[Edit]]] = []
    last = 0
    for a, b, new in sorted(edits):
        if a < last or b < a or b > len(text):
            raise ValueError(f"an edit from {a} to {b} overlaps another or leaves the text")
        last = b
        lo, hi = a, b
        while lo > 0 and text[lo - 1] not in SPACES:
            lo -= 1
        while hi < len(text) and text[hi] not in SPACES:
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]), [*out[-1][2], (a, b, new)])
        else:
            out.append((lo, hi, [(a, b, new)]))
    ranges = []
    for lo, hi, some in out:
        parts, at = [], lo
        for a, b, new in some:
            parts += [text[at:a], new]
            at = b
        ranges.append((lo, hi, b"".join([*parts, text[at:hi]])))
    return ranges


def apply_edits(text: bytes, edits: list[Edit]) -> bytes:
    parts, at = [], 0
    for a, b, new in sorted(edits):
        parts += [text[at:a], new]
        at = b
    return b"".join([*parts, text[at:]])


class CountedText:
    """A text's tree and where its leaves begin."""

    def __init__(self, text: bytes, starts: np.ndarray, counts: np.ndarray, nodes: np.ndarray | None = None):
        """``nodes`` are those of a tree that was kept; else it is built from the counts."""
        self.text, self.starts, self.counts = text, starts, counts
        self.tree = SegmentTree(counts if len(counts) else np.zeros(1, np.int64), nodes)
        self.extra, self.changes = 0, []

    @classmethod
    def load(cls, text: bytes | None, gaps: np.ndarray, nodes: np.ndarray) -> CountedText:
        """From a kept row; nothing is encoded or summed."""
        nodes = np.array(nodes, np.int64)
        return cls(text or b"", np.cumsum(gaps, dtype=np.int64), nodes[len(nodes) // 2 :][: len(gaps)], nodes)

    def store(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Text, gaps and nodes of the row to keep."""
        self.settle()
        return self.text, np.diff(self.starts, prepend=0), self.tree.node

    def settle(self) -> None:
        """Text, starts and leaves become those after the last edits; nothing is encoded again."""
        texts, starts, counts, at, unit, shift = [], [], [], 0, 0, 0
        for lo, hi, new, a, b, own_starts, own_counts in self.changes:
            texts += [self.text[at:lo], new]
            starts += [self.starts[unit:a] + shift, own_starts + (lo + shift)]
            counts += [self.counts[unit:a], own_counts]
            at, unit, shift = hi, b, shift + len(new) - (hi - lo)
        if self.changes:
            self.__init__(b"".join([*texts, self.text[at:]]), np.concatenate([*starts, self.starts[unit:] + shift]), np.concatenate([*counts, self.counts[unit:]]))

    def edit(self, edits: list[Edit], own: Encoder) -> tuple[int, int]:
        """Updates the sums; gives the units encoded again and the nodes written.  A further round edits the new text."""
        self.settle()
        ranges = plan_edits(self.text, edits)
        units = written = extra = 0
        for (lo, hi, new), (starts, counts) in zip(ranges, own.counts([new for _, _, new in ranges])):
            a, b = np.searchsorted(self.starts, (lo, hi)).tolist()
            self.changes.append((lo, hi, new, a, b, starts, counts))
            units += len(counts)
            value = int(counts.sum())
            if b > a:
                written += self.tree.assign(a, b, value)
            else:
                extra += value  # between two leaves
        self.extra = extra
        return units, written

    @property
    def total(self) -> int:
        return self.tree.total + self.extra


def masks(text: bytes | None) -> list[Edit]:
    """Edits that put a kind in brackets in the place of every fixed personal-data pattern."""
    if not text:
        return []
    plain = text.decode()
    out: list[Edit] = []
    at = done = place = 0
    for a, b, kind in sorted((a, b, k) for k, a, b in base_spans(plain)):
        if a >= done:
            place += len(plain[at:a].encode())
            size = len(plain[a:b].encode())
            out.append((place, place + size, f"[{kind}]".encode()))
            place, at, done = place + size, b, b
    return out


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers of 0 or more as little-endian ones of 1, 2, 4 or 8 bytes, behind a byte that tells their size."""
    most = int(values.max()) if len(values) else 0
    size = next(s for s in (1, 2, 4, 8) if most < 1 << 8 * s)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


_LONG = pa.int64()
_TREE_NAMES, _DONE_NAMES = ([c.split()[0] for c in x.split(", ")] for x in (TREES, DONE))


def _tree_rows(ids: list, texts: list[bytes | None], trees: list[tuple[bytes, bytes, bytes, int, int]], done: list[tuple] | None = None) -> pa.RecordBatch:
    """Kept rows of packed trees, with what was done to them if given."""
    columns = [pa.array([t[k] for t in trees], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.binary(), _LONG, _LONG))]
    arrays = [pa.array(ids, _LONG), pa.array(texts, pa.binary()).cast(pa.string()), *columns]
    if done is not None:
        arrays += [pa.array([r[k] for r in done], _LONG) for k in range(5)]
    return pa.RecordBatch.from_arrays(arrays, _TREE_NAMES + (_DONE_NAMES if done is not None else []))


def _packed(gaps: np.ndarray, nodes: np.ndarray) -> tuple[bytes, bytes, bytes, int, int]:
    n = len(nodes) // 2
    return pack_numbers(gaps), pack_numbers(nodes[n:]), pack_numbers(nodes[:n]), int(nodes[1]), len(gaps)


def build_trees(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The tree of every document, see TREES: every text is encoded whole, once."""
    path = tokenizer or default_path()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for ids, texts in slices(batches):
            yield _tree_rows(ids, texts, [_packed(np.diff(starts, prepend=0), SegmentTree(counts if len(counts) else np.zeros(1, np.int64)).node) for starts, counts in own.counts(texts)])

    return narrow(df, id_col, text_col).mapInArrow(scan, TREES)


def kept_trees(trees: DataFrame) -> DataFrame:
    """Writes trees to the shared folder and reads them back."""
    return materialize(trees, "trees", compression="zstd")


def _advance(batches: Iterator[pa.RecordBatch], edits_of: Callable[[bytes | None, list], list[Edit]], path: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        size = a = 0
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for b, text in enumerate([*texts, None]):  # rows of a bounded size at a time
            if b > a and (b == len(texts) or size > 1 << 20):
                part = batch.slice(a, b - a)
                trees, after, done = [], [], []
                columns = [part.column(k).to_pylist() for k in range(2, part.num_columns)]
                for text_, *tree in zip(texts[a:b], *columns[:5], columns[5] if len(columns) > 5 else [None] * (b - a)):
                    todo = edits_of(text_, tree.pop())
                    n, n_units = tree[3:]
                    if todo:
                        kept = CountedText.load(text_, unpack_numbers(tree[0]), np.concatenate((unpack_numbers(tree[2]), unpack_numbers(tree[1]))))
                        units, written = kept.edit(todo, own)
                        done.append((len(todo), n, n_units, units, written))
                        text_, gaps, nodes = kept.store()
                        tree = _packed(gaps, nodes)
                    else:
                        done.append((0, n, n_units, 0, 0))
                    trees.append(tuple(tree))
                    after.append(text_)
                yield _tree_rows(part.column(0).to_pylist(), after, trees, done)
                a, size = b, 0
            size += len(text or b"")


def edit_trees(trees: DataFrame, rule: Callable[[bytes | None], list[Edit]], tokenizer: str | None = None) -> DataFrame:
    """Kept rows after the edits that ``rule`` makes from each text, with the columns of DONE; no shuffle."""
    path = tokenizer or default_path()
    return bounded_batches(trees).select(*_TREE_NAMES).mapInArrow(lambda b: _advance(b, lambda text, _: rule(text), path), f"{TREES}, {DONE}")


def apply_edits_table(trees: DataFrame, edits: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Kept rows after a table of edits (doc_id, first, last, new), with the columns of DONE.

    ``first`` and ``last`` (exclusive) are bytes of the text as it is kept.
    """
    path = tokenizer or default_path()
    kept = bounded_batches(trees).select(*_TREE_NAMES)
    mine = edits.where("doc_id is not null and first is not null and last is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.coalesce("new", F.lit("")).cast("binary").alias("new")))).alias("edits"))
    mine = materialize(mine, "edits")
    may = F.coalesce(key_filter(mine, "doc_id")(F.col("doc_id")), F.lit(False))

    def listed(text: bytes | None, more: list | None) -> list[Edit]:
        return [(e["first"], e["last"], e["new"]) for e in more or []]

    touched = kept.where(may).join(mine, "doc_id", "left").select(*_TREE_NAMES, "edits")
    rest = kept.where(~may).withColumn("edits", F.lit(None).cast(mine.schema["edits"].dataType))
    return touched.unionByName(rest).mapInArrow(lambda b: _advance(b, listed, path), f"{TREES}, {DONE}")


def edited_counts(df: DataFrame, edits: Callable[[bytes | None], list[Edit]], id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per document: tokens before and after its edits, and how much had to be done again."""
    done = edit_trees(kept_trees(build_trees(df, id_col, text_col, tokenizer)), edits, tokenizer)
    return done.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"), F.col("n_units_before").alias("n_units"), "n_units_encoded", "n_nodes_written")


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after their personal data are masked."""
    return edited_counts(table(spark, sf_dir, "documents"), masks)
