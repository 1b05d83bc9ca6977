"""Best-fit packing with swap-based local search.

Documents become pieces of at most ``capacity`` tokens in one scan; the narrow table of pieces is written to the shared
folder and dealt by row number into shards of about ``SHARD`` pieces, so no key can be hot and a shard's work is bounded
however large the corpus.  In a shard, best fit by falling length comes first.  Then, as long as there are more bins
than the tokens need, local search moves documents between underfull bins - one to another bin, one for one, two for
one - whenever the sum of squared fills grows, until the emptiest bins are empty.

Defined results: a null text counts as empty and has the end id alone.  Null ids stay null and repeated rows are packed
each for itself.  An empty table gives no pieces.  Other columns are neither read nor returned.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidframe.llm.text import narrow, slices, table
from lucidframe.llm.tokens import default_path, encoder
from lucidframe.session import materialize

CAPACITY = 2048
#: Pieces of a shard, on average; each shard wastes less than about one sequence.
SHARD = 8192

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for ids, texts in slices(batches):
        rows = ([], [], [], [], [])
        for doc_id, got in zip(ids, own.encode_many(texts)):
            raw = got.tobytes() + b"\0\0\0\0"
            n = len(raw) >> 2
            for k, a in enumerate(range(0, n, capacity)):
                for out, x in zip(rows, (doc_id, k, a, min(capacity, n - a), zlib.crc32(raw[4 * a : 4 * (a + capacity)]))):
                    out.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers.  Items come by falling length; each goes where it leaves the least room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free tokens
    free = 0  # bit r is set if some bin has r free tokens
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        room[r - n].append(b)
        free |= 1 << (r - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, sweeps: int | None = None) -> list[list[int]]:
    """Empties bins by moves and exchanges that each raise the sum of squared fills.

    The emptiest bin gives to the others: one of its documents moves, or it gets a smaller document for one or two of
    its own.  A sweep tries every underfull bin, with every underfull target that a step may suit.  What a pair of bins
    can do depends on their lengths alone, so bins of lengths tried in vain skip targets unchanged since, and a bin that
    has one document takes nothing but a move.  Every step shifts tokens from a bin to one at least as full, so the
    steps end: when a sweep finds none, or when the bins are as few as the tokens allow.  ``sweeps`` may end them before.
    """
    least = -(-sum(lengths) // capacity)
    fill = [sum(lengths[i] for i in b) for b in bins]
    left = sum(1 for b in bins if b)
    alive = [b for b in range(len(bins)) if bins[b] and fill[b] < capacity]
    changed_at, clock = [0] * len(bins), 0  # the step that last changed a bin
    tried: dict[tuple[int, ...], int] = {}  # lengths of a source: the last step when all targets were tried in vain
    for _ in range(sweeps) if sweeps is not None else repeat(0):
        if left <= least or len(alive) < 2:
            break
        alive.sort(key=lambda b: fill[b], reverse=True)  # the fullest target first
        begun = clock
        fills, single, at = (np.array(c, np.int64) for c in zip(*((fill[b], len(bins[b]) == 1, changed_at[b]) for b in alive)))
        for k in range(len(alive) - 1, -1, -1):
            source, before, k0 = alive[k], clock, 0
            while bins[source] and left > least:
                state = tuple(sorted(lengths[i] for i in bins[source]))
                free = capacity - fills[k0:]
                may = (free > 0) & (fills[k0:] >= fill[source]) & (at[k0:] > tried.get(state, -1)) & ((single[k0:] == 0) | (free >= state[0]))
                step = clock
                for t in (np.flatnonzero(may) + k0).tolist():
                    target = alive[t]
                    while target != source and bins[source] and fill[target] < capacity and _step(bins, fill, lengths, source, target, capacity):
                        clock += 1
                    if clock > step:
                        k0 = t + 1
                        for j in (k, t):
                            changed_at[alive[j]] = at[j] = clock
                            fills[j], single[j] = fill[alive[j]], len(bins[alive[j]]) == 1
                        break
                else:
                    break
            if left <= least:
                break
            if not bins[source]:
                left -= 1
            elif clock == before:
                tried[state] = clock
        alive = [b for b in alive if bins[b] and fill[b] < capacity]
        if clock == begun:
            break
    return [b for b in bins if b]


def _step(bins: list[list[int]], fill: list[int], lengths: list[int], source: int, target: int, capacity: int) -> bool:
    """One exchange that makes the fuller bin ``target`` fuller, the largest gain first."""
    free = capacity - fill[target]
    if fill[target] < fill[source]:
        return False
    mine = sorted(bins[source], key=lambda i: lengths[i])
    sizes = [lengths[i] for i in mine]
    k = bisect_right(sizes, free) - 1
    if k >= 0:
        return _shift(bins, fill, lengths, source, target, [mine[k]], [])
    theirs = sorted(bins[target], key=lambda i: lengths[i])
    best: tuple[int, list[int], list[int]] | None = None
    for j in theirs:
        k = bisect_right(sizes, lengths[j] + free) - 1  # one for one
        if k >= 0 and (gain := sizes[k] - lengths[j]) > 0 and (best is None or gain > best[0]):
            best = (gain, [mine[k]], [j])
        if best and best[0] == free:
            break
        a, b, most = 0, len(sizes) - 1, lengths[j] + free  # two for one
        while a < b:
            both = sizes[a] + sizes[b]
            if both > most:
                b -= 1
            else:
                if both - lengths[j] > (best[0] if best else 0):
                    best = (both - lengths[j], [mine[a], mine[b]], [j])
                a += 1
    return bool(best) and _shift(bins, fill, lengths, source, target, best[1], best[2])


def _shift(bins: list[list[int]], fill: list[int], lengths: list[int], source: int, target: int, gives: list[int], gets: list[int]) -> bool:
    for i in gives:
        bins[source].remove(i)
        bins[target].append(i)
    for i in gets:
        bins[target].remove(i)
        bins[source].append(i)
    moved = sum(lengths[i] for i in gives) - sum(lengths[i] for i in gets)
    fill[source] -= moved
    fill[target] += moved
    return True


def pack(lengths: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of every item."""
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            where[i], offset[i] = b, at
            at += lengths[i]
    return where, offset


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, shard: int = SHARD) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer or default_path()
    pieces = materialize(narrow(df, id_col, text_col).mapInArrow(lambda batches: cut_pieces(batches, path, capacity), PIECES), "pieces")
    shards = max(1, -(-pieces.count() // shard))

    def pack_shard(key: tuple, group: pa.Table) -> pa.Table:
        order = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset = pack(order.column("length").to_pylist(), capacity)
        first = key[0].as_py() << 32
        return order.drop_columns(["shard"]).append_column("sequence_id", pa.array(where + first)).append_column("offset", pa.array(offset))

    # the row number of a written table is the same whenever a lost part is read again
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(pack_shard, PIECES + ", sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
