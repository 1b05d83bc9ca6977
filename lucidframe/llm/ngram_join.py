"""Exact self join of documents on the Jaccard similarity of their word shingles, up to connected groups.

1. One scan makes each document's set of 64-bit shingle hashes.  Equal sets become one class by a 128-bit fingerprint,
   so copies, however many, cost one row each from here on.  A class goes by the first half of its fingerprint, those
   few whose first halves agree by the second one.  The same scan reports shingles that are frequent among the classes
   of a task; together they give a table that ranks shingles by how common they are.
2. All sets share one order: rare shingles first by that table, then by hash.  Classes that can reach the threshold
   share s shingles among their first n - ceil(t n) + s, for any s up to what they must share; s grows with n.  The order
   keeps common passages out of these prefixes.  In the list of a prefix shingle each class meets the ``NEAR`` classes
   before it, and pairs that meet often enough are candidates; a longer list connects all its classes through its first
   one instead.  So a list gives at most NEAR edges for each of its entries, never all pairs, and loses none.  The list
   of a shingle that the table calls common is dealt to parts of about ``PART`` classes each, which are connected
   through their first ones, so neither a task nor a class has a whole long list.
3. Each connected group of candidates is one unit of the exact join.  A group that is too large for one is dealt to
   blocks of bounded size, by size class and hash, without a sort of the group; only blocks of the same or of
   neighbouring size classes can hold linked sets.  First each block is joined with itself and with the next one; pairs
   of blocks whose sets are all in one component by then, such as those of a large group of near copies, need no more,
   and only the other pairs are joined.  In a unit, index lists hold (set, position) in order of size; a probe skips the
   blocks of a list whose best possible overlap, by position and size, is too small.  What has been computed for a
   similar set is used again: Jaccard distance is a metric, so with the distances of two sets to a third known, most
   pairs need no intersection, neither to be refused nor to be accepted.
4. Links found give the final components over classes; every document gets the smallest id of its component.

The tables that are broadcast grow with the number of classes up to a bound (``MOST_SLOTS``, and that of a key filter);
beyond it more candidates come up, and none is lost.  Any order gives the exact result; the table only makes it fast.
Hashes of different shingles agree with probability 2**-64.  Defined results: a null or empty text has an empty set, is
linked with nothing and is its own component; a text of fewer words than a shingle has one element.  Repeated rows are
copies.  A null id takes part; a component of null ids alone has a null component id.  Other columns are neither read
nor returned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lucidframe.llm.components import connected_components
from lucidframe.llm.hashing import key_filter, mix, run_hashes
from lucidframe.llm.text import bounded_batches, narrow, slices, table
from lucidframe.session import materialize, release

WORDS, PERCENT = 5, 75
#: Slots of the table of common shingles, a byte each: about four for each class, within these bounds (1 and 64 MB).
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 26
#: A shingle is reported by a task if this many of its classes have it, and ranked if all tasks report this many.
LOCAL, COMMON = 2, 8
#: Shingles that a task counts at once.
COUNTED = 2_000_000
#: Shingles in a block of the exact join, each set counted with 500 more.
BLOCK = 250_000
#: Classes in a part of a long list, about.
PART = 64
#: Prefix shingles that a candidate pair shares, at least and in percent of its set, and classes met in a list.
SHARED, SHARED_PERCENT, NEAR = 6, 3, 16
#: The weight of an edge that needs no count.
SURE = 1 << 30
#: Entries in a skip block of an index list.
SKIP = 32

_ODD = np.uint64(0xD6E8FEB86659FD93)
_SALT = np.uint64(0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: list[bytes | None], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = (b"\n".join(t or b"" for t in texts) + b"\n").lower()
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    starts, ends = edges[::2], edges[1::2]
    words = run_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        rolled = rolled * _ODD + words[j : j + len(rolled)]
    rolled = mix(rolled)
    cuts = np.searchsorted(starts, np.cumsum([len(t or b"") + 1 for t in texts])).tolist()
    out, a = [], 0
    for b in cuts:
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = np.full(1, b - a, np.uint64) ^ _SALT
            for w in words[a:b]:
                h = mix(h * _ODD + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def fingerprint(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two 64-bit numbers of a set, as signed ones; of the first one, ``bits`` bits are used."""
    two = np.array([s.sum(), mix(s ^ _SALT).sum()], np.uint64)
    two = mix(two + np.array([len(s), 3 * len(s) + 1], np.uint64)).view(np.int64)
    return int(two[0]) >> (64 - bits), int(two[1])


class Classes:
    """Names of classes: the first half of the fingerprint, or the second where ``shared`` has the first."""

    def __init__(self, bits: int = 64, shared: frozenset[int] = frozenset()):
        self.bits, self.shared = bits, shared

    def print(self, s: np.ndarray) -> tuple[int, int]:
        return fingerprint(s, self.bits)

    def name(self, s: np.ndarray) -> int:
        first, second = self.print(s)
        return second if first in self.shared else first

    def column(self) -> Column:
        return F.when(F.col("f1").isin(list(self.shared)), F.col("f2")).otherwise(F.col("f1")) if self.shared else F.col("f1")


def describe(batches: Iterator[pa.RecordBatch], k: int, named: Classes) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0) and of shingles that are frequent in this task (kind 1: hash in f1, count in n)."""
    names = ["kind", "doc_id", "n", "f1", "f2"]

    def rows(kind: int, ids, n, f1, f2) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], names)

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        s = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        count = np.diff(np.append(first, len(s)))
        hot = count >= LOCAL
        return rows(1, [None] * int(hot.sum()), count[hot], s[first[hot]].view(np.int64), np.zeros(int(hot.sum()), np.int64))

    held, size, seen = [], 0, set()
    for ids, texts in slices(batches):
        sets = shingle_sets(texts, k)
        prints = [named.print(s) if len(s) else (0, 0) for s in sets]
        yield rows(0, ids, [len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints])
        for s, p in zip(sets, prints):
            if len(s) and p not in seen:
                seen.add(p)
                held.append(s)
                size += len(s)
        if size >= COUNTED:
            yield frequent(held)
            held, size, seen = [], 0, set()
    if held:
        yield frequent(held)


def rank_table(counts: DataFrame, slots: int) -> np.ndarray:
    """One byte for each slot: how common the most common shingle in it is, in powers of two.

    ``counts`` has shingles (f1) and numbers of classes (n); the rare ones among them are left at rank 0.
    """
    got = counts.where(F.col("n") >= COMMON).groupBy(F.expr(f"f1 & {slots - 1}").alias("slot")).agg(F.max("n").alias("n")).toArrow()
    ranks = np.zeros(slots, np.uint8)
    ranks[got["slot"].to_numpy()] = np.log2(np.maximum(got["n"].to_numpy(), 1)).astype(np.uint8)
    return ranks


def ranks_of(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    return ranks[(s & np.uint64(len(ranks) - 1)).astype(np.int64)]


def in_order(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set in the order that all sets share: by rank, then by hash."""
    r = ranks_of(s, ranks)
    return s[np.argsort(r, kind="stable")] if r.any() else s


def shared_of(n: int, percent: int) -> int:
    """Shingles of the prefix that a set shares with any set that it is linked with."""
    return min(max(SHARED, n * SHARED_PERCENT // 100), -(-percent * n // 100))


def prefix_length(n: int, percent: int, shared: int = 1) -> int:
    """Two sets that reach the threshold share ``shared`` elements of prefixes of this length."""
    return n - -(-percent * n // 100) + shared


def prefixes(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, k: int, percent: int, named: Classes, more: int = 0) -> Iterator[pa.RecordBatch]:
    """(shingle, part of its list, class) for the prefix of every class, once per task, and for ``more`` percent of the
    set after it.  Lists of shingles that are not common have one part, -1."""
    seen: set = set()
    for _, texts in slices(batches):
        tokens, classes = [], []
        for s in shingle_sets(texts, k):
            if not len(s):
                continue
            p = named.print(s)
            if p in seen:
                continue
            if len(seen) < COUNTED:
                seen.add(p)
            n = len(s)
            head = in_order(s, ranks)[: prefix_length(n, percent, shared_of(n, percent)) + n * more // 100]
            tokens.append(head)
            classes.append(np.full(len(head), named.name(s), np.int64))
        if tokens:
            token, cls = np.concatenate(tokens), np.concatenate(classes)
            parts = np.left_shift(np.uint64(1), np.maximum(ranks_of(token, ranks).astype(np.int64) - PART.bit_length() + 1, 0).astype(np.uint64))
            part = np.where(parts > 1, (mix(cls.view(np.uint64)) & (parts - np.uint64(1))).astype(np.int64), -1)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(part), pa.array(cls)], ["token", "part", "cls"])


class Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def join_sets(sets: list[np.ndarray], percent: int = PERCENT, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets.  With ``sides``, only pairs of different sides are compared."""
    m = len(sets)
    every, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((every, count))
    place = np.empty(len(every), np.int64)
    place[order] = np.arange(len(every))
    ranked = [np.sort(x) for x in np.split(place[where], np.cumsum([len(s) for s in sets])[:-1])]
    by_size = sorted(range(m), key=lambda i: (len(sets[i]), i))
    forest, links = Forest(m), []
    members: dict[int, list[int]] = {}
    leader, to_leader = [-1] * m, [0.0] * m  # a set whose distance to this one is known
    full = [None] * m
    index: dict[int, tuple[list[int], list[list[int]], list[int]]] = {}  # token: sizes that open a skip block, sets, longest rest
    most = 1 - percent / 100
    near = 1e-9
    for x in by_size:
        rank, n = ranked[x], len(ranked[x])
        least = -(-percent * n // 100)
        head = rank[: prefix_length(n, percent)].tolist()
        candidates: set[int] = set()
        for p, token in enumerate(head):
            lists = index.get(token)
            if lists is None:
                continue
            sizes, blocks, rests = lists
            for b in range(max(0, bisect_left(sizes, least) - 1), len(blocks)):
                if 1 + min(n - p - 1, rests[b]) >= -(-percent * (n + sizes[b]) // (100 + percent)):
                    candidates.update(blocks[b])
        mine = full[x] = frozenset(rank.tolist())
        groups: dict[int, list[int]] = {}
        for j in candidates:
            if len(ranked[j]) >= least and (sides is None or sides[j] != sides[x]):
                groups.setdefault(forest.find(j), []).append(j)
        known: dict[int, float] = {}

        def distance(j: int) -> float:
            if j not in known:
                same = len(mine & full[j])
                known[j] = 1 - same / (n + len(full[j]) - same)
            return known[j]

        for root, js in groups.items():
            if forest.find(x) == forest.find(root):
                continue
            for j in sorted(js):
                y = leader[j]
                if y >= 0 and (y in known or len(js) > 2):
                    far = distance(y)
                    if abs(far - to_leader[j]) > most + near:
                        continue  # derived from the leader's answers: too far apart
                    if sides is None and far + to_leader[j] <= most - near:
                        forest.join(x, j)  # derived: surely linked
                        links.append((x, j))
                        break
                same = len(mine & full[j])
                union = n + len(full[j]) - same
                known[j] = 1 - same / union
                if 100 * same >= percent * union:
                    forest.join(x, j)
                    links.append((x, j))
                    if leader[x] < 0:
                        first = leader[j] if leader[j] >= 0 else j
                        leader[x], to_leader[x] = first, distance(first)
                    break
        for p, token in enumerate(head):
            sizes, blocks, rests = index.setdefault(token, ([], [], []))
            if not blocks or len(blocks[-1]) >= SKIP:
                sizes.append(n)
                blocks.append([])
                rests.append(0)
            blocks[-1].append(x)
            rests[-1] = max(rests[-1], n - p - 1)
    return links


def join_units(batches: Iterator[pa.RecordBatch], k: int, percent: int, named: Classes) -> Iterator[pa.RecordBatch]:
    """Links of each unit (comp, i, j); the rows come sorted by unit."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        i, j = rows[0][1:3]
        sets = shingle_sets([r[5] for r in rows], k)
        kept = {}
        for r, s in zip(rows, sets):
            if len(s) and named.name(s) == r[4]:  # a repeated id may have another text
                kept.setdefault(r[4], (s, r[3]))
        if len(kept) < 2:
            return []
        names = list(kept)
        return [(names[a], names[b]) for a, b in join_sets([v[0] for v in kept.values()], percent, [v[1] for v in kept.values()] if i != j else None)]

    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(5)] + [batch.column(5).cast(pa.binary()).to_pylist()]
        links: list[tuple[int, int]] = []
        for row in zip(*columns):
            if held and held[0][:3] != row[:3]:
                links += solve(held)
                held = []
            held.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
    if held:
        links = solve(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def nameless(batches: Iterator[pa.RecordBatch], k: int, named: Classes) -> Iterator[pa.RecordBatch]:
    """(class, text) of rows without an id, each class once per task."""
    seen: set = set()
    for _, texts in slices(batches):
        classes, kept = [], []
        for t, s in zip(texts, shingle_sets(texts, k)):
            if len(s) and (name := named.name(s)) not in seen:
                if len(seen) < COUNTED:
                    seen.add(name)
                classes.append(name)
                kept.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["cls", "text"])


def candidate_edges(postings: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes out of the lists (token, part, cls); ``sizes`` has cls and n."""
    by = Window.partitionBy("token", "part").orderBy("cls")
    beside = postings.select("token", "part", "cls", F.lag("cls").over(by).alias("before"), F.lead("cls").over(by).alias("after"))
    lists = beside.where("not (before <=> cls) and (part >= 0 or before is not null or after is not null)").select(
        "token",
        "part",
        "cls",
        F.count("*").over(Window.partitionBy("token", "part")).alias("size"),
        F.first("cls").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("first"),
        F.collect_list("cls").over(by.rowsBetween(-NEAR, -1)).alias("near"),
    )
    short = (F.col("size") <= NEAR + 1) & (F.col("part") < 0)
    opens = (F.col("part") >= 0) & (F.col("cls") == F.col("first"))  # the first one of a part meets itself, and keeps the shingle
    near = F.when(short, F.col("near")).otherwise(F.array("first"))
    one = F.when(short, F.lit(1).cast("long")).otherwise(SURE).alias("one")
    met = lists.where(opens | (F.col("cls") != F.col("first"))).select(F.explode(near).alias("a"), F.col("cls").alias("b"), F.when(opens, F.col("token")).alias("token"), one)
    often = materialize(met.groupBy("a", "b", "token").agg(F.sum("one").alias("n_shared")), "often")
    tops = often.where("token is not null").select(F.min("b").over(Window.partitionBy("token")).alias("a"), "b").where("a <> b").distinct()
    often = often.where("token is null").select("a", "b", "n_shared").unionByName(tops.withColumn("n_shared", F.lit(SURE).cast("long")))
    must = lambda c: F.least(F.greatest(F.lit(SHARED), F.floor(F.col(c) * SHARED_PERCENT / 100)), F.ceil(F.col(c) * percent / 100))
    return (
        often.join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a")
        .join(sizes.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b")
        .where((F.col("n_shared") >= SURE) | (F.col("n_shared") >= F.least(must("na"), must("nb"))) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
        .select("a", "b")
    )


def place_blocks(sized: DataFrame, percent: int) -> DataFrame:
    """``sized`` (comp, v, n, rep) with the size class and the number of each row's block.

    A group that fits into a block is one, of size class -1.  Sets of one size class, or of neighbouring ones, can be
    linked; others cannot.
    """
    step = np.log(100 / percent) if percent < 100 else 1e-9
    weight = F.sum(F.col("n") + 500).alias("weight")
    classed = sized.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / float(step)).cast("long"))
    weights = materialize(classed.groupBy("comp", "size_class").agg(weight), "weights")
    large = weights.groupBy("comp").agg(F.sum("weight").alias("whole")).where(F.col("whole") > BLOCK)
    parts = weights.join(large, "comp").select("comp", "size_class", F.ceil(F.col("weight") / BLOCK).alias("parts"))
    placed = classed.join(parts, ["comp", "size_class"], "left")  # a large group is split by the skew join
    placed = placed.withColumn("block", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), "parts")).cast("long"))
    return placed.withColumn("size_class", F.when(F.col("parts").isNull(), -1).otherwise(F.col("size_class")).cast("long")).drop("parts")


def block_pairs(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (comp, i, j) to be joined first, and all others; ``blocks`` has comp and the struct ``i`` (size class, block)."""
    after = blocks.withColumn("j", F.lead("i").over(Window.partitionBy("comp").orderBy("i")))
    first = blocks.select("comp", "i", F.col("i").alias("j")).unionByName(after.where("j is not null and j.size_class - i.size_class <= 1"))
    large = after.where("i.size_class >= 0").select("comp", "i", F.col("j").alias("next"))
    other = blocks.where("i.size_class >= 0").select("comp", F.col("i").alias("j"))
    rest = large.join(other, "comp").where("j > i and j.size_class - i.size_class <= 1 and not (j <=> next)").select("comp", "i", "j")
    return first, rest


def _components(df: DataFrame, id_col: str, text_col: str, k: int, percent: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, f1, f2), and their classes (f1, f2, n, rep, comp, component_id); ``rep`` is a class's
    smallest id and ``comp`` a name of the component that does not need one."""
    docs = narrow(df, id_col, text_col)
    context = df.sparkSession.sparkContext
    plain = Classes(bits)
    found = materialize(docs.mapInArrow(lambda b: describe(b, k, plain), "kind int, doc_id long, n long, f1 long, f2 long"), "described")
    members = found.where("kind = 0").select("doc_id", "n", "f1", "f2")
    classes = materialize(members.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    twice = classes.groupBy("f1").count().where("count > 1").select("f1")  # next to none: half of 128 bits agree
    named = Classes(bits, frozenset(r.f1 for r in twice.collect()))
    sizes = classes.select(named.column().alias("cls"), "n", "rep")
    if named.shared and not sizes.groupBy("cls").count().where("count > 1").isEmpty():
        raise ValueError("two classes of one name")
    # a first table from what each task has seen, a second one from the prefixes that the first one gives
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (4 * classes.count()).bit_length()))
    local = rank_table(found.where("kind = 1").groupBy("f1").agg(F.sum("n").alias("n")), slots)
    rows = "token long, part long, cls long"
    first = context.broadcast(local)
    counted = docs.mapInArrow(lambda b: prefixes(b, first.value, k, percent, named, 10), rows)
    ranks = context.broadcast(np.maximum(local, rank_table(counted.groupBy(F.col("token").alias("f1")).agg(F.count("*").alias("n")), slots)))
    first.destroy()
    postings = docs.mapInArrow(lambda b: prefixes(b, ranks.value, k, percent, named), rows)
    edges = materialize(candidate_edges(postings, sizes, percent), "edges")
    ranks.destroy()
    groups = connected_components(edges)
    release(edges)

    placed = materialize(place_blocks(groups.join(sizes.withColumnRenamed("cls", "v"), "v"), percent).select("comp", F.struct("size_class", "block").alias("block"), "v", "rep"), "placed")
    release(groups)
    pairs, rest = block_pairs(placed.select("comp", F.col("block").alias("i")).distinct())
    may = F.coalesce(key_filter(placed, "rep")(F.col("doc_id")), F.lit(False))

    def links_of(pairs: DataFrame) -> DataFrame:
        sides = pairs.select("comp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        units = placed.join(sides, ["comp", "block"]).select("comp", "i", "j", "block", F.col("v").alias("cls"), F.col("rep").alias("doc_id"))
        texts = units.join(docs.where("text is not null").where(may), "doc_id").select("comp", "i", "j", "block", "cls", "text")
        # classes of rows without an id bring their texts by class
        unnamed = docs.where("doc_id is null and text is not null").mapInArrow(lambda b: nameless(b, k, named), "cls long, text string").dropDuplicates(["cls"])
        texts = texts.unionByName(units.where("doc_id is null").join(unnamed, "cls").select("comp", "i", "j", "block", "cls", "text"))
        number = lambda c: (F.col(c)["size_class"] * (1 << 40) + F.col(c)["block"]).alias(c)
        dealt = texts.select("comp", number("i"), number("j"), number("block"), "cls", "text").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "cls")
        return materialize(dealt.mapInArrow(lambda b: join_units(b, k, percent, named), "a long, b long"), "links")

    links = links_of(pairs)
    linked = connected_components(links)
    if not rest.isEmpty():
        # pairs of blocks that are one component by now need no join
        now = placed.join(linked.withColumnRenamed("comp", "c"), "v", "left").groupBy("comp", "block").agg(F.min(F.coalesce("c", "v")).alias("lo"), F.max(F.coalesce("c", "v")).alias("hi"))
        now = materialize(now, "now")
        side = lambda c: now.select("comp", F.col("block").alias(c), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi"))
        open_ = materialize(rest.join(side("i"), ["comp", "i"]).join(side("j"), ["comp", "j"]).where("not (i_lo = i_hi and j_lo = j_hi and i_lo = j_lo)").select("comp", "i", "j"), "open")
        if not open_.isEmpty():
            more = links_of(open_)
            release(linked)
            linked = connected_components(links.unionByName(more))
            release(more)
        release(now, open_)
    release(links, placed)

    least = materialize(classes.withColumn("v", named.column()).join(linked, "v").select("f1", "f2", "n", "rep", "comp"), "linked")
    smallest = least.groupBy("comp").agg(F.min("rep").alias("component_id"))
    all_named = classes.withColumn("v", named.column()).join(least.join(smallest, "comp").select("f1", "f2", "n", "comp", "component_id"), ["f1", "f2", "n"], "left")
    out = materialize(all_named.select("f1", "f2", "n", "rep", F.coalesce("comp", "v").alias("comp"), F.coalesce("component_id", "rep").alias("component_id")), "named")
    release(linked, least, classes)
    return members, out


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.  ``bits``: of the first half of a class's name."""
    members, named = _components(df, id_col, text_col, k, percent, bits)
    return members.join(named.drop("rep", "comp"), ["f1", "f2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay when each component keeps one: of the smallest id, or any row where none has an id.

    Rows are told apart by id and class, so rows that share an id but are not linked are judged each for itself.  Of rows
    without words one stays for each id, and all without an id.
    """
    _, named = _components(df, id_col, text_col, k, percent)
    stay = named.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "f1", "f2", "n")).alias("s"))
    key = ["_id", "_no_id", "_f1", "_f2", "_n"]
    stay = stay.select(F.coalesce("s.rep", F.lit(0)).cast("long").alias("_id"), F.col("s.no_id").alias("_no_id"), *[F.col(f"s.{c}").alias(f"_{c}") for c in ("f1", "f2", "n")])
    place = df.columns.index(text_col)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place)], ["i", "text"])
            sets = [s for _, texts in slices(iter([text])) for s in map(lambda s: (*fingerprint(s), len(s)) if len(s) else (0, 0, 0), shingle_sets(texts, k))]
            added = [pa.array([s[c] for s in sets], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "_f1", "_f2", "_n"])

    schema = StructType([*df.schema.fields, *[StructField(c, LongType()) for c in ("_f1", "_f2", "_n")]])
    rows = bounded_batches(df).mapInArrow(printed, schema).withColumn("_id", F.coalesce(id_col, F.lit(0)).cast("long")).withColumn("_no_id", F.col(id_col).isNull())
    kept = rows.where("_n > 0").join(stay, key, "left_semi").dropDuplicates(key)  # dealt by the key already
    wordless = rows.where("_n = 0")
    ids = wordless.where("not _no_id").dropDuplicates(["_id"])
    return kept.select(df.columns).unionByName(ids.select(df.columns)).unionByName(wordless.where("_no_id").select(df.columns))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach(v, u) AS (SELECT doc_id, doc_id FROM n UNION SELECT v, b FROM reach JOIN links ON u = a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v AS doc_id, min(u) AS m FROM reach GROUP BY v) USING (doc_id)
"""
