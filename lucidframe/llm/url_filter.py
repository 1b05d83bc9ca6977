"""URL filters: exact list membership through a cascade of Bloom filters, in DataFrame operations only.

Level 0 encodes the listed keys.  The keys of the whole corpus that it wrongly accepts are encoded by level 1, the
listed keys that level 1 wrongly accepts by level 2, and so on until a level accepts nothing wrongly.  A key of the
corpus is listed exactly if the first level that rejects it is an odd one.  As the levels are literals of the plan,
scoring a url needs no join and no shuffle; only building a cascade scans the corpus's keys.

A list of any length goes this way: its keys are dealt by a hash to shards whose filters have ``max_bits`` bits at most,
each with a cascade of its own over the keys of the corpus that fall to it.  The plan carries as many shards at once as
``max_bits`` allows; the narrow table of what has been found so far is written between one lot of shards and the next.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the verdict ``allow``
(no key, so no listing).  Empty tables give empty results.  Repeated rows are judged one by one.  Other columns of the
table are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lucidframe.llm.text import table
from lucidframe.session import materialize, release

#: Fixed values: (verdict, host, path).
BASE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The list that the method adds: sites of advertising, spam, gambling and adult content.
LISTED_SITES = tuple(f"{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))

BITS_PER_KEY, HASHES = 10, 4
#: Bits of the filters that a plan carries at once: 8 MB.
MAX_BITS = 1 << 26
#: The hash that deals keys to shards is none of those of the levels.
SHARD_SEED = -1


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    words: tuple[int, ...]

    def contains(self, key: Column, words: Column) -> Column:
        found = F.lit(True)
        for p in positions(key, self.number, self.bits):
            found = found & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)
        return found

    def literal(self) -> Column:
        """One foldable expression; the optimizer turns it into an array literal."""
        return F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")


@dataclass(frozen=True)
class Cascade:
    """Levels of the keys of a list that fall to one of ``shards`` shards."""

    levels: list[Level] = field(default_factory=list)
    shard: int = 0
    shards: int = 1

    @property
    def bits(self) -> int:
        return sum(level.bits for level in self.levels)

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed and falls to this shard: exact, without a join."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            verdict = F.when(~level.contains(key, level.literal()), F.lit(level.number % 2 == 1)).otherwise(verdict)
        return verdict if self.shards == 1 else (shard_of(key, self.shards) == self.shard) & verdict


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(SHARD_SEED)), F.lit(shards))


def positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


def build_level(keys: DataFrame, number: int, n: int) -> Level:
    """Sets the bits of all keys.  What reaches the driver is the filter alone, bits / 64 numbers at most."""
    bits = -(-max(n * BITS_PER_KEY, 64) // 64) * 64
    rows = (
        keys.select(F.explode(F.array_distinct(F.array(*positions(F.col("key"), number, bits)))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        .collect()
    )
    words = [0] * (bits // 64)
    for r in rows:
        words[r.word] = r.bits
    return Level(number, bits, tuple(words))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """``listed`` and ``universe`` have one column ``key``; the universe holds every key that will be asked for.

    The keys left at each level are a falling share of both sides.  They are cut from the lineage in the shared
    folder.  ``listed`` has its keys once and without nulls.
    """
    levels: list[Level] = []
    inside, outside = listed, None
    n = listed.count()
    while n:
        level = build_level(inside, len(levels), n)
        levels.append(level)
        if outside is None:  # the first time, the universe is read once, and only what the filter accepts goes on
            passed = universe.where("key is not null").where(level.contains(F.col("key"), level.literal())).distinct().join(listed, "key", "left_anti")
        else:
            passed = outside.where(level.contains(F.col("key"), level.literal()))
        before, outside, inside = outside, inside, materialize(passed, f"level{len(levels)}")
        if before is not None and before is not listed:
            release(before)
        n = inside.count()
    release(*[t for t in (outside, inside) if t is not listed])  # the levels are all that is left to read
    return Cascade(levels)


def build_cascades(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> list[Cascade]:
    """A cascade for every shard of the list; shards are as many as keep a shard's first filter within ``max_bits``."""
    listed = materialize(listed.where("key is not null").distinct(), "listed")
    shards = max(1, -(-listed.count() * BITS_PER_KEY // max(max_bits // 2, 64)))
    mine = lambda df, s: df.where(shard_of(F.col("key"), shards) == s) if shards > 1 else df
    out = [Cascade(build_cascade(mine(listed, s), mine(universe, s)).levels, s, shards) for s in range(shards)]
    release(listed)
    return out


def lots(cascades: Sequence[tuple[str, Cascade]], max_bits: int) -> list[list[tuple[str, Cascade]]]:
    """(name, cascade) pairs in lots of ``max_bits`` bits together, or of one."""
    out: list[list[tuple[str, Cascade]]] = [[]]
    for name, c in cascades:
        if out[-1] and sum(x.bits for _, x in out[-1]) + c.bits > max_bits:
            out.append([])
        out[-1].append((name, c))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_suffixes(host: Column) -> Column:
    """The host, its parent domain and so on, longest first."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def rule_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every rule (suffix of the host and prefix of the path) that could fit, the longest first."""
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    every = F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    pairs = F.transform(every, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key")))
    return F.transform(F.sort_array(pairs), lambda s: s["key"])


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    sites: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per page: id, host, path, the longest fitting rule and the verdict.

    ``rules`` has verdict (allow or block), host and path; ``sites`` has site, blocked with all subdomains where no
    rule fits.  The number of distinct rule path lengths is bounded by the longest path, not by the corpus.
    """
    keyed_rules = rules.select("verdict", F.concat("host", "path").alias("key"), F.length("path").alias("n"))
    lengths = sorted((r.n for r in keyed_rules.select("n").distinct().collect()), reverse=True)
    parsed = materialize(pages.select(F.col(id_col).alias("page_id"), *[c.alias(n) for c, n in zip(host_and_path(F.col(url_col)), ("host", "path"))]), "parsed")
    universe_rules = parsed.select(F.explode(rule_keys(F.col("host"), F.col("path"), lengths)).alias("key"))
    universe_sites = parsed.select("host").distinct().select(F.explode(host_suffixes(F.col("host"))).alias("key"))
    allow = build_cascades(keyed_rules.where("verdict = 'allow'").select("key"), universe_rules, max_bits)
    block = build_cascades(keyed_rules.where("verdict = 'block'").select("key"), universe_rules, max_bits)
    sited = build_cascades(sites.select(F.col("site").alias("key")), universe_sites, max_bits)
    both = [(name, c) for name, cs in (("allow", allow), ("block", block), ("site", sited)) for c in cs]

    keys = rule_keys(F.col("host"), F.col("path"), lengths)
    found = parsed.withColumns({"rule": F.lit(None).cast("string"), "v": F.lit(None).cast("string"), "site": F.lit(False)})
    parts = lots(both, max_bits)
    for k, lot in enumerate(parts):
        named = [(name, [c for n, c in lot if n == name]) for name in ("allow", "block", "site")]
        any_of = lambda cs, key: reduce(Column.__or__, [c.contains(key) for c in cs], F.lit(False))
        ruled = [c for name, cs in named[:2] for c in cs]
        if ruled:
            first = F.get(F.filter(keys, lambda x: any_of(ruled, x)), F.lit(0))
            found = found.withColumn("key", first).withColumn("longer", F.coalesce(F.length("key"), F.lit(-1)) > F.coalesce(F.length("rule"), F.lit(-1)))
            verdict = F.when(any_of(named[0][1], F.col("key")), "allow").otherwise("block")
            found = found.withColumn("v", F.when(F.col("longer"), verdict).otherwise(F.col("v"))).withColumn("rule", F.when(F.col("longer"), F.col("key")).otherwise(F.col("rule"))).drop("key", "longer")
        if named[2][1]:
            found = found.withColumn("site", F.col("site") | F.exists(host_suffixes(F.col("host")), lambda x: any_of(named[2][1], x)))
        if k + 1 < len(parts):
            found = materialize(found, f"found{k}")
    return found.select("page_id", "host", "path", "rule", F.coalesce("v", F.when(F.col("site"), "block").otherwise("allow")).alias("verdict"))


def inline(spark: SparkSession, columns: str, rows: Sequence[tuple[str, ...]]) -> DataFrame:
    """A few rows of strings as literals of the plan."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t({columns})")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, sites = inline(spark, "verdict, host, path", BASE_RULES), inline(spark, "site", [(x,) for x in LISTED_SITES])
    return filter_urls(table(spark, sf_dir, "pages"), rules, sites)


ORACLE = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest
), parsed AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM cut
), rules(verdict, rh, rp) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in BASE_RULES)}
), sites(site) AS (VALUES {", ".join(f"('{s}')" for s in LISTED_SITES)}
), fits AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS v
  FROM parsed JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
), listed AS (
  SELECT DISTINCT page_id FROM parsed JOIN sites ON host = site OR ends_with(host, '.' || site)
)
SELECT p.page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN l.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM parsed p LEFT JOIN fits f ON p.page_id = f.page_id LEFT JOIN listed l ON p.page_id = l.page_id
"""
