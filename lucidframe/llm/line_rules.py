"""Quality rules: line-first cleaning, in DataFrame operations only.

Each line is judged by itself: punctuation rules (symbols or repeated marks hung on the words), navigation rules
(words set apart by bars or arrows) and boilerplate rules (fixed phrases of page furniture).  Failing lines are
removed; a document that loses too large a share of its words is rejected.  Everything is computed inside the row -
arrays and higher-order functions, no explode - so the operator is one scan without any shuffle, whatever the key
distribution, and the largest state is one document.

Defined results: a null or empty text has no words and zero counts; it fails the length rule and isn't kept.
Repeated rows are judged one by one; other columns of the table are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidframe.llm.text import narrow, table

#: Phrases of page furniture, lower case.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "subscribe to our newsletter", "sign up for", "click here", "enable javascript", "skip to content", "back to top", "lorem ipsum", "share this", "read more")
SPACE = r"[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class LineRules:
    """Thresholds, in percent of a line's words; ``max_lost`` in percent of a document's words."""

    symbols: int = 30
    marks: int = 30
    bars: int = 15
    min_bars: int = 3
    max_lost: int = 30
    min_words: int = 50
    max_repeated: int = 50


def line_struct(rules: LineRules) -> str:
    """SQL of one line ``l``: its words and whether it fails."""
    phrases = "|".join(BOILERPLATE)
    return f"""transform(array(named_struct('l', l, 'n', regexp_count(l, '[^\\\\x20\\\\x09-\\\\x0D]+'))), x -> named_struct('n', x.n, 'fails',
      x.n > 0 and (100 * regexp_count(x.l, '[#*$%&<>]+') > {rules.symbols} * x.n
      or 100 * regexp_count(x.l, '[!?]{{2,}}') > {rules.marks} * x.n
      or (regexp_count(x.l, '[|»›>]') >= {rules.min_bars} and 100 * regexp_count(x.l, '[|»›>]') > {rules.bars} * x.n)
      or lower(x.l) rlike '{phrases}')))[0]"""


def line_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None) -> DataFrame:
    """One row per document: counts, base_failed, kept, words in failing lines, and the cleaned text."""
    rules = rules or LineRules()
    words = f"filter(split(t, '{SPACE}'), x -> x != '')"
    grams = "if(size(w) >= 3, transform(sequence(0, size(w) - 3), i -> named_struct('g', xxhash64(w[i], w[i + 1], w[i + 2]), 'i', i)), array())"
    # positions of windows found twice or more: neighbours of equal value in the sorted list
    found = "filter(g, (x, i) -> (i > 0 and g[i - 1].g = x.g) or (i + 1 < size(g) and g[i + 1].g = x.g))"
    covered = "if(size(p) = 0, 0L, cast(3 + aggregate(p, named_struct('s', 0, 'last', p[0]), (a, x) -> named_struct('s', a.s + least(3, x - a.last), 'last', x), a -> a.s) as bigint))"
    repeated = f"transform(array(sort_array({grams})), g -> transform(array(sort_array(transform({found}, x -> x.i))), p -> {covered})[0])[0]"
    per_words = f"""transform(array({words}), w -> named_struct(
      'n_words', cast(size(w) as bigint),
      'word_chars', cast(length(array_join(w, '')) as bigint),
      'n_repeat_words', {repeated}))[0]"""
    per_lines = f"""transform(array(filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')), ls -> named_struct(
      'n_dup_lines', cast(size(ls) - size(array_distinct(ls)) as bigint),
      'lines', transform(ls, l -> named_struct('l', l, 'j', {line_struct(rules)}))))[0]"""
    cleaned = "transform(array(" + per_lines + "), y -> named_struct('n_dup_lines', y.n_dup_lines, 'lost', aggregate(y.lines, 0L, (a, x) -> a + if(x.j.fails, x.j.n, 0)), 'clean', array_join(transform(filter(y.lines, x -> not x.j.fails), x -> x.l), '\\n')))[0]"
    counted = narrow(df, id_col, text_col).selectExpr(
        "doc_id",
        f"transform(array(coalesce(text, '')), t -> named_struct('w', {per_words}, 'l', {cleaned}, 's', cast(regexp_count(t, '[#*$%&|<>]') as bigint)))[0] as f",
    )
    flat = counted.select("doc_id", "f.w.n_words", "f.w.word_chars", F.col("f.s").alias("n_symbols"), "f.l.n_dup_lines", "f.w.n_repeat_words", F.col("f.l.lost").alias("n_lost"), F.col("f.l.clean").alias("clean_text"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeated * F.col("n_words"))
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost") <= rules.max_lost * F.col("n_words")))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, the words lost, and a digest of the cleaned text."""
    judged = line_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost", F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


_R = LineRules()
_W = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM twice, range(0, 3) r(k)) GROUP BY doc_id
), lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d
), judged AS (
  SELECT doc_id, l, k, len(regexp_extract_all(l, '{_W}')) AS n, len(regexp_extract_all(l, '[#*$%&<>]+')) AS s, len(regexp_extract_all(l, '[!?]{{2,}}')) AS m, len(regexp_extract_all(l, '[|»›>]')) AS b FROM lines
), failing AS (
  SELECT *, 100 * s > {_R.symbols} * n OR 100 * m > {_R.marks} * n OR (b >= {_R.min_bars} AND 100 * b > {_R.bars} * n) OR regexp_matches(lower(l), '{"|".join(BOILERPLATE)}') AS fails FROM judged WHERE n > 0
), per AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS dup, coalesce(sum(n) FILTER (fails), 0) AS lost, coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (NOT fails), '') AS clean FROM failing GROUP BY doc_id
), f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost, 0) AS BIGINT) AS n_lost, md5(coalesce(clean, '')) AS clean_md5
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN per ON per.doc_id = d.doc_id
)
SELECT *, (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeated} * n_words) AS base_failed,
  NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeated} * n_words) AND 100 * n_lost <= {_R.max_lost} * n_words AS kept
FROM f
"""
