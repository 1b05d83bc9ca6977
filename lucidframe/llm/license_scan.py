"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of as many words as the template has that crosses line breaks, so that wrapped notices
are found.  It meets a template if it contains at least ``percent`` of the template's distinct words.  All sets share
one order, rare words first, by the frequency of the templates' words in the whole corpus.  A block that meets a
template T with o = ceil(percent |T|) words in common shares a word of T's first |T| - o + 1 and its own first
|B| - o + 1 words (prefix filter), has o words of the vocabulary at least (length filter), and at each shared word
enough words must be left on both sides (positional filter); what passes is counted exactly.  A document has windows
only for templates that it meets as one block; they slide over the places of the template's words.

Templates, their words and the frequencies are bounded by the templates alone and go to every task; the corpus is
scanned twice and never shuffled.  Fixed base phrases are found as consecutive words of the whole text.

Defined results: a null or empty text has no words, no places, empty labels and score 0.  Repeated rows are scanned
one by one.  Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidframe.llm.text import alnum_words, narrow, slices, table

PERCENT = 80
#: Phrase: label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: One-line notices and the first sentences of well-known licenses.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,line:long,containment:double>>"


def word_sets(templates: Mapping[str, str]) -> dict[str, frozenset[bytes]]:
    return {label: words for label, text in templates.items() if (words := frozenset(alnum_words(text.encode())))}


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Occurrences of the vocabulary's words in the corpus; a row for each word and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for _, texts in slices(batches):
            for text in texts:
                if text:
                    found.update(filter(vocabulary.__contains__, alnum_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word.encode(): r.n for r in rows}


class TemplateIndex:
    """Prefixes of all templates in the corpus's order."""

    def __init__(self, sets: Mapping[str, frozenset[bytes]], frequency: Mapping[bytes, int], percent: int = PERCENT):
        every = sorted(frozenset().union(*sets.values()), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(every)}
        self.sets, self.need, self.lists = sets, {}, {}
        for label, words in sorted(sets.items()):
            self.need[label] = need = -(-percent * len(words) // 100)
            for i, w in enumerate(sorted(words, key=self.rank.__getitem__)[: len(words) - need + 1]):
                self.lists.setdefault(w, []).append((label, i))
        self.prefix = frozenset(self.lists)
        self.least = min(self.need.values(), default=0)

    def match(self, block: list[bytes]) -> list[tuple[str, float]]:
        """Templates that this block meets, with the share of their words that it has."""
        own = sorted({w for w in block if w in self.rank}, key=self.rank.__getitem__)
        n = len(own)
        if n < self.least:
            return []
        shared: dict[str, int] = {}
        for j, w in enumerate(own[: n - self.least + 1]):
            for label, i in self.lists.get(w, ()):
                need = self.need[label]
                if n < need or j > n - need:
                    continue
                before = shared.get(label, 0)
                if before >= 0:  # positions left on both sides decide
                    enough = before + 1 + min(len(self.sets[label]) - i - 1, n - j - 1) >= need
                    shared[label] = before + 1 if enough else -1
        held = frozenset(own)
        out = []
        for label, seen in sorted(shared.items()):
            if seen > 0 and (same := len(held & self.sets[label])) >= self.need[label]:
                out.append((label, same / len(self.sets[label])))
        return out


def wrapped(words: list[bytes], template: frozenset[bytes], length: int, need: int, line_of: Sequence[int]) -> list[tuple[int, float]]:
    """(line, containment) of the best window of ``length`` words in each run of overlapping ones with ``need`` words of
    the template, where no single line holds that window's words."""
    hits = [i for i, w in enumerate(words) if w in template]
    held: Counter = Counter()
    out: list[tuple[int, float]] = []
    best, last, a = (0, 0, 0), -1, 0  # distinct words, first and last hit of the window

    def close() -> None:
        if best[0] and line_of[best[1]] != line_of[best[2]]:
            out.append((line_of[best[1]], best[0] / len(template)))

    for i in hits:
        held[words[i]] += 1
        while hits[a] <= i - length:
            held[words[hits[a]]] -= 1
            if not held[words[hits[a]]]:
                del held[words[hits[a]]]
            a += 1
        if len(held) >= need:
            if hits[a] > last:
                close()
                best = (0, 0, 0)
            last = i
            if len(held) > best[0]:
                best = (len(held), hits[a], i)
    close()
    return out


def base_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    found = []
    for phrase, label in phrases:
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(phrase)] == phrase:
                found.append((at, label))
    return found


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, base: Mapping[str, str] = BASE, percent: int = PERCENT) -> DataFrame:
    """One row per document; ``matches`` lists the lines that meet a template, and the first lines
    of wrapped notices.

    ``score`` is the largest containment found, and 1 where a base phrase, a template of its own, is complete.
    """
    docs = narrow(df, id_col, text_col)
    sets = word_sets(templates)
    index = TemplateIndex(sets, word_frequencies(docs, frozenset().union(*sets.values())), percent)
    lengths = {label: len(alnum_words(templates[label].encode())) for label in sets}
    phrases = [(alnum_words(p.encode()), label) for p, label in base.items()]
    watched = index.prefix | {p[0] for p, _ in phrases}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("line", pa.int64()), ("containment", pa.float64())])))
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        for ids, texts in slices(batches):
            rows = []
            for doc_id, text in zip(ids, texts):
                words = alnum_words(text)
                if watched.isdisjoint(words):
                    rows.append((doc_id, len(words), 0, None, None, "", "", 0.0, []))
                    continue
                places = base_places(words, phrases)
                matches = []
                for k, line in enumerate(text.split(b"\n")):
                    own = alnum_words(line)
                    if not index.prefix.isdisjoint(own):
                        matches += [{"label": label, "line": k, "containment": c} for label, c in index.match(own)]
                if b"\n" in text and (whole := index.match(words)):
                    line_of = [k for k, line in enumerate(text.split(b"\n")) for _ in alnum_words(line)]
                    for label, _ in whole:
                        matches += [{"label": label, "line": k, "containment": c} for k, c in wrapped(words, sets[label], lengths[label], index.need[label], line_of)]
                based = {label for _, label in places}
                score = 1.0 if places else max((m["containment"] for m in matches), default=0.0)
                starts = [p for p, _ in places]
                rows.append((doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(based)), ",".join(sorted(based | {m["label"] for m in matches})), score, matches))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names)

    return docs.mapInArrow(scan, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SETS = ", ".join(f"('{label}', ['" + "', '".join(sorted(w.decode() for w in words)) + "'])" for label, words in sorted(word_sets(TEMPLATES).items()))
_PHRASES = ", ".join("(['" + "', '".join(p.split()) + f"'], '{label}')" for p, label in BASE.items())
ORACLE = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), templates(label, words) AS (VALUES {_SETS}
), phrases(p, label) AS (VALUES {_PHRASES}
), places AS (
  SELECT doc_id, i - 1 AS pos, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x JOIN phrases ON x.w[i] = p[1] AND x.w[i : i + len(p) - 1] = p
), lines AS (SELECT doc_id, list_distinct(regexp_extract_all(l, '{_WORD}')) AS b FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
), met AS (
  SELECT doc_id, label, c FROM (SELECT doc_id, label, len(words) AS n, len(list_intersect(b, words)) AS k, len(list_intersect(b, words)) / len(words) AS c FROM lines, templates) WHERE 100 * k >= {PERCENT} * n
), based AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM places GROUP BY doc_id
), every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS s, max(c) AS c FROM (SELECT doc_id, label, c FROM met UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(based.n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
  coalesce(based.s, '') AS base_labels, coalesce(every.s, '') AS labels, CAST(coalesce(every.c, 0) AS DOUBLE) AS score
FROM d LEFT JOIN based USING (doc_id) LEFT JOIN every USING (doc_id)
"""
