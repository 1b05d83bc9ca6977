"""The pipeline against what its stages must do, and the queries that have SQL."""

import os

import pandas as pd
import pytest

import corpus_pipeline
from lucidframe.llm import decontaminate, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    text = lambda d: d[sorted(d.columns)].map(lambda v: "" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)).sort_values(sorted(d.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(text(a), text(b))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
        if k < 4:
            assert docs.columns == columns
    quality, unique, clean, _, packed = seen
    first = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert quality.count() < first.count() and quality.join(labels, "doc_id").where("quality = 1").count() >= 0.95 * labels.where("quality = 1").count()
    from lucidframe.llm.ngram_join import ngram_components

    groups = ngram_components(quality).groupBy("component_id").count()
    assert unique.count() == groups.count() and unique.join(groups, unique["doc_id"] == groups["component_id"]).count() == unique.count()
    assert decontaminate.find_phrases(clean, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("size(items) > 0").count() == 0
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in clean.select("doc_id").collect()}


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", None, None, 5), (3, "x " * 30_000, "en", "s", 60_000)], "doc_id long, text string, lang string, source string, n_chars long")
    for case in (docs, docs.limit(0)):
        got = case
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, got, DATA)
        got.count()


def test_near_duplicates_judges_rows(spark):
    """Rows with one id and different texts all stay, unless linked with another that stays; so do null ids."""
    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    rows = [(1, text[0]), (2, text[0] + " z"), (2, text[1]), (3, text[2]), (3, text[3]), (3, text[3]), (4, text[3] + " z"), (None, text[2] + " z"), (None, text[4]), (None, text[4] + " z"), (None, text[5]), (5, ""), (5, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id or 0), (r.text or "").removesuffix(" z")) for r in got.collect())
    assert kept == sorted([(1, text[0]), (2, text[1]), (3, text[2]), (3, text[3]), (0, text[4]), (0, text[5]), (5, ""), (0, "")])


def test_stages_by_brute_force(spark, tmp_path):
    """Every stage on its own input, against plain code that looks at all pairs, all windows and all spans."""
    import random
    import re

    from lucidframe.llm import personal_data
    from lucidframe.llm.tokens import Encoder
    from test_operators import brute_components, brute_search

    r = random.Random(23)
    word = lambda: "".join(r.choice(("la", "ver", "th", "ing", "éa", "so")) for _ in range(r.randint(1, 4)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n)) + "."
    items = [(i, " ".join(word() for _ in range(14))) for i in range(6)]
    texts = [prose(r.randint(3, 12)) for _ in range(40)]
    texts += [t + " " + word() for t in texts[:6]] + [texts[0], texts[1]]
    texts += [f"{prose(4)} {t}, {prose(3)}" for _, t in items[:3]] + [items[3][1].upper(), items[4][1] + "\n\n"]
    texts += [f"{prose(3)} Mail a.b@c.example.com or +1 (555) 555-1234 from 10.0.0.1, {prose(2)}" for _ in range(4)]
    texts += [(" " + word()) * 30 + " BUY!! NOW!! ***" * 20 for _ in range(5)] + ["", None, " \n"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(not 61 <= i < 66)) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(docs.collect())
    text_of = lambda k: {x.doc_id: x.text for x in seen[k]}
    assert all(texts[i] == t for i, t in text_of(0).items())

    ids = sorted(text_of(0))
    _, comp = brute_components([text_of(0)[i] for i in ids])
    assert text_of(1) == {i: text_of(0)[i] for k, i in enumerate(ids) if comp[k] == k}

    cut = {}
    for i, t in text_of(1).items():
        had = bool(t and t.strip(" \t\n\v\f\r"))
        while t and (hit := brute_search(t, items)[1]):  # words are cut with what stands between them, until none is left
            places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)]
            for a, b in reversed(decontaminate.merge_spans((h, h + 1) for h in hit)):
                t = t[: places[a][0]] + t[places[b - 1][1] :]
        if not had or t.strip(" \t\n\v\f\r"):
            cut[i] = t
    assert text_of(2) == cut and any(text_of(1)[i] != t for i, t in cut.items()) and len(cut) < len(text_of(1))

    tagger = personal_data.Tagger(personal_data.train_field(personal_data.training_table()))
    for i, t in text_of(3).items():
        (_, spans), = personal_data.all_spans([(cut[i] or "").encode()], tagger)
        want, at = "", 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
            if a >= at:
                want, at = want + cut[i][at:a] + f"[{kind.upper()}]", b
        assert t == (want + (cut[i] or "")[at:] if cut[i] is not None else None)
        assert not t or not personal_data.base_spans(t)
    assert sum("[EMAIL]" in (t or "") for t in text_of(3).values()) >= 3 and text_of(3).keys() == cut.keys()

    own, packed = Encoder(), {}
    for x in seen[4]:
        packed.setdefault(x.doc_id, []).append((x.piece, x.start, x.length))
    for i, t in text_of(3).items():
        n = len(own.whole.encode(t or "", add_special_tokens=False).ids) + 1
        assert sorted(packed[i]) == [(k, a, min(2048, n - a)) for k, a in enumerate(range(0, n, 2048))]
