"""The pipeline's stages against brute force on the small table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from gridimpact.llm.common import clear_work, table, written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, count = docs.columns, [docs.count()]
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name)
        outs.append(docs)
        count.append(docs.count())
        assert name == "encoding" or docs.columns == columns
    quality, exact, near, mixed, coded = outs
    assert 0.6 * count[0] < count[1] <= count[0]
    texts = [r.text or "" for r in quality.collect()]
    assert sorted(r.text or "" for r in exact.collect()) == sorted(set(texts))

    rows = {r.doc_id: r.text or "" for r in exact.collect()}
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id for r in near.collect()} == {find(i) for i in rows}
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in near.collect()}
    assert coded.count() == mixed.count() and coded.where("n_tokens <> size(ids)").count() == 0


def test_run_and_clear(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    clear_work(spark)


def test_further_columns_come_out_as_they_went_in(spark):
    extra = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("kept", "score", "predicted", "label", "copies", "rate", "node", "_text", "n_tokens", "keep_id", "id")}
    docs = table(spark, DATA, "documents").limit(80).withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA), name)
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)


def test_stages_on_nothing_and_on_nulls(spark):
    schema = table(spark, DATA, "documents").schema
    empty, nulls = spark.createDataFrame([], schema), spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, "", "en", None, 0)], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
        found = stage(spark, nulls, DATA)
        kept = sorted(r.doc_id or 0 for r in found.collect())
        if name == "exact_dedup":  # null and empty are one text, and a null identifier loses
            assert kept == [1]
        elif name == "near_dedup":  # texts without words are linked with nothing
            assert kept == [0, 1, 1]
        elif name == "encoding":
            assert kept == [0, 1, 1] and {r.n_tokens for r in found.collect()} == {0}
        else:
            assert set(kept) <= {0, 1}
