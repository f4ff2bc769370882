import zlib

import numpy as np
from corpus import SCHEMA, frame, texts

import corpus_pipeline
from palimpsest.llm import ngram_join

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_their_decisions_take_effect(spark):
    sf = "/root/testdata/sf0.01"  # enough labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frames[-1], sf)
        assert out.columns == columns
        rows = out.collect()
        frames.append(spark.createDataFrame(rows, docs.schema) if rows else out)
    ids = [sorted(r.doc_id for r in f.collect()) for f in frames]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = set(ids[0]) - set(ids[1])
    assert gone and sum(labels.get(i, 0) for i in gone) <= 2
    assert set(ids[2]) == {r.doc_id for r in ngram_join.link(frames[1], 5, 80).collect() if r.doc_id == r.component_id}
    assert set(ids[3]) <= set(ids[2]) and set(ids[4]) <= set(ids[3])
    last = corpus_pipeline.STAGES[-1][1](spark, frames[-1], sf).collect()
    assert sorted(r.doc_id for r in last) == ids[4]


def test_run_over_all_stages(spark):
    got = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def test_stages_on_awkward_rows(spark):
    docs = frame(spark, texts(7)).select("doc_id", "text", "lang", "source", "n_chars", "node", "score")
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, SF)
            assert out.count() >= 0
            assert name == "token_output" or out.columns == d.columns
    assert zlib.crc32(np.array([2], "<u4").tobytes()) in {r.ids_crc32 for r in corpus_pipeline.token_output(spark, docs, SF).collect()}
    assert SCHEMA.names[0] == "doc_id"
