"""The corpus pipeline, stage by stage, against what its operators say of the stage's own input."""

import zlib

import numpy as np

import corpus_pipeline
from tests.llm.test_dedup import bag, brute_classes, jaccard
from tests.llm.common import docs_of
from tilegraph.llm import decontam, queries, toxicity
from tilegraph.llm.tokens import Encoder


def test_stages(spark, sf_dir):
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = table("documents")
    columns = docs.columns
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        state[name] = before, docs
        if name != "packing":
            assert docs.columns == columns
    before, after = state["toxicity"]
    rejected = {r["doc_id"] for r in toxicity.score(before, table("labels")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == rejected
    before, after = state["line_dedup"]
    assert before.count() == after.count() and after.where("n_chars <> length(text)").isEmpty()
    before, after = state["minhash_near_dedup"]
    rows = before.orderBy("doc_id").collect()
    bags = [bag(r["text"]) for r in rows]
    classes = brute_classes(len(rows), lambda i, j: min(len(bags[i]), len(bags[j])) > 0 and jaccard(bags[i], bags[j]) >= 0.8)
    assert {r["doc_id"] for r in after.collect()} == {rows[k]["doc_id"] for k in set(classes)}
    before, after = state["benchmark_decontamination"]
    held = {r["doc_id"] for r in decontam.matches(before, table("benchmark")).collect()}
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == held
    before, pieces = state["packing"]
    e = Encoder(queries.TOKENIZER)
    ids = {r["doc_id"]: np.asarray([*e.exact(r["text"] or ""), 1], dtype="<u4") for r in before.collect()}
    rows = pieces.collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows)


def test_run_reads_all(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} and out.count() > 0


def test_stages_take_nulls_and_emptiness(spark, sf_dir):
    rows = docs_of(spark, [None, "", "\n", "word " * 3000, None])
    extra = rows.selectExpr("*", "'x' AS pages", "1 AS term", "2 AS band").union(rows.selectExpr("*", "'x'", "1", "2"))
    for docs in (extra, extra.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            if name != "packing":
                assert docs.columns == extra.columns
