"""Odd rows and clashing columns through every stage of the pipeline."""

from pyspark.sql import functions as F

import corpus_pipeline
from quietlog.llm.common import table
from quietlog.session import scratch

SF = "/root/testdata/sf0.001"
CLASHING = ("node", "label", "block_id", "payload", "kind", "bucket", "guest", "spans", "first", "sequence_id", "offset", "score")


def through(spark, docs):
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = scratch(spark, name)
        out.write.parquet(path)
        read = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert read.columns == docs.columns
        docs = steps[name] = read
    return steps


def test_odd_rows_pass_all_stages(spark):
    docs = table(spark, SF, "documents")
    long = docs.orderBy(F.desc(F.length("text"))).first()
    one = docs.where("text is not null and lang is not null").orderBy("doc_id").first()
    odd = [(None, one.text + " x", one.lang, "s", None), (9_000_001, None, "en", None, None), (9_000_002, "", None, "s", 0), (9_000_003, " \n1 2 3", "en", "s", 7),
           (9_000_004, " ".join([long.text] * 30), long.lang, "s", 1), (9_000_005, one.text, one.lang, "s", 1), (9_000_005, one.text, one.lang, "s", 1), (9_000_006, "漢😀" * 400, None, "s", 800)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit(c) for c in CLASHING})
    steps = through(spark, rows)
    ids = {name: {r.doc_id for r in df.select("doc_id").distinct().collect()} for name, df in steps.items()}
    assert not ids["language_id"] & {9_000_001, 9_000_002, 9_000_003}  # no letters
    assert {9_000_004, 9_000_005, None} <= ids["language_id"]
    assert not ids["near_dups"] & {9_000_004, 9_000_005}  # the words of earlier documents
    assert ids["suffix_dedup"] == ids["near_dups"] == ids["pii"] == ids["packing"]
    kept = {r.doc_id: r for r in steps["suffix_dedup"].collect()}
    before = {r.doc_id: r.text for r in steps["near_dups"].collect()}
    assert all(r.text == before[d] or r.n_chars == len(r.text) for d, r in kept.items())
    assert all(kept[d][c] == c for d in list(kept)[:5] for c in CLASHING)


def test_tables_that_teach_nothing_or_are_empty(spark):
    docs = table(spark, SF, "documents")
    for rows in (docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string"))):
        assert {name: df.count() for name, df in through(spark, rows).items()} == dict.fromkeys([n for n, _ in corpus_pipeline.STAGES], 0)
