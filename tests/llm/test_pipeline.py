"""The pipeline stage by stage, each against its operator's verdicts on the stage's own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from assayer.llm import quality, simhash
from assayer.scale import stored


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf_dir)))
    _, good, unique, single, mixed, packed = tables
    assert all(t.columns == docs.columns for t in tables[:-1])
    kept = {r.doc_id for r in quality.judge_quality(docs).where("kept").collect()}
    assert {r.doc_id for r in good.select("doc_id").collect()} == kept
    normal = F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")
    assert unique.count() == good.select(normal).distinct().count()
    groups = simhash.near_duplicates(unique)
    assert {r.doc_id for r in single.select("doc_id").collect()} == {r.component_id for r in groups.collect()}
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= {r.doc_id for r in single.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
