"""The pipeline's stages, each on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lorekeep.llm import decontaminate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(1) for c in ("component", "n_dropped", "n_lines", "kept_text", "lang_pred", "score", "row", "letters", "__keep", "__letters", "size", "h1")})


def test_mixing_takes_odd_rows(spark, docs):
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    assert cp.mixing_stage(spark, docs.unionByName(odd), SF).count() == docs.count() + 5
    assert cp.mixing_stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name,stage", cp.STAGES[:-1])
def test_stage_keeps_columns_and_takes_odd_rows(spark, docs, name, stage):
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    out = stage(spark, docs.unionByName(odd), SF)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count() + 5
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_whole_run(spark):
    out = cp.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < out.count() < n
    held = spark.read.parquet(f"{SF}/documents.parquet").join(out.select("doc_id"), "doc_id", "left_semi")
    assert decontaminate.contaminated(held.select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def test_near_copies_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(5, text), (3, text), (9, text.replace("w7 ", "x ")), (1, "another text altogether " * 5)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in cp.near_duplicate_stage(spark, df, SF).collect()) == [1, 3]
