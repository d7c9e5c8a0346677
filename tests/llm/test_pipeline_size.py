"""What a task of the pipeline's last two stages holds at once, whatever the number of rows."""

from __future__ import annotations

import glob

import corpus_pipeline
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rollcall.llm import mixing
from rollcall.llm.storage import ROW_GROUP_BYTES, settle


def nodes(plan):
    yield plan
    for child in (plan.children().apply(i) for i in range(plan.children().size())):
        yield from nodes(child)


def test_running_totals_of_the_mix_carry_no_texts(spark):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.col("id") % 50), lambda _: F.lit("word")))
    docs = settle(spark.range(400).select(F.col("id").alias("doc_id"), words.alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source")))
    mixed = mixing.take_mix(docs)
    windows = [n for n in nodes(mixed._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    assert windows
    for window in windows:
        kinds = [window.output().apply(i).dataType().simpleString() for i in range(window.output().size())]
        assert not [k for k in kinds if k.startswith(("struct", "string", "array"))], kinds
    assert mixed.columns == docs.columns
    text = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    got = mixed.collect()
    assert got and all(text[r["doc_id"]] == (r["text"], r["source"]) for r in got)


def test_stages_write_small_row_groups_and_read_them_apart(spark, tmp_path):
    noise = F.concat(*[F.sha2(F.concat(F.col("id"), F.lit(f"-{k}")), 512) for k in range(12)])
    docs = spark.range(0, 40_000, 1, 1).select(F.col("id").alias("doc_id"), noise.alias("text"))
    corpus_pipeline.encoded(spark, spark.createDataFrame([("a",)], "text string"), "")  # sets the session up
    docs.write.parquet(path := str(tmp_path / "docs"))
    (file,) = glob.glob(f"{path}/*.parquet")
    found = pq.ParquetFile(file).metadata
    sizes = [sum(found.row_group(g).column(c).total_compressed_size for c in range(found.num_columns)) for g in range(found.num_row_groups)]
    assert len(sizes) > 2 and max(sizes) < 1.5 * ROW_GROUP_BYTES
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        rows = [r["n"] for r in spark.read.parquet(path).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(rows) == 40_000 and max(rows) < 25_000
