"""Row numbers that do not depend on how a read splits the files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollcall.llm import storage


@pytest.mark.parametrize("stored", [True, False])
def test_two_reads_agree_whatever_the_splits(spark, tmp_path, stored):
    text = F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(str(i))), 256) for i in range(10)]).alias("text")
    spark.range(5000).repartition(4).select("id", text).write.option("parquet.block.size", 65536).parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = storage.numbered(docs.select("id", "text") if stored else docs.distinct())
    before, seen = {n: spark.conf.get(n) for n in ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes") if spark.conf.get(n, None)}, []
    for parts, size in ((1, "128m"), (64, "64k")):
        spark.conf.set("spark.sql.files.minPartitionNum", parts)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        # A filter makes another plan, so that nothing of the first read is used again.
        seen.append({r["id"]: r["_row"] for r in rows.where(F.lit(parts) > 0).select("id", "_row").collect()})
    for n in ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes"):
        spark.conf.set(n, before[n]) if n in before else spark.conf.unset(n)
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 5000
