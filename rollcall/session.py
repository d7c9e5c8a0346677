"""Session settings the jobs rely on, and the shared folder for lineage cuts."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Keys that a lookup writes into a scan as literals at most.
MAX_LITERAL_KEYS = 50

# Skewed join partitions are split at run time. The "force" flag lets Spark split them also where the
# join's partitioning is reused further up; it then adds one shuffle, and only when skew was measured.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A list of looked-up keys is tested one by one against a row group's Bloom filter, not only as a range.
    "spark.sql.parquet.pushdown.inFilterThreshold": str(MAX_LITERAL_KEYS),
}


def tune(spark: SparkSession) -> SparkSession:
    """Switch on adaptive execution with skew splitting, and key lookups in scans, for this session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a private one is made only for local sessions without any."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="rollcall-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it from there afterwards.

    It survives the loss of executors. Unlike a checkpointed plan, the table has real statistics and
    columns of its own, so Spark sees how small it is and reads only the columns a join needs. Rows are
    rebalanced first: many scan tasks with few matches each would otherwise leave as many small files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/settled-{uuid4().hex}"
    df.hint("rebalance").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
