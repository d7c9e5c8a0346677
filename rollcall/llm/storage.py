"""Intermediate tables in the folder that driver and executors share, and stable row numbers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 4 << 20
# Bytes of a row group of the tables written. A task holds one of each file it reads and one of the file it writes, on
# the heap and whole, and a file is split between row groups only.
ROW_GROUP_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without it gets a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there: lineage is cut, loss is survived."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(columns: list[str], name: str) -> str:
    """``name``, or the first of name_2, name_3, ... that is not a column yet."""
    taken, n = {c.lower() for c in columns}, 1
    while (found := name if n == 1 else f"{name}_{n}").lower() in taken:
        n += 1
    return found


def clear_of(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with room for columns ``names``: columns that have such a name already get ``_input`` added to it."""
    wanted, columns = {n.lower() for n in names}, list(df.columns)
    for i, c in enumerate(columns):
        if c.lower() in wanted:
            columns[i] = spare([*columns, *names], f"{c}_input")
    return df.toDF(*columns) if columns != df.columns else df


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """A row number that every read agrees on; it tells repeated rows apart. ``name`` must be a new column's.

    Rows of Parquet files are numbered by their place in their file, which no split of the files changes. Any other
    frame is stored once with its numbers, and read from there.
    """
    if name in df.columns:
        raise ValueError(f"column {name} is reserved")
    if not _scans_parquet(df):
        return settle(df.withColumn(name, F.monotonically_increasing_id()))
    file, ordinal = spare(df.columns, f"{name}_file"), spare(df.columns, f"{name}_ordinal")
    placed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(name))
    files = sorted(r[0] for r in placed.select(file).distinct().collect())
    ordinals = df.sparkSession.createDataFrame(list(enumerate(files)), f"{ordinal} long, {file} string")
    number = F.shiftleft(F.col(ordinal), 40) + F.col(name)
    return placed.join(F.broadcast(ordinals), file).select(*df.columns, number.alias(name))


def _scans_parquet(df: DataFrame) -> bool:
    """Whether ``df`` is rows of Parquet files, at most filtered or with other columns."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.simpleString(1).lower().split() and "_metadata" not in df.columns


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python on the executors import this package where it is neither installed nor on their path, and read, hand
    over and write whole texts in small batches and row groups: the default of 10,000 rows holds tens of MB on both
    sides of every task, and row groups of 128 MB hundreds. They hold for what the session writes from then on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", ROWS_PER_BATCH)
    spark.conf.set("parquet.block.size", ROW_GROUP_BYTES)
    root = Path(__file__).resolve().parents[2]
    paths = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if root in paths or getattr(spark.sparkContext, "_rollcall_shipped", False) or "site-packages" in root.parts:
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='rollcall-')}/rollcall", "zip", root, "rollcall")
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._rollcall_shipped = True
