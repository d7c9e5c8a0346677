"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions, and overfull
ranges subdivided.

Rows are ordered by content hash and then identifier, so the copies of a text lie side by side; the first boundaries
fall between hashes, and only a range that holds too much is cut inside one text's copies. With the exact bytes
before each range known, a run of copies goes to the shard in which its middle byte falls. All of it is column
expressions, grouping and windows over one range each.

Defined cases: a null text has no bytes and checksum 0; null or repeated identifiers are rows like any other;
an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm import prefix
from rollcall.llm.storage import clear_of, numbered, spare

# Ranges per shard: the share of a shard by which a range may miss.
RANGES_PER_SHARD = 64
# Beyond this many bytes a range is made smaller still, as far as ``prefix.MAX_RANGES``.
RANGE_BYTES = 2 << 30


def shard_by_size(df: DataFrame, shards: int, size: str, group: str, id_col: str) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1, sizes near equal) and ``slot`` (gapless from 0 in each shard).

    ``group`` is a hash column: its rows stay in one shard as far as the sizes allow. ``df`` is read several
    times, so pass a stored table.
    """
    df = clear_of(df, "shard", "slot")
    row = spare(df.columns, "_row")
    rows = numbered(df, row).select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all"),
        F.col(size).cast("long").alias("size"),
        F.col(group).cast("long").alias("group"),
        F.col(id_col).cast("long").alias("id"),
        F.col(row).alias("row"),
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = min(prefix.MAX_RANGES, max(shards * RANGES_PER_SHARD, total // RANGE_BYTES))
    key = ["group", "id", "row"]
    bounds = prefix.boundaries_of(rows, key, "size", "row", total, ranges, coarse=1) if total else []
    run = prefix.running(rows, key, ["size"], bounds)
    copies = Window.partitionBy("_range", "group")
    start, part = F.min("size_before").over(copies), F.sum("size").over(copies)
    middle = start + part / 2
    placed = run.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("_n").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("all.*", "shard", (F.col("_n") - F.col("first")).alias("slot"))
