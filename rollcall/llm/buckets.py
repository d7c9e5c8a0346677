"""Bucket members brought together in blocks of bounded size.

A bucket larger than a block is dealt over several blocks by a hash of its members, and every two blocks meet in a
group of their own, so any two members of a bucket share exactly one group (two blocks) or, within one block, the
group of that block with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """``rows`` plus ``_own`` (the row's block), ``_lo`` and ``_hi`` (the group's blocks). ``rows``: a stored table."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    large = large.select(*keys, F.ceil(F.col("_n") / F.lit(block / 2)).cast("int").alias("_blocks"))
    dealt = rows.join(large, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return met.select("*", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi")).drop("_blocks", "_other")
