"""Distribution of persons over the time since their last update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bucket names and their closed bounds in months.
BUCKETS: tuple[tuple[str, int, int | None], ...] = (
    ("QT_0_A_6_MESES", 0, 6),
    ("QT_7_A_12_MESES", 7, 12),
    ("QT_13_A_18_MESES", 13, 18),
    ("QT_19_A_24_MESES", 19, 24),
    ("QT_MAIOR_OU_IGUAL_25_MESES", 25, None),
)
UNDATED = "QT_DT_ATUAL_NULO"


def recency_buckets(
    df: DataFrame, months: Column, by: Sequence[str | Column], total: str = "QT_TOTAL_PESSOAS_UF"
) -> DataFrame:
    """Rows per group in total, per bucket of months and without a date.

    Updates later than the reference month (negative months) are in the total and in no bucket.
    """

    def tally(test: Column) -> Column:
        return F.sum(F.when(test, 1).otherwise(0))

    buckets = [
        tally(months >= lo if hi is None else months.between(lo, hi)).alias(name) for name, lo, hi in BUCKETS
    ]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias(total), *buckets, tally(months.isNull()).alias(UNDATED)
    )
