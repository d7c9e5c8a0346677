"""Counts per state, with an optional grand total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: label of the grand-total row.
TOTAL_LABEL = "TOTAL BRASIL"


def count_by_uf(
    df: DataFrame, uf: Column, out: str, distinct: str | None = None, total_row: bool = False
) -> DataFrame:
    """Rows per state label, or distinct values of ``distinct`` per state label.

    With ``total_row`` a grand total is added, 0 when there are no rows at all. Row counts are added up
    from the state counts (a few dozen rows); distinct counts need a rollup because a value may occur in
    several states.
    """
    labelled = df.withColumn("UF", uf)
    measure = F.count(F.lit(1)) if distinct is None else F.count_distinct(distinct)
    if not total_row:
        return labelled.groupBy("UF").agg(measure.alias(out))

    zero = df.sparkSession.range(1).select(F.lit(TOTAL_LABEL).alias("UF"), F.lit(0).cast("bigint").alias(out))
    if distinct is None:
        states = labelled.groupBy("UF").agg(measure.alias(out))
        parts = states.select(F.explode(F.array("UF", F.lit(TOTAL_LABEL))).alias("UF"), out)
    else:
        parts = (
            labelled.rollup("UF")
            .agg(measure.alias(out), F.grouping("UF").alias("_all"))
            .select(F.when(F.col("_all") == 1, TOTAL_LABEL).otherwise(F.col("UF")).alias("UF"), out)
        )
    return parts.unionByName(zero).groupBy("UF").agg(F.sum(out).alias(out))
