"""One current record per tax id.

``row_number() <= 1`` is pushed below the shuffle by Spark as a group limit: each task sends at most one
row per tax id, so a tax id shared by a large part of the rows does not overload the task it lands on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def member_recency(person_update: str, family_update: str, person: str, family: str) -> list[Column]:
    """Latest member update, then latest family update, then smallest person and family keys."""
    return [
        F.col(person_update).desc_nulls_last(),
        F.col(family_update).desc_nulls_last(),
        F.col(person).asc_nulls_first(),
        F.col(family).asc_nulls_first(),
    ]


def family_recency(family_update: str, person: str, family: str) -> list[Column]:
    """Latest family update, then smallest person and family keys."""
    return [
        F.col(family_update).desc_nulls_last(),
        F.col(person).asc_nulls_first(),
        F.col(family).asc_nulls_first(),
    ]


def current_by_cpf(df: DataFrame, order: Sequence[Column], key: str | Column = "CPF") -> DataFrame:
    """Keep the first row of each tax id under ``order``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= 1).drop("_rn")


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest in column order, NULLs first. Settles ties among repeated rows."""
    rest = [c for c in df.columns if c != key]
    smallest = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return smallest.select(key, "_row.*")
