"""Joins that stay balanced when one key, or no key at all, holds a large part of the rows.

Adaptive execution splits a hot key only where both join inputs come straight from a shuffle. It does not where one
input was aggregated or joined on the same key before, as distinct family sets are. ``join_salted`` is balanced by
construction instead: a sketch of the frequent keys, part of the same query, tells over how many pieces each of them is
dealt; the rows of the left side take one piece each, the rows of the right side with such a key are repeated in every
piece. All rows go one way, through one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# All rows are thought of as at least so many pieces of equal size, as many more as there are shuffle partitions, but
# not more than the second figure. A key is frequent if it fills FEW pieces, so there are pieces / FEW such keys at most.
PIECES = (1_024, 65_536)
FEW = 4
# Keys the sketch keeps track of for each piece: its error is then less than a piece.
TRACKED = 4
_SALT = "_salt"


def pieces(df: DataFrame) -> int:
    """How many pieces the rows of a query are thought of as."""
    least, most = PIECES
    return min(most, max(least, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def frequent_keys(df: DataFrame, key: str) -> DataFrame:
    """One row with a map from each frequent value of ``key`` to its number of pieces.

    The counts come from a mergeable frequent-items sketch: each task hands on one of bounded size, and only the key
    column is read. It decides how rows are dealt, never which rows are in a result.
    """
    n = pieces(df)
    counted = df.select(F.col(key).alias("k")).agg(
        F.expr(f"approx_top_k(k, {n // FEW}, {n * TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    often = F.filter("top", lambda x: x["item"].isNotNull() & (x["count"] * n > F.col("n") * FEW))
    share = F.transform(often, lambda x: F.struct(x["item"], F.ceil(x["count"] * n / F.col("n"))))
    return counted.select(F.map_from_entries(share).alias("frequent"))


def join_salted(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    counted: DataFrame | None = None,
    vary: Sequence[str] = (),
) -> DataFrame:
    """Equi-join of ``left`` to ``right``, whose keys should not repeat often; ``how`` is inner, left, left_semi or
    left_anti. Rows with a NULL key match nothing; a left or anti join spreads them over all pieces.

    The frequent keys are those of ``counted`` (default: ``left``; a stored table is cheaper where ``left`` is
    derived). A row's piece follows from the task it comes from and its values in ``vary`` (default: the first four
    columns), so a task that runs again deals its rows as before.
    """
    n = pieces(left)
    frequent = frequent_keys(left if counted is None else counted, key).scalar()
    mine = F.coalesce(F.element_at(frequent, F.col(key)), F.lit(1).cast("long"))
    row = F.xxhash64(F.spark_partition_id(), *(vary or left.columns[:4]))
    dealt = left.withColumn(_SALT, F.pmod(row, F.when(F.col(key).isNull(), F.lit(n)).otherwise(mine)))
    repeated = right.where(F.col(key).isNotNull()).withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("long"), mine - 1)))
    return dealt.join(repeated, [key, _SALT], how).drop(_SALT)
