"""Joins that stay balanced when a key repeats very often or is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.skew import frequent_keys, pieces

_SALT = "_salt"


def attach(rows: DataFrame, table: DataFrame, key: str, table_key: str) -> DataFrame:
    """Left join to a table that may hold one key many times; ``table_key`` is dropped.

    Spark cannot split a hot key on the right of a left join. So the rows of ``table`` with a frequent key are dealt
    over pieces, as a sketch of the key column tells, and the rows of ``rows`` with that key are repeated in every
    piece. Such a key has a match for certain, so a repeated row that meets none in its piece is one too many. Rows with
    a NULL key match nothing and are spread over all pieces. One join, whatever the keys.
    """
    n = pieces(rows)
    frequent = frequent_keys(table, table_key).scalar()
    dealt_over = F.coalesce(F.element_at(frequent, F.col(table_key)), F.lit(1).cast("long"))
    met_in = F.coalesce(F.element_at(frequent, F.col(key)), F.lit(1).cast("long"))
    mine = F.xxhash64(F.spark_partition_id(), *table.columns[:4])
    dealt = table.where(F.col(table_key).isNotNull()).withColumn(_SALT, F.pmod(mine, dealt_over))
    own = F.pmod(F.xxhash64(F.spark_partition_id(), *rows.columns[:4]), F.lit(n))
    salts = F.when(F.col(key).isNull(), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), met_in - 1))
    repeated = rows.withColumn(_SALT, F.explode(salts)).withColumn("_pieces", met_in)
    joined = repeated.join(dealt, (F.col(key) == F.col(table_key)) & (repeated[_SALT] == dealt[_SALT]), "left")
    whole = joined.where((F.col("_pieces") == 1) | F.col(table_key).isNotNull())
    return whole.drop(repeated[_SALT], dealt[_SALT]).drop("_pieces", table_key)
