"""Job parameters stored as a relation, one row per job, that reports can join like any other table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.params import Period, Territory

SCHEMA = "JOB string, ANOMES_ODS int, RF_FOLHA_PBF int, RF_FOLHA_PRE int, REF_YM int, UF_CD int, MUN_CD int"


def parameter_rows(spark: SparkSession, jobs: Mapping[str, tuple[Period, Territory | None]]) -> DataFrame:
    """One row for each named job: its months, and its state and municipality, NULL for the whole country or state."""
    rows = [
        (
            name,
            period.anomes_ods,
            period.rf_payroll,
            period.rf_queue,
            period.month.absolute,
            place.uf if place else None,
            place.municipality if place else None,
        )
        for name, (period, place) in jobs.items()
    ]
    return spark.createDataFrame(rows, SCHEMA)


def count_for(parameters: DataFrame, job: str, rows: DataFrame, column: str, parameter: str, count: str) -> DataFrame:
    """The parameter row of ``job`` with the number of ``rows`` whose ``column`` equals its ``parameter``.

    A job has one row, so that row is all that is broadcast; on a partition column the join prunes the scan. A NULL
    parameter equals nothing; an unknown job gives no row.
    """
    one = parameters.where(F.col("JOB") == job).drop("JOB")
    wanted = F.broadcast(one.select(F.col(parameter).alias(column)))
    found = rows.join(wanted, column, "left_semi").agg(F.count(F.lit(1)).alias(count))
    return one.crossJoin(F.broadcast(found))
