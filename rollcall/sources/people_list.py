"""The caller's list of names and tax ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.cpf import clean_cpf, cpf_problem
from rollcall.schemas import PEOPLE_LIST, conform


def people_list(df: DataFrame, seen: Observation | None = None) -> DataFrame:
    """NOME, CPF_RAW and the cleaned number CPF_NUM. Rows without a usable tax id stay, with a NULL number.

    ``seen`` counts, in the pass that first reads the list, its ``rows`` and those that are ``empty``,
    ``not_digits`` or ``too_long``.
    """
    people = conform(df, PEOPLE_LIST, "people list").withColumn("CPF_NUM", clean_cpf(F.col("CPF_RAW")))
    if seen is None:
        return people
    problem = cpf_problem(F.col("CPF_RAW"))
    counts = [F.count_if(problem == p).alias(p.lower().replace(" ", "_")) for p in ("EMPTY", "NOT DIGITS", "TOO LONG")]
    return people.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)


def rejected(people: DataFrame) -> DataFrame:
    """The rows of a ``people_list`` without a usable tax id, with the reason in PROBLEMA."""
    return people.where(F.col("CPF_NUM").isNull()).select("NOME", "CPF_RAW", cpf_problem(F.col("CPF_RAW")).alias("PROBLEMA"))


def read_people_list(
    spark: SparkSession, path: str, fmt: str = "csv", seen: Observation | None = None, **options: str
) -> DataFrame:
    """Read a list from CSV (with a header) or Parquet; other columns are ignored."""
    reader = spark.read.options(**options)
    if fmt == "csv":
        # Without inference every column is text, which keeps leading zeros of the tax ids.
        return people_list(reader.option("header", "true").csv(path), seen)
    return people_list(reader.format(fmt).load(path), seen)
