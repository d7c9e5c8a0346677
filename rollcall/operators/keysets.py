"""Families on the payroll and in the pre-qualification queue, and membership flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.benefits import ACTIVE_SITUATIONS, HELD_SITUATIONS
from rollcall.operators.skew import join_salted

FAMILY_KEY = "CO_FAMILIAR"


def _of_month(view: DataFrame, month: int | None) -> DataFrame:
    return view if month is None else view.where(F.col("RF_FOLHA") == month)


def families_on_payroll(
    payroll: DataFrame, month: int | None, situations: Sequence[str] | None = None
) -> DataFrame:
    """Distinct families paid in a month (``None``: in any month), optionally in given situations.

    Situations are compared trimmed and in upper case; a missing one matches none of them.
    """
    rows = _of_month(payroll, month)
    if situations is not None:
        rows = rows.where(F.trim(F.upper("NO_TIPO_SITIUACAO_BEN")).isin(*situations))
    return rows.select(FAMILY_KEY).distinct()


def families_prequalified(queue: DataFrame, month: int | None) -> DataFrame:
    """Distinct families queued in a month (``None``: in any month)."""
    return _of_month(queue, month).select(FAMILY_KEY).distinct()


def family_benefits(
    payroll: DataFrame,
    queue: DataFrame,
    payroll_month: int | None,
    queue_month: int | None,
    situations: Sequence[str] | None = None,
) -> DataFrame:
    """One row per family seen in either view: ``ON_PAYROLL``, ``IN_QUEUE``.

    Both views are reduced together, so the flags cost one shuffle and one join instead of two each.
    """
    paid = families_on_payroll(payroll, payroll_month, situations)
    queued = families_prequalified(queue, queue_month)
    seen = paid.select(FAMILY_KEY, F.lit(True).alias("ON_PAYROLL"), F.lit(False).alias("IN_QUEUE")).unionByName(
        queued.select(FAMILY_KEY, F.lit(False).alias("ON_PAYROLL"), F.lit(True).alias("IN_QUEUE"))
    )
    return seen.groupBy(FAMILY_KEY).agg(
        F.bool_or("ON_PAYROLL").alias("ON_PAYROLL"), F.bool_or("IN_QUEUE").alias("IN_QUEUE")
    )


def family_situation(payroll: DataFrame, month: int | None) -> DataFrame:
    """One payroll situation per family: active before suspended before blocked before anything else.

    A family may have several payroll rows; picking the situation here keeps them from multiplying the
    person rows and makes the choice repeatable. ``SITUATION`` is the stored text and may be NULL.
    """
    text = F.col("NO_TIPO_SITIUACAO_BEN")
    rank = (
        F.when(text.isNull() | text.isin(*ACTIVE_SITUATIONS), 0)
        .when(text == HELD_SITUATIONS[0], 1)
        .when(text == HELD_SITUATIONS[1], 2)
        .otherwise(3)
    )
    best = _of_month(payroll, month).groupBy(FAMILY_KEY).agg(F.min(F.struct(rank.alias("r"), text.alias("t"))).alias("b"))
    return best.select(FAMILY_KEY, F.col("b.t").alias("SITUATION"))


def has_flag(name: str) -> Column:
    """A flag that came through an outer join: missing means no."""
    return F.coalesce(F.col(name), F.lit(False))


def members_of(df: DataFrame, keys: DataFrame, on: str, key: str = FAMILY_KEY, absent: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``on`` occurs in ``keys[key]``; with ``absent`` those whose ``on`` does not, NULLs included."""
    return join_salted(df, keys.select(F.col(key).alias(on)).distinct(), on, "left_anti" if absent else "left_semi")


def flag_membership(
    df: DataFrame,
    keys: DataFrame,
    on: str,
    key: str = FAMILY_KEY,
    out: str = "FLAG",
    yes: object = "SIM",
    no: object = "NAO",
) -> DataFrame:
    """Add ``out``: ``yes`` where ``df[on]`` occurs in ``keys[key]``, else ``no``. Rows never multiply.

    A value of ``on`` that holds very many rows, or a missing one, is spread over many tasks.
    """
    marked = keys.select(F.col(key).alias(on)).distinct().withColumn("_hit", F.lit(True))
    return (
        join_salted(df, marked, on, "left")
        .withColumn(out, F.when(F.col("_hit"), F.lit(yes)).otherwise(F.lit(no)))
        .drop("_hit")
    )
