"""What the registry knows about each tax id of a caller's list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.cpf import parse_cpf
from rollcall.operators.keysets import has_flag
from rollcall.operators.skew import join_salted
from rollcall.operators.universe import REGISTERED

# The person columns the evidence is drawn from.
TRAIL_PERSON_COLUMNS = ("CO_CHV_NATURAL_PESSOA", "CO_FAMILIAR_FAM", "CO_EST_CADASTRAL_MEMB", "DT_ATUAL_MEMB")
PAYROLL_POLICIES = ("current_family", "any_family_if_person3", "any_family")


def cpf_person_map(document: DataFrame) -> DataFrame:
    """Distinct (tax id as a number, person). Documents without a readable tax id match nothing."""
    return (
        document.select(parse_cpf(F.col("NU_CPF_PESSOA")).alias("CPF_NUM"), "CO_CHV_NATURAL_PESSOA")
        .where(F.col("CPF_NUM").isNotNull())
        .distinct()
    )


def cpf_trail(
    cpf_map: DataFrame, person: DataFrame, family: DataFrame, benefits: DataFrame, few: bool = False
) -> DataFrame:
    """Every (tax id, person, family) occurrence with states, dates and benefit flags.

    Each tax id also has one row with nothing but itself per document person, which keeps those without a
    person. Persons are found by an inner join, where a person key with very many rows can be split; the
    aggregates over a tax id are maxima, so the extra rows change none of them. The family side (unique per
    family) is put together first, so the person rows meet it in one join, which spreads a family with very
    many persons and the persons without a family; ``few`` says that ``person`` was counted and is small.
    """
    households = (
        family.select(
            F.col("CO_FAMILIAR_FAM").alias("FAM_KEY"), "CO_EST_CADASTRAL_FAM", "DT_ATUALIZACAO_FAM"
        )
        .join(benefits.withColumnRenamed("CO_FAMILIAR", "FAM_KEY"), "FAM_KEY", "left")
        .withColumn("ON_PAYROLL", has_flag("ON_PAYROLL"))
        .withColumn("IN_QUEUE", has_flag("IN_QUEUE"))
    )
    people = person.select(*TRAIL_PERSON_COLUMNS).withColumnRenamed("CO_CHV_NATURAL_PESSOA", "PERSON_KEY")
    found = cpf_map.withColumnRenamed("CO_CHV_NATURAL_PESSOA", "_p")
    linked = found.join(people, F.col("_p") == F.col("PERSON_KEY")).drop("_p")
    households = households.withColumn("CO_FAMILIAR_FAM", F.col("FAM_KEY"))
    if few:
        trail = linked.join(households, "CO_FAMILIAR_FAM", "left")
    else:
        vary = ("CPF_NUM", "PERSON_KEY")
        trail = join_salted(linked, households, "CO_FAMILIAR_FAM", "left", counted=person, vary=vary)
    return trail.unionByName(cpf_map.select("CPF_NUM"), allowMissingColumns=True)


def _flag(test: Column) -> Column:
    return F.max(F.when(test, 1).otherwise(0))


def evidence_columns() -> list[Column]:
    """Per tax id: found, has a person, has a family, highest states seen, any family 3, any person 3.

    The maxima are independent: the state-3 person and the state-3 family may be on different rows.
    ``FL_MESMA_LINHA`` tells whether one row has both.
    """
    family_3 = F.col("CO_EST_CADASTRAL_FAM") == REGISTERED
    person_3 = F.col("CO_EST_CADASTRAL_MEMB") == REGISTERED
    return [
        F.max(F.lit(1)).alias("FL_DOC_ENCONTRADO"),
        _flag(F.col("PERSON_KEY").isNotNull()).alias("FL_TEM_PESSOA"),
        _flag(F.col("FAM_KEY").isNotNull()).alias("FL_TEM_FAMILIA"),
        F.max("CO_EST_CADASTRAL_MEMB").alias("ANY_EST_PESSOA"),
        F.max("CO_EST_CADASTRAL_FAM").alias("ANY_EST_FAM"),
        _flag(family_3).alias("FL_FAM_3"),
        _flag(person_3).alias("FL_PESSOA_3"),
        _flag(family_3 & person_3).alias("FL_MESMA_LINHA"),
    ]


def cpf_evidence(trail: DataFrame) -> DataFrame:
    """One row per tax id with the evidence flags."""
    return trail.groupBy("CPF_NUM").agg(*evidence_columns())


def payroll_columns(policy: str) -> list[Column]:
    """``FL_PBF`` (and ``FL_PRE_HAB`` under ``current_family``) as aggregates over a tax id's occurrences.

    ``any_family``             some family of the tax id is on the payroll
    ``any_family_if_person3``  the same, provided some person row has state 3
    ``current_family``         the family of the most recent occurrence with person and family in state 3
    """
    paid = F.max(F.when(F.col("ON_PAYROLL"), 1).otherwise(0))
    if policy == "any_family":
        return [paid.alias("FL_PBF")]
    if policy == "any_family_if_person3":
        some_person_3 = _flag(F.col("CO_EST_CADASTRAL_MEMB") == REGISTERED)
        return [F.when(some_person_3 == 1, paid).otherwise(0).alias("FL_PBF")]
    if policy == "current_family":
        both_3 = (F.col("CO_EST_CADASTRAL_FAM") == REGISTERED) & (F.col("CO_EST_CADASTRAL_MEMB") == REGISTERED)
        # The greatest struct is the current occurrence: latest dates (NULL is smallest), then smallest keys.
        newest = F.max(
            F.when(
                both_3,
                F.struct(
                    "DT_ATUAL_MEMB",
                    "DT_ATUALIZACAO_FAM",
                    (-F.col("PERSON_KEY")).alias("p"),
                    (-F.col("FAM_KEY")).alias("f"),
                    "ON_PAYROLL",
                    "IN_QUEUE",
                ),
            )
        )

        def of_current(name: str) -> Column:
            return F.coalesce(newest[name].cast("int"), F.lit(0))

        return [of_current("ON_PAYROLL").alias("FL_PBF"), of_current("IN_QUEUE").alias("FL_PRE_HAB")]
    raise ValueError(f"unknown payroll policy {policy!r}; one of {', '.join(PAYROLL_POLICIES)}")


def cpf_payroll_flag(trail: DataFrame, policy: str) -> DataFrame:
    """One row per tax id with its payroll flag under a policy."""
    return trail.groupBy("CPF_NUM").agg(*payroll_columns(policy))
