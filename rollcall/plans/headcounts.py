"""Headcounts of the country, the states and one municipality.

The unit counted differs between jobs and is stated in each docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import in_territory, months_since, uf_sigla
from rollcall.operators.headcount import count_by_uf
from rollcall.operators.keysets import families_on_payroll, families_prequalified
from rollcall.operators.recency import recency_buckets
from rollcall.operators.sizing import measure
from rollcall.operators.universe import active_universe, families_of, persons_of
from rollcall.params import Period, Territory
from rollcall.registry import Registry

PERSON = "CO_CHV_NATURAL_PESSOA"
FAMILY = "CO_FAMILIAR_FAM"
UF_CODE = "CO_MUNIC_IBGE_2_FAM"


def _on_family(keys: DataFrame) -> DataFrame:
    return keys.withColumnRenamed("CO_FAMILIAR", FAMILY)


def queued_families_by_uf(reg: Registry, period: Period) -> DataFrame:
    """Families in the queue per state and in total; no status test. The queue month is usually the next one."""
    queued = _on_family(families_prequalified(reg.queue, period.rf_queue))
    families = reg.family.join(queued, FAMILY, "left_semi").select(FAMILY, uf_sigla(F.col(UF_CODE)).alias("UF"))
    counted = count_by_uf(families.distinct(), F.col("UF"), "Qtd_Familias_PreHabilitadas", total_row=True)
    return counted.orderBy("UF")


def queued_persons_by_uf(reg: Registry, period: Period) -> DataFrame:
    """(person, family, state) rows of queued families per state and in total."""
    queued = _on_family(families_prequalified(reg.queue, period.rf_queue))
    families = reg.family.join(queued, FAMILY, "left_semi")
    rows = active_universe(reg.person, families, derived=True)
    rows = rows.select(PERSON, FAMILY, UF_CODE).distinct()
    counted = count_by_uf(rows, uf_sigla(F.col(UF_CODE)), "Qtd_Pessoas_PreHabilitadas", total_row=True)
    return counted.orderBy("UF")


def families_registered_and_paid(reg: Registry, period: Period) -> DataFrame:
    """Distinct families with an active member, and those of them on the payroll: one row."""
    # Distinct member families first: a family with very many members shrinks before the shuffle.
    inhabited = persons_of(reg.person, "strict").select(FAMILY).distinct()
    families = families_of(reg.family, "strict").select(FAMILY).join(inhabited, FAMILY, "left_semi").distinct()
    paid = _on_family(families_on_payroll(reg.payroll, period.rf_payroll)).withColumn("_paid", F.lit(True))
    return families.join(paid, FAMILY, "left").agg(
        F.count(F.lit(1)).alias("Familias_inscritas_CadUnico"),
        F.count("_paid").alias("Familias_inscritas_BolsaFamilia"),
    )


def registered_persons(reg: Registry) -> DataFrame:
    """Distinct registered persons: one row."""
    return active_universe(reg.person, reg.family, family_columns=()).agg(
        F.count_distinct(PERSON).alias("QT_PESSOAS_CADASTRADAS")
    )


def registered_persons_by_uf(reg: Registry) -> DataFrame:
    """Distinct registered persons per state."""
    counted = count_by_uf(
        active_universe(reg.person, reg.family),
        uf_sigla(F.col(UF_CODE)),
        "Qtd_Pessoas_inscritas_CadUnico_PorUF",
        distinct=PERSON,
    )
    return counted.orderBy("UF")


def registered_persons_of_municipality(reg: Registry, territory: Territory) -> DataFrame:
    """Distinct registered persons of one municipality: always one row, 0 for an unknown code."""
    here = in_territory(territory, F.col(UF_CODE), F.col("CO_MUNIC_IBGE_5_FAM"))
    families = measure(families_of(reg.family, "strict").where(here).select(FAMILY).distinct())
    rows = persons_of(reg.person, "strict").select(PERSON, FAMILY).join(families.hinted(), FAMILY, "left_semi")
    return rows.agg(F.count_distinct(PERSON).alias("Qtd_Pessoas_inscritas_CadUnico_Ativo")).select(
        F.lit(territory.codibge).alias("CODIBGE"), "Qtd_Pessoas_inscritas_CadUnico_Ativo"
    )


def persons_registered_and_paid(reg: Registry, period: Period) -> DataFrame:
    """Distinct (person, family) pairs registered, and distinct persons in paid families: one row.

    The two counts use different units, as the source report does.
    """
    paid = _on_family(families_on_payroll(reg.payroll, period.rf_payroll)).withColumn("_paid", F.lit(True))
    families = families_of(reg.family, "strict").join(paid, FAMILY, "left")
    pairs = active_universe(reg.person, families, family_columns=("_paid",), derived=True).distinct()
    return pairs.agg(
        F.count(F.lit(1)).alias("Pessoas_inscritos_CadUnico"),
        F.count_distinct(F.when(F.col("_paid"), F.col(PERSON))).alias("Pessoas_inscritas_BolsaFamilia"),
    )


def paid_persons_by_uf(reg: Registry, period: Period) -> DataFrame:
    """Distinct registered persons in families on the payroll, per state."""
    paid = _on_family(families_on_payroll(reg.payroll, period.rf_payroll))
    families = reg.family.join(paid, FAMILY, "left_semi")
    counted = count_by_uf(
        active_universe(reg.person, families, derived=True),
        uf_sigla(F.col(UF_CODE)),
        "Qtd_Pessoas_inscritas_BolsaFamilia_PorUF",
        distinct=PERSON,
    )
    return counted.orderBy("UF")


def update_recency_by_uf(reg: Registry, anomes_ref: int) -> DataFrame:
    """(person, family, update date) rows per state: total, six buckets of months, and no date."""
    rows = active_universe(
        reg.person, reg.family, person_columns=(PERSON, "DT_ATUAL_MEMB"), family_columns=(UF_CODE,)
    ).distinct()
    months = months_since(F.col("DT_ATUAL_MEMB"), anomes_ref)
    return recency_buckets(rows, months, [uf_sigla(F.col(UF_CODE)).alias("UF")]).orderBy("UF")


def payroll_months(payroll: DataFrame) -> DataFrame:
    """Months present in the payroll, newest first."""
    return payroll.select("RF_FOLHA").distinct().orderBy(F.col("RF_FOLHA").desc())


def latest_payroll_month(payroll: DataFrame) -> DataFrame:
    """The newest payroll month: one row."""
    return payroll.agg(F.max("RF_FOLHA").alias("RF_FOLHA"))
