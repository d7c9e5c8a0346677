"""Matching a caller's list of names and tax ids with the registry and the payroll."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import format_cpf, parse_cpf
from rollcall.operators.dossier import yes_no
from rollcall.operators.evidence import (
    TRAIL_PERSON_COLUMNS,
    cpf_person_map,
    cpf_trail,
    evidence_columns,
    payroll_columns,
)
from rollcall.operators.keysets import family_benefits
from rollcall.operators.sizing import Measured, measure, measure_keys
from rollcall.operators.skew import join_salted
from rollcall.params import Period
from rollcall.registry import Registry

# The reasons given for each negative answer, per report.
WORDING = {
    "current_family": {
        "no_document": "CPF NÃO ENCONTRADO NO DOC_05",
        "no_person": "CPF SEM PESSOA VINCULADA NO ODS",
        "no_family_3": "NENHUMA FAMÍLIA COM ESTADO 3 NO ODS",
        "no_person_3": "NENHUMA PESSOA COM ESTADO 3 NO ODS",
        "pbf_no_person_3": "SEM PESSOA EM ESTADO 3 → NÃO ELEGÍVEL PARA PBF",
        "pbf_no_family_3": "SEM FAMÍLIA EM ESTADO 3 → NÃO ELEGÍVEL PARA PBF",
        "not_paid": "FAMÍLIA VIGENTE NÃO ENCONTRADA NA FOLHA",
    },
    "any_family": {
        "no_document": "CPF NÃO ENCONTRADO NO DOC_05",
        "no_person": "CPF SEM PESSOA VINCULADA",
        "no_family_3": "FAMÍLIA ≠ 3 NO ANOMES ODS",
        "no_person_3": "PESSOA ≠ 3 NO ANOMES ODS",
        "not_paid": "FAMÍLIA NÃO ENCONTRADA NA FOLHA",
    },
}
WORDING["any_family_if_person3"] = WORDING["any_family"]
OK = "OK"


def _is_set(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(0)) == 1


def reconcile_report(
    people: DataFrame,
    per_cpf: DataFrame,
    wording: dict[str, str],
    same_row: bool = False,
    few: bool = False,
) -> DataFrame:
    """The list with answers and reasons; every list row is kept, repeated ones too.

    ``per_cpf`` has one row per tax id with the evidence and payroll flags. By default ATIVO asks for a
    state-3 person and a state-3 family that may be on different occurrences; ``same_row`` wants one
    occurrence with both. A tax id that fills a large part of the list, and the rows without one, are spread
    over many tasks; ``few`` says that ``per_cpf`` is small and broadcast, so that the list stays in place.
    """
    # The source task is the last sort column: it lets the sort part rows of equal name and tax id.
    listed = people.withColumn("_task", F.spark_partition_id())
    if few:
        joined = listed.join(F.broadcast(per_cpf), "CPF_NUM", "left")
    else:
        joined = join_salted(listed, per_cpf, "CPF_NUM", "left", counted=people, vary=("NOME", "CPF_NUM"))

    active = _is_set("FL_MESMA_LINHA") if same_row else _is_set("FL_PESSOA_3") & _is_set("FL_FAM_3")
    reason_registry = (
        F.when(~_is_set("FL_DOC_ENCONTRADO"), wording["no_document"])
        .when(~_is_set("FL_TEM_PESSOA"), wording["no_person"])
        .when(~_is_set("FL_FAM_3"), wording["no_family_3"])
        .when(~_is_set("FL_PESSOA_3"), wording["no_person_3"])
        .otherwise(OK)
    )
    reason_payroll = F
    if "pbf_no_person_3" in wording:
        reason_payroll = reason_payroll.when(~_is_set("FL_PESSOA_3"), wording["pbf_no_person_3"]).when(
            ~_is_set("FL_FAM_3"), wording["pbf_no_family_3"]
        )
    reason_payroll = reason_payroll.when(~_is_set("FL_PBF"), wording["not_paid"]).otherwise(OK)

    queue = [yes_no(_is_set("FL_PRE_HAB")).alias("PRE_HABILITADO")] if "FL_PRE_HAB" in per_cpf.columns else []
    return joined.select(
        "NOME",
        format_cpf(F.col("CPF_NUM")).alias("CPF"),
        yes_no(active).alias("CADUNICO_ATIVO"),
        yes_no(_is_set("FL_TEM_PESSOA") & _is_set("FL_FAM_3")).alias("CADUNICO_PRESENCA"),
        yes_no(_is_set("FL_PBF")).alias("PBF"),
        *queue,
        reason_registry.alias("MOTIVO_CADUNICO"),
        reason_payroll.alias("MOTIVO_PBF"),
        F.col("ANY_EST_PESSOA").alias("DEBUG_CO_EST_CADASTRAL_MEMB"),
        F.col("ANY_EST_FAM").alias("DEBUG_CO_EST_CADASTRAL_FAM"),
        "_task",
    ).orderBy("NOME", "CPF", "_task").drop("_task")


def reconcile(
    reg: Registry, people: DataFrame, period: Period, policy: str = "current_family", same_row: bool = False
) -> DataFrame:
    """Report for a list from ``people_list``, under one of the payroll policies.

    Only the list's tax ids matter, so the document table is cut to them first, the person table to the
    persons found, and the family and benefit tables to their families. Each cut is a map-side semi-join
    when its keys were counted and are few.
    """
    wanted = measure_keys(people.select("CPF_NUM"))
    listed = reg.document.select(parse_cpf(F.col("NU_CPF_PESSOA")).alias("CPF_NUM"), "NU_CPF_PESSOA", "CO_CHV_NATURAL_PESSOA")
    cpf_map = cpf_person_map(listed.join(wanted.hinted(), "CPF_NUM", "left_semi"))
    known = measure(cpf_map, keep=True) if wanted.small else Measured(cpf_map, None)
    person = known.narrow(reg.person, "CO_CHV_NATURAL_PESSOA").select(*TRAIL_PERSON_COLUMNS)
    found = measure(person, keep=True) if known.small else Measured(person, None)
    family = found.narrow(reg.family, "CO_FAMILIAR_FAM")
    benefits = family_benefits(
        found.narrow(reg.payroll, "CO_FAMILIAR", "CO_FAMILIAR_FAM"),
        found.narrow(reg.queue, "CO_FAMILIAR", "CO_FAMILIAR_FAM"),
        period.rf_payroll,
        period.rf_queue,
    )
    trail = cpf_trail(known.frame, found.frame, family, benefits, found.small)
    per_cpf = trail.groupBy("CPF_NUM").agg(*evidence_columns(), *payroll_columns(policy))
    # At most one row per counted tax id: a counted list is not shuffled, however often it repeats one of them.
    return reconcile_report(people, per_cpf, WORDING[policy], same_row, few=wanted.small)
