"""Extractions of a municipality or state.

Every job starts from the families of the territory, then cuts the person table down to them, then the
other tables to those persons and families. When the territory is small these cuts are map-side
semi-joins and no large table is shuffled; otherwise they are ordinary shuffled joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import (
    age_between,
    age_years,
    benefit_flag,
    benefit_status,
    category,
    codibge,
    format_cpf,
    in_territory,
    parse_cpf,
    phone_clean,
    recency_filter,
    schooling_level,
    schooling_level_short,
    sex_label,
    uf_sigla,
)
from rollcall.functions.benefits import RELEASED
from rollcall.functions.schooling import NOT_INFORMED, OTHERS
from rollcall.functions.territory import UNKNOWN_IN_REPORTS
from rollcall.operators import dossier as d
from rollcall.operators.dedup import current_by_cpf, family_recency, member_recency, one_per_key
from rollcall.operators.joins import attach
from rollcall.operators.keysets import (
    families_prequalified,
    family_benefits,
    family_situation,
    has_flag,
)
from rollcall.operators.sampling import simple_sample, stratified_sample
from rollcall.operators.sizing import Measured, measure
from rollcall.operators.skew import join_salted
from rollcall.operators.universe import families_of, persons_of
from rollcall.params import CandidateRules, Period, SamplePlan, Territory
from rollcall.registry import Registry

# Fixed value: the region is not in the registry.
NO_REGION = "---"

_PES_KEY, _FAM_KEY = "PES_" + d.PERSON_KEY, "FAM_" + d.FAMILY_KEY
_PERSON_COLUMNS = (*d.PERSON_ALL, "CO_SEXO_PESSOA")
_FAMILY_COLUMNS = (*d.FAMILY_ALL, *d.TERRITORY, "NO_LOCALIDADE_FAM")


@dataclass(frozen=True)
class _People:
    """Document, person and family rows of a territory, and the measured people they came from."""

    rows: DataFrame
    people: Measured

    def with_unique(self, rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
        """Left join to a derived table with one row per key; a very frequent key of many rows is spread."""
        if self.people.small:
            return rows.join(table, key, "left")
        return join_salted(rows, table, key, "left", vary=(_PES_KEY, _FAM_KEY, "DOC_" + d.PERSON_KEY))

    def of_person(self, table: DataFrame) -> DataFrame:
        return self.people.narrow(table, d.PERSON_KEY, _PES_KEY)

    def of_family(self, table: DataFrame, key: str = d.FAMILY_KEY) -> DataFrame:
        return self.people.narrow(table, key, _FAM_KEY)


def _people_of(
    reg: Registry,
    territory: Territory,
    rule: str,
    rules: CandidateRules,
    period: Period,
    person_columns: Sequence[str] = _PERSON_COLUMNS,
    family_columns: Sequence[str] = _FAMILY_COLUMNS,
    document_columns: Sequence[str] = d.DOCUMENT_ALL,
) -> _People:
    here = in_territory(territory, *[F.col(c) for c in d.TERRITORY])
    families = measure(d.prefixed(families_of(reg.family, rule).where(here), "FAM_", family_columns))

    person = persons_of(reg.person, rule)
    if rules.age is not None:
        person = person.where(age_between(F.col("DT_NASC_PESSOA"), *rules.age, as_of=period.as_of))
    if rules.months_since_update is not None:
        lo, hi = rules.months_since_update
        person = person.where(recency_filter(F.col("DT_ATUAL_MEMB"), period.anomes_ods, lo, hi))
    if not families.light:  # else the join itself leaves the persons where they are
        person = families.narrow(person, d.FAMILY_KEY, _FAM_KEY)
    joined = d.prefixed(person, "PES_", person_columns).join(
        families.hinted(), F.col("PES_" + d.FAMILY_KEY) == F.col(_FAM_KEY)
    )
    people = measure(joined, keep=True) if families.small else Measured(joined, None)
    documents = people.narrow(reg.document.where(F.col("NU_CPF_PESSOA").isNotNull()), d.PERSON_KEY, _PES_KEY)
    rows = people.frame.join(
        d.prefixed(documents, "DOC_", document_columns),
        F.col(_PES_KEY) == F.col("DOC_" + d.PERSON_KEY),
    )
    return _People(rows, people)


def _with_schooling(found: _People, rows: DataFrame, schooling: DataFrame, level: Column, default: str) -> DataFrame:
    """Left-join the schooling level; repeated schooling rows of a person give one level."""
    levels = schooling.select(F.col(d.PERSON_KEY).alias(_PES_KEY), level.alias("ESCOLARIDADE"))
    levels = levels.groupBy(_PES_KEY).agg(F.min("ESCOLARIDADE").alias("ESCOLARIDADE"))
    joined = found.with_unique(rows, levels, _PES_KEY)
    return joined.withColumn("ESCOLARIDADE", F.coalesce("ESCOLARIDADE", F.lit(default)))


def _with_household(found: _People, rows: DataFrame, *tables: DataFrame) -> DataFrame:
    """Left-join tables holding one row per family (first column: the family key).

    They are joined to each other first, so the person rows are moved by family only once.
    """
    first, *others = tables
    household = first.withColumnRenamed(first.columns[0], _FAM_KEY)
    for other in others:
        household = household.join(other.withColumnRenamed(other.columns[0], _FAM_KEY), _FAM_KEY, "full")
    return found.with_unique(rows, household, _FAM_KEY)


def _place(municipality: str | None = None) -> list[Column]:
    uf, mun = F.col("FAM_" + d.TERRITORY[0]), F.col("FAM_" + d.TERRITORY[1])
    name = F.lit(municipality) if municipality is not None else mun.cast("string")
    return [
        uf_sigla(uf, UNKNOWN_IN_REPORTS).alias("UF"),
        name.alias("MUNICIPIO"),
        codibge(uf, mun).alias("CODIBGE"),
        F.lit(NO_REGION).alias("REGIAO"),
        F.col("FAM_NO_LOCALIDADE_FAM").alias("BAIRRO"),
    ]


def _person_head(period: Period) -> list[Column]:
    born = F.col("PES_DT_NASC_PESSOA")
    return [
        F.col("PES_NU_NIS_PESSOA").alias("NIS"),
        F.col("PES_NO_PESSOA").alias("NOME"),
        sex_label(F.col("PES_CO_SEXO_PESSOA")).alias("SEXO"),
        born.alias("DT_NASC"),
        age_years(born, period.as_of).alias("IDADE"),
        F.col("ESCOLARIDADE"),
    ]


def _phone() -> list[Column]:
    return [F.col("CONT_DDD_1").alias("DDD"), phone_clean(F.col("CONT_TEL_1")).alias("TELEFONE")]


def name_municipalities(report: DataFrame, names: DataFrame) -> DataFrame:
    """Replace MUNICIPIO by the name found in ``names(CODIBGE, NOME_MUNICIPIO)``, where there is one.

    ``names`` is the official list of municipalities; it is broadcast after its rows were counted.
    """
    listed = measure(names.select("CODIBGE", "NOME_MUNICIPIO"))
    return (
        report.join(listed.hinted(), "CODIBGE", "left")
        .withColumn("MUNICIPIO", F.coalesce("NOME_MUNICIPIO", "MUNICIPIO"))
        .select(*report.columns)
    )


def municipal_history(
    reg: Registry, territory: Territory, period: Period, rule: str = "strict"
) -> DataFrame:
    """Document, person, family and contact rows of a municipality, not deduplicated.

    ``rule="all"`` gives every occurrence, registered or not.
    """
    found = _people_of(reg, territory, rule, CandidateRules(), period, d.PERSON_ALL, (*d.FAMILY_ALL, *d.TERRITORY))
    phones = found.of_family(d.contacts(reg.contact), "CONT_FAMILY")
    rows = attach(found.rows, phones, _FAM_KEY, "CONT_FAMILY")
    return rows.select(
        *d.with_prefix("DOC_", d.DOCUMENT_ALL),
        *d.with_prefix("PES_", d.PERSON_ALL),
        *d.with_prefix("FAM_", d.FAMILY_ALL),
        *d.CONTACT_NAMES.values(),
        codibge(*[F.col("FAM_" + c) for c in d.TERRITORY]).alias("CODIBGE"),
    ).orderBy("DOC_NU_CPF_PESSOA", "PES_CO_CHV_NATURAL_PESSOA", "PES_CO_FAMILIAR_FAM")


def _one_contact(found: _People, reg: Registry) -> DataFrame:
    return one_per_key(found.of_family(d.contacts(reg.contact), "CONT_FAMILY"), "CONT_FAMILY")


def _benefits(found: _People, reg: Registry, period: Period, situations: Sequence[str] | None = None) -> DataFrame:
    payroll = found.of_family(reg.payroll, "CO_FAMILIAR")
    queue = found.of_family(reg.queue, "CO_FAMILIAR")
    return family_benefits(payroll, queue, period.rf_payroll, period.rf_queue, situations)


def municipal_current(
    reg: Registry, territory: Territory, period: Period, rule: str = "strict"
) -> DataFrame:
    """Current record per tax id of a municipality, with schooling, contact and benefit flags."""
    found = _people_of(reg, territory, rule, CandidateRules(), period, d.PERSON_ALL, (*d.FAMILY_ALL, *d.TERRITORY))
    order = member_recency("PES_DT_ATUAL_MEMB", "FAM_DT_ATUALIZACAO_FAM", _PES_KEY, _FAM_KEY)
    current = current_by_cpf(found.rows, order, "DOC_NU_CPF_PESSOA")
    rows = _with_schooling(found, current, found.of_person(reg.schooling), schooling_level(), NOT_INFORMED)
    rows = _with_household(found, rows, _one_contact(found, reg), _benefits(found, reg, period))
    return rows.select(
        F.col("DOC_NU_CPF_PESSOA").alias("CPF"),
        *d.with_prefix("DOC_", d.DOCUMENT_ALL),
        *d.with_prefix("PES_", d.PERSON_ALL),
        "ESCOLARIDADE",
        *d.with_prefix("FAM_", d.FAMILY_ALL),
        *d.CONTACT_NAMES.values(),
        F.col("PES_DT_ATUAL_MEMB").alias("ORD_DT_ATUAL_MEMB"),
        F.col("FAM_DT_ATUALIZACAO_FAM").alias("ORD_DT_ATUALIZACAO_FAM"),
        F.col(_PES_KEY).alias("ORD_CHAVE_PESSOA"),
        d.yes_no(has_flag("ON_PAYROLL")).alias("FAMILIA_NA_FOLHA_PBF"),
        d.yes_no(has_flag("IN_QUEUE")).alias("FAMILIA_PRE_HABILITADA"),
    ).orderBy("DOC_NU_CPF_PESSOA")


def state_candidates(
    reg: Registry,
    territory: Territory,
    period: Period,
    rules: CandidateRules,
    sample_size: int | None = None,
    seed: int | None = None,
) -> DataFrame:
    """Candidates of a state by age, schooling and update recency, one current record per tax id.

    The current record is chosen first and the schooling filter applied to it afterwards. Tax ids are
    compared as numbers; unreadable ones stay apart under their own text, with an empty CPF. ``sample_size``
    draws so many of them by the hash of the tax id.
    """
    found = _people_of(
        reg, territory, "strict", rules, period, document_columns=(d.PERSON_KEY, "NU_CPF_PESSOA")
    )
    number = parse_cpf(F.col("DOC_NU_CPF_PESSOA"))
    rows = found.rows.withColumn("_number", number).withColumn(
        "_key", F.coalesce(F.col("_number").cast("string"), F.col("DOC_NU_CPF_PESSOA"))
    )
    order = member_recency("PES_DT_ATUAL_MEMB", "FAM_DT_ATUALIZACAO_FAM", _PES_KEY, _FAM_KEY)
    rows = current_by_cpf(rows, order, "_key")
    rows = _with_schooling(found, rows, found.of_person(reg.schooling), schooling_level_short(), OTHERS)
    if rules.schooling is not None:
        rows = rows.where(F.col("ESCOLARIDADE").isin(*rules.schooling))
    if sample_size is not None:
        rows = simple_sample(rows, sample_size, "_key", seed)
    rows = _with_household(found, rows, _one_contact(found, reg), _benefits(found, reg, period))
    paid, queued = has_flag("ON_PAYROLL"), has_flag("IN_QUEUE")
    return rows.select(
        format_cpf(F.col("_number")).alias("CPF"),
        *_person_head(period),
        *_place(),
        *_phone(),
        paid.cast("int").alias("FL_PBF"),
        queued.cast("int").alias("FL_PRE_HAB"),
        F.col("PES_DT_ATUAL_MEMB").alias("DT_ATUAL_MEMB"),
        F.col("FAM_DT_ATUALIZACAO_FAM").alias("DT_ATUALIZACAO_FAM"),
        category(queued, paid).alias("categoria"),
    ).orderBy("NOME", "CPF")


def eligible_candidates(
    reg: Registry,
    territory: Territory,
    period: Period,
    rules: CandidateRules,
    sample_size: int | None = None,
    seed: int | None = None,
) -> DataFrame:
    """Eligible candidates of a state, one current record per tax id among those with the wanted schooling.

    Here the schooling filter comes before the choice of the current record. ``sample_size`` draws so many of
    them by the hash of the tax id.
    """
    found = _people_of(
        reg, territory, "eligible", rules, period, document_columns=(d.PERSON_KEY, "NU_CPF_PESSOA")
    )
    schooling = found.of_person(reg.schooling)
    wanted = rules.schooling
    if wanted is not None and NOT_INFORMED not in wanted:
        schooling = schooling.where(schooling_level().isin(*wanted))
    rows = _with_schooling(found, found.rows, schooling, schooling_level(), NOT_INFORMED)
    if wanted is not None:
        rows = rows.where(F.col("ESCOLARIDADE").isin(*wanted))
    order = member_recency("PES_DT_ATUAL_MEMB", "FAM_DT_ATUALIZACAO_FAM", _PES_KEY, _FAM_KEY)
    rows = current_by_cpf(rows, order, "DOC_NU_CPF_PESSOA")
    if sample_size is not None:
        rows = simple_sample(rows, sample_size, "DOC_NU_CPF_PESSOA", seed)
    rows = _with_household(found, rows, _one_contact(found, reg), _benefits(found, reg, period))
    return rows.select(
        F.col("DOC_NU_CPF_PESSOA").alias("CPF"),
        *_person_head(period),
        F.col("FAM_NO_LOCALIDADE_FAM").alias("BAIRRO"),
        *_phone(),
        has_flag("ON_PAYROLL").cast("int").alias("FL_PBF"),
        has_flag("IN_QUEUE").cast("int").alias("FL_PRE_HAB"),
        F.col("PES_DT_ATUAL_MEMB").alias("DT_ATUAL_MEMB"),
        F.col("FAM_DT_ATUALIZACAO_FAM").alias("DT_ATUALIZACAO_FAM"),
    )


def municipal_benefit_status(
    reg: Registry,
    territory: Territory,
    period: Period,
    sample_size: int | None = 100,
    age: tuple[int, int] = (18, 65),
    municipality: str | None = None,
    any_month: bool = False,
    seed: int | None = None,
) -> DataFrame:
    """Current record per tax id of a municipality with its benefit status, optionally a random sample.

    Payroll and queue are read at the period's months. ``any_month=True`` looks at all months, as a join
    without a month does; a family still has one status, the first of active, suspended, blocked, other.
    """
    found = _people_of(
        reg,
        territory,
        "registered_valid",
        CandidateRules(age=age),
        period,
        document_columns=(d.PERSON_KEY, "NU_CPF_PESSOA"),
    )
    order = family_recency("FAM_DT_ULT_ATUAL_FAM", _PES_KEY, _FAM_KEY)
    rows = current_by_cpf(found.rows, order, "DOC_NU_CPF_PESSOA")
    if sample_size is not None:
        rows = simple_sample(rows, sample_size, "DOC_NU_CPF_PESSOA", seed)
    rows = _with_schooling(found, rows, found.of_person(reg.schooling), schooling_level(), NOT_INFORMED)

    situation = family_situation(
        found.of_family(reg.payroll, "CO_FAMILIAR"), None if any_month else period.rf_payroll
    ).withColumn("ON_PAYROLL", F.lit(True))
    queued = families_prequalified(
        found.of_family(reg.queue, "CO_FAMILIAR"), None if any_month else period.rf_queue
    ).withColumn("IN_QUEUE", F.lit(True))
    rows = _with_household(found, rows, _one_contact(found, reg), situation, queued)
    paid, in_queue, text = has_flag("ON_PAYROLL"), has_flag("IN_QUEUE"), F.col("SITUATION")
    return rows.select(
        F.col("DOC_NU_CPF_PESSOA").alias("CPF"),
        *_person_head(period),
        *_place(municipality),
        *_phone(),
        benefit_flag(paid, text).alias("PBF"),
        benefit_status(in_queue, paid, text).alias("STATUS_PBF"),
    )


def municipal_sample(
    reg: Registry,
    territory: Territory,
    period: Period,
    plan: SamplePlan,
    rules: CandidateRules = CandidateRules(age=(18, 65), months_since_update=(None, 12)),
    municipality: str | None = None,
) -> DataFrame:
    """Stratified sample of a municipality: registry only, queued and paid, short strata filled up.

    A family counts as paid only when its situation is released.
    """
    found = _people_of(
        reg, territory, "registered_valid", rules, period, document_columns=(d.PERSON_KEY, "NU_CPF_PESSOA")
    )
    order = family_recency("FAM_DT_ULT_ATUAL_FAM", _PES_KEY, _FAM_KEY)
    current = current_by_cpf(found.rows, order, "DOC_NU_CPF_PESSOA")
    strata = _with_household(found, current, _benefits(found, reg, period, (RELEASED, "L"))).withColumn(
        "CATEGORIA", category(has_flag("IN_QUEUE"), has_flag("ON_PAYROLL"))
    )
    picked = stratified_sample(strata, plan, "DOC_NU_CPF_PESSOA")
    rows = _with_schooling(found, picked, found.of_person(reg.schooling), schooling_level(), NOT_INFORMED)
    rows = _with_household(found, rows, _one_contact(found, reg))
    return rows.select(
        F.col("DOC_NU_CPF_PESSOA").alias("CPF"),
        *_person_head(period),
        *_place(municipality),
        *_phone(),
        "CATEGORIA",
    )
