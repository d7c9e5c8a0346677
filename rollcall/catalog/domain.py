"""Domain operators B01-B29, each over the whole registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.catalog.entries import PERIOD, Entry, Star
from rollcall.catalog.jobs import ENTRIES as JOBS
from rollcall.catalog.oracle import oracle, within_quota
from rollcall.functions import (
    age_years,
    benefit_flag,
    benefit_status,
    category,
    clean_cpf,
    codibge,
    format_cpf,
    months_since,
    phone_clean,
    recency_filter,
    schooling_level,
    schooling_level_short,
    sex_label,
    uf_sigla,
)
from rollcall.operators import dossier as d
from rollcall.operators.dedup import current_by_cpf, family_recency, member_recency
from rollcall.operators.evidence import (
    cpf_evidence,
    cpf_payroll_flag,
    cpf_person_map,
    cpf_trail,
)
from rollcall.operators.headcount import count_by_uf
from rollcall.operators.keysets import (
    families_on_payroll,
    families_prequalified,
    family_benefits,
    family_situation,
    flag_membership,
    has_flag,
)
from rollcall.operators.recency import recency_buckets
from rollcall.operators.sampling import simple_sample, stratified_sample
from rollcall.operators.universe import active_universe
from rollcall.params import SamplePlan
from rollcall.plans.headcounts import latest_payroll_month
from rollcall.plans.reconciliation import WORDING, reconcile, reconcile_report

PERSON, FAMILY = "CO_CHV_NATURAL_PESSOA", "CO_FAMILIAR_FAM"
_SQL = {e.name: e.sql for e in JOBS}


def _policies(s: Star) -> DataFrame:
    def tally(rule: str) -> DataFrame:
        rows = active_universe(s.reg.person, s.reg.family, rule)
        return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(PERSON).alias("persons")).select(
            F.lit(rule).alias("rule"), "rows", "persons"
        )

    rules = ("strict", "registered_valid", "both3", "eligible", "all")
    return reduce(DataFrame.unionByName, [tally(r) for r in rules])


_POLICIES_SQL = oracle(
    """SELECT rule, count(*) AS rows, count(DISTINCT CO_CHV_NATURAL_PESSOA) AS persons FROM (
         SELECT 'strict' AS rule, CO_CHV_NATURAL_PESSOA FROM both_sides WHERE fs NOT IN (1, 2, 4) AND ms = 3
         UNION ALL SELECT 'registered_valid', CO_CHV_NATURAL_PESSOA FROM both_sides WHERE fs = 3 AND valid = 1
         UNION ALL SELECT 'both3', CO_CHV_NATURAL_PESSOA FROM both_sides WHERE fs = 3 AND ms = 3
         UNION ALL SELECT 'eligible', CO_CHV_NATURAL_PESSOA FROM both_sides
           WHERE fs NOT IN (1, 2, 4) AND ms = 3 AND valid <> 2 AND cond <> 6
         UNION ALL SELECT 'all', CO_CHV_NATURAL_PESSOA FROM both_sides) t GROUP BY 1""",
    both_sides="""SELECT p.CO_CHV_NATURAL_PESSOA, f.CO_EST_CADASTRAL_FAM AS fs, p.CO_EST_CADASTRAL_MEMB AS ms,
          f.IN_CADASTRO_VALIDO_FAM AS valid, f.CO_CONDICAO_CADASTRO_FAM AS cond
        FROM TB_PESSOA_04 p, TB_FAMILIA_01 f WHERE p.CO_FAMILIAR_FAM = f.CO_FAMILIAR_FAM""",
)


def _all_people(s: Star) -> DataFrame:
    """Document, person and family rows of the whole registry."""
    rows = d.dossier_rows(s.reg, None)
    return rows.where(F.col("DOC_NU_CPF_PESSOA").isNotNull())


def _current(s: Star, by_family: bool) -> DataFrame:
    keys = ("PES_" + PERSON, "FAM_" + FAMILY)
    order = (
        family_recency("FAM_DT_ULT_ATUAL_FAM", *keys)
        if by_family
        else member_recency("PES_DT_ATUAL_MEMB", "FAM_DT_ATUALIZACAO_FAM", *keys)
    )
    rows = current_by_cpf(_all_people(s), order, "DOC_NU_CPF_PESSOA")
    return rows.select(
        F.col("DOC_NU_CPF_PESSOA").alias("CPF"), F.col(keys[0]).alias("person"), F.col(keys[1]).alias("family")
    )


def _current_sql(order: str) -> str:
    return oracle(
        f"""SELECT doc.NU_CPF_PESSOA AS CPF, p.CO_CHV_NATURAL_PESSOA AS person, f.CO_FAMILIAR_FAM AS family
            FROM TB_DOCUMENTO_05 doc JOIN TB_PESSOA_04 p USING (CO_CHV_NATURAL_PESSOA)
              JOIN TB_FAMILIA_01 f ON f.CO_FAMILIAR_FAM = p.CO_FAMILIAR_FAM
            WHERE doc.NU_CPF_PESSOA IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY doc.NU_CPF_PESSOA ORDER BY {order}) = 1"""
    )


_MEMBER_ORDER = """p.DT_ATUAL_MEMB DESC NULLS LAST, f.DT_ATUALIZACAO_FAM DESC NULLS LAST,
                   p.CO_CHV_NATURAL_PESSOA, f.CO_FAMILIAR_FAM"""
_FAMILY_ORDER = "f.DT_ULT_ATUAL_FAM DESC NULLS LAST, p.CO_CHV_NATURAL_PESSOA, f.CO_FAMILIAR_FAM"


def _benefits(s: Star) -> DataFrame:
    return family_benefits(s.reg.payroll, s.reg.queue, PERIOD.rf_payroll, PERIOD.rf_queue)


def _trail(s: Star) -> DataFrame:
    return cpf_trail(cpf_person_map(s.reg.document), s.reg.person, s.reg.family, _benefits(s))


_SEEN = """SELECT m.cpf_num, p.CO_CHV_NATURAL_PESSOA AS person, f.CO_FAMILIAR_FAM AS family,
      p.CO_EST_CADASTRAL_MEMB AS ms, f.CO_EST_CADASTRAL_FAM AS fs, p.DT_ATUAL_MEMB, f.DT_ATUALIZACAO_FAM
    FROM (SELECT DISTINCT cpf_num, CO_CHV_NATURAL_PESSOA FROM doc_num WHERE cpf_num IS NOT NULL) m
      LEFT JOIN TB_PESSOA_04 p USING (CO_CHV_NATURAL_PESSOA) LEFT JOIN TB_FAMILIA_01 f ON f.CO_FAMILIAR_FAM = p.CO_FAMILIAR_FAM"""


def _text_key(df: DataFrame) -> DataFrame:
    return df.withColumn("CPF_NUM", F.col("CPF_NUM").cast("string"))


def _situations(s: Star) -> DataFrame:
    """Families with payroll situation and queue flag."""
    situation = family_situation(s.reg.payroll, PERIOD.rf_payroll).withColumn("ON_PAYROLL", F.lit(True))
    queued = families_prequalified(s.reg.queue, PERIOD.rf_queue).withColumn("IN_QUEUE", F.lit(True))
    household = situation.join(queued, "CO_FAMILIAR", "full").withColumnRenamed("CO_FAMILIAR", FAMILY)
    return s.reg.family.select(FAMILY).join(household, FAMILY, "left")


_SITUATIONS = """SELECT f.CO_FAMILIAR_FAM, s.CO_FAMILIAR IS NOT NULL AS on_payroll, s.situation,
      f.CO_FAMILIAR_FAM IN (SELECT CO_FAMILIAR FROM queued) AS in_queue
    FROM TB_FAMILIA_01 f LEFT JOIN (
      SELECT CO_FAMILIAR, NO_TIPO_SITIUACAO_BEN AS situation FROM VW_FOLHA_PAGAMENTO WHERE RF_FOLHA = 200007
      QUALIFY row_number() OVER (PARTITION BY CO_FAMILIAR ORDER BY
        CASE coalesce(NO_TIPO_SITIUACAO_BEN, 'L') WHEN 'LIBERADO' THEN 0 WHEN 'L' THEN 0 WHEN 'NAO INFORMADO' THEN 0
             WHEN 'SUSPENSO' THEN 1 WHEN 'BLOQUEADO' THEN 2 ELSE 3 END, NO_TIPO_SITIUACAO_BEN NULLS FIRST) = 1) s
      ON s.CO_FAMILIAR = f.CO_FAMILIAR_FAM"""


def _strata(s: Star) -> DataFrame:
    """One row per tax id of the documents with the category of its family."""
    docs = s.reg.document.where(F.col("NU_CPF_PESSOA").isNotNull())
    first = current_by_cpf(docs, [F.col(PERSON).asc()], "NU_CPF_PESSOA")
    rows = first.join(_benefits(s).withColumnRenamed("CO_FAMILIAR", FAMILY), FAMILY, "left")
    return rows.select(
        F.col("NU_CPF_PESSOA").alias("CPF"), category(has_flag("IN_QUEUE"), has_flag("ON_PAYROLL")).alias("CATEGORIA")
    )


_STRATA = """SELECT CPF, CASE WHEN fam IN (SELECT CO_FAMILIAR FROM queued) THEN 'PRE' WHEN fam IN (SELECT CO_FAMILIAR FROM paid) THEN 'PBF'
      ELSE 'CAD' END AS CATEGORIA
    FROM (SELECT NU_CPF_PESSOA AS CPF, arg_min(CO_FAMILIAR_FAM, CO_CHV_NATURAL_PESSOA) AS fam FROM TB_DOCUMENTO_05
          WHERE NU_CPF_PESSOA IS NOT NULL GROUP BY 1) t"""


def _stratified_sql(quotas: dict[str, int]) -> str:
    return oracle(
        "SELECT CPF, CATEGORIA FROM drawn WHERE " + within_quota(quotas, "CAD"),
        strata=_STRATA,
        drawn="SELECT *, row_number() OVER (PARTITION BY CATEGORIA ORDER BY md5(CPF), CPF) AS place FROM strata",
    )


# One plan within the group limit and one beyond it, so that both ways of ranking are compared.
_SMALL_SAMPLE, _LARGE_SAMPLE = SamplePlan(total=250), SamplePlan(total=1600, shares={"CAD": 0.05, "PRE": 0.9, "PBF": 0.05})

_REPORT_SAME_ROW = _SQL["q22_reconcile_any_family"].replace("b.member_3 AND b.family_3", "b.same_row").replace(
    "SELECT cpf_num, bool_or(person IS NOT NULL) AS has_person",
    "SELECT cpf_num, coalesce(bool_or(ms = 3 AND fs = 3), false) AS same_row, bool_or(person IS NOT NULL) AS has_person",
)

ENTRIES = [
    Entry("b01_active_universe", _policies, _POLICIES_SQL),
    Entry(
        "b02_clean_cpf",
        lambda s: s.people.select("NOME", "CPF_RAW", clean_cpf(F.col("CPF_RAW")).cast("string").alias("CPF_NUM")),
        oracle("SELECT NOME, CPF_RAW, CAST(cpf_num AS VARCHAR) AS CPF_NUM FROM listed"),
    ),
    Entry(
        "b03_format_cpf",
        lambda s: s.people.select("NOME", format_cpf(F.col("CPF_NUM")).alias("CPF")),
        oracle("SELECT NOME, lpad(CAST(cpf_num AS VARCHAR), 11, '0') AS CPF FROM listed"),
    ),
    Entry(
        "b04_uf_sigla",
        lambda s: s.reg.family.select(
            FAMILY,
            uf_sigla(F.col("CO_MUNIC_IBGE_2_FAM")).alias("uf_count"),
            uf_sigla(F.col("CO_MUNIC_IBGE_2_FAM"), "Não Informado").alias("uf_report"),
        ),
        oracle("SELECT CO_FAMILIAR_FAM, uf_count, uf_report FROM fam"),
    ),
    Entry(
        "b05_codibge",
        lambda s: s.reg.family.groupBy(codibge(F.col("CO_MUNIC_IBGE_2_FAM"), F.col("CO_MUNIC_IBGE_5_FAM")).alias("CODIBGE")).agg(
            F.count(F.lit(1)).alias("families")
        ),
        oracle("SELECT ibge7 AS CODIBGE, count(*) AS families FROM fam GROUP BY 1"),
    ),
    Entry(
        "b06_age_years",
        lambda s: s.reg.person.select("NU_NIS_PESSOA", age_years(F.col("DT_NASC_PESSOA"), PERIOD.as_of).alias("IDADE")),
        oracle("SELECT NU_NIS_PESSOA, CAST(age AS INT) AS IDADE FROM pes"),
    ),
    Entry(
        "b07_months_since",
        lambda s: s.reg.person.groupBy(months_since(F.col("DT_ATUAL_MEMB"), PERIOD.anomes_ods).alias("months_old")).agg(
            F.count(F.lit(1)).alias("persons")
        ),
        oracle("SELECT CAST(months_old AS INT) AS months_old, count(*) AS persons FROM pes GROUP BY 1"),
    ),
    Entry(
        "b08_recency_filter",
        lambda s: s.reg.person.where(recency_filter(F.col("DT_ATUAL_MEMB"), PERIOD.anomes_ods, 0, 13)).select(
            PERSON, FAMILY, "DT_ATUAL_MEMB"
        ),
        oracle("SELECT CO_CHV_NATURAL_PESSOA, CO_FAMILIAR_FAM, DT_ATUAL_MEMB FROM pes WHERE months_old BETWEEN 0 AND 13"),
    ),
    Entry(
        "b09_recency_buckets",
        lambda s: recency_buckets(
            s.reg.person, months_since(F.col("DT_ATUAL_MEMB"), PERIOD.anomes_ods), ["CO_EST_CADASTRAL_MEMB"], "QT_TOTAL"
        ),
        oracle(
            """SELECT CO_EST_CADASTRAL_MEMB, count(*) AS QT_TOTAL,
                 count(*) FILTER (months_old >= 0 AND months_old <= 6) AS QT_0_A_6_MESES,
                 count(*) FILTER (months_old > 6 AND months_old <= 12) AS QT_7_A_12_MESES,
                 count(*) FILTER (months_old > 12 AND months_old <= 18) AS QT_13_A_18_MESES,
                 count(*) FILTER (months_old > 18 AND months_old <= 24) AS QT_19_A_24_MESES,
                 count(*) FILTER (months_old > 24) AS QT_MAIOR_OU_IGUAL_25_MESES,
                 count(*) FILTER (months_old IS NULL) AS QT_DT_ATUAL_NULO FROM pes GROUP BY 1"""
        ),
    ),
    Entry(
        "b10_schooling_level",
        lambda s: s.reg.schooling.select(PERSON, schooling_level().alias("ESCOLARIDADE")),
        oracle("SELECT person AS CO_CHV_NATURAL_PESSOA, level AS ESCOLARIDADE FROM esc_level"),
    ),
    Entry(
        "b11_schooling_level_short",
        lambda s: s.reg.schooling.select(PERSON, schooling_level_short().alias("ESCOLARIDADE")),
        oracle(
            """SELECT person AS CO_CHV_NATURAL_PESSOA, CASE WHEN level IN ('EMI', 'EMC') THEN level ELSE 'OUTROS' END AS ESCOLARIDADE
               FROM esc_level"""
        ),
    ),
    Entry(
        "b12_sex_label",
        lambda s: s.reg.person.select("NU_NIS_PESSOA", sex_label(F.col("CO_SEXO_PESSOA")).alias("SEXO")),
        oracle("SELECT NU_NIS_PESSOA, sex AS SEXO FROM pes"),
    ),
    Entry(
        "b13_phone_clean",
        lambda s: s.reg.contact.select(FAMILY, "NU_TEL_CONTATO_1_FAM", phone_clean(F.col("NU_TEL_CONTATO_1_FAM")).alias("TELEFONE")),
        oracle("SELECT CO_FAMILIAR_FAM, raw_phone AS NU_TEL_CONTATO_1_FAM, phone AS TELEFONE FROM contact"),
    ),
    Entry(
        "b14_families_on_payroll",
        lambda s: families_on_payroll(s.reg.payroll, PERIOD.rf_payroll),
        oracle("SELECT CO_FAMILIAR FROM paid"),
    ),
    Entry(
        "b14_families_released",
        lambda s: families_on_payroll(s.reg.payroll, PERIOD.rf_payroll, ("LIBERADO", "L")),
        oracle("SELECT CO_FAMILIAR FROM released"),
    ),
    Entry(
        "b15_families_prequalified",
        lambda s: families_prequalified(s.reg.queue, PERIOD.rf_queue),
        oracle("SELECT CO_FAMILIAR FROM queued"),
    ),
    Entry(
        "b16_flag_membership",
        lambda s: flag_membership(
            s.reg.family.select(FAMILY),
            families_on_payroll(s.reg.payroll, PERIOD.rf_payroll),
            FAMILY,
            out="FAMILIA_NA_FOLHA_PBF",
        ),
        oracle(
            """SELECT CO_FAMILIAR_FAM, CASE WHEN CO_FAMILIAR_FAM IN (SELECT CO_FAMILIAR FROM paid) THEN 'SIM' ELSE 'NAO' END
                 AS FAMILIA_NA_FOLHA_PBF FROM TB_FAMILIA_01"""
        ),
    ),
    Entry(
        "b17_benefit_flag",
        lambda s: _situations(s).select(FAMILY, benefit_flag(has_flag("ON_PAYROLL"), F.col("SITUATION")).alias("PBF")),
        oracle(
            """SELECT CO_FAMILIAR_FAM, CASE WHEN on_payroll AND (situation IS NULL OR situation NOT IN ('SUSPENSO', 'BLOQUEADO'))
                 THEN 'TRUE' ELSE 'FALSE' END AS PBF FROM situations""",
            situations=_SITUATIONS,
        ),
    ),
    Entry(
        "b18_benefit_status",
        lambda s: _situations(s).select(
            FAMILY, benefit_status(has_flag("IN_QUEUE"), has_flag("ON_PAYROLL"), F.col("SITUATION")).alias("STATUS_PBF")
        ),
        oracle(
            """SELECT CO_FAMILIAR_FAM, CASE WHEN in_queue THEN 'PRÉ-HABILITADO' WHEN NOT on_payroll THEN NULL
                 WHEN situation IS NULL OR situation IN ('LIBERADO', 'L', 'NAO INFORMADO') THEN 'ATIVO'
                 WHEN situation = 'SUSPENSO' THEN 'SUSPENSO' WHEN situation = 'BLOQUEADO' THEN 'BLOQUEADO' END AS STATUS_PBF
               FROM situations""",
            situations=_SITUATIONS,
        ),
    ),
    Entry("b19_category", _strata, oracle("SELECT * FROM strata", strata=_STRATA)),
    Entry("b20_current_by_member_recency", lambda s: _current(s, False), _current_sql(_MEMBER_ORDER)),
    Entry("b20_current_by_family_recency", lambda s: _current(s, True), _current_sql(_FAMILY_ORDER)),
    Entry(
        "b21_cpf_person_map",
        lambda s: _text_key(cpf_person_map(s.reg.document)),
        oracle(
            """SELECT DISTINCT CAST(cpf_num AS VARCHAR) AS CPF_NUM, CO_CHV_NATURAL_PESSOA FROM doc_num WHERE cpf_num IS NOT NULL"""
        ),
    ),
    Entry(
        "b22_cpf_evidence",
        lambda s: _text_key(cpf_evidence(_trail(s))),
        oracle(
            """SELECT CAST(cpf_num AS VARCHAR) AS CPF_NUM, 1 AS FL_DOC_ENCONTRADO,
                 max(CAST(person IS NOT NULL AS INT)) AS FL_TEM_PESSOA, max(CAST(family IS NOT NULL AS INT)) AS FL_TEM_FAMILIA,
                 max(ms) AS ANY_EST_PESSOA, max(fs) AS ANY_EST_FAM, max(CASE fs WHEN 3 THEN 1 ELSE 0 END) AS FL_FAM_3,
                 max(CASE ms WHEN 3 THEN 1 ELSE 0 END) AS FL_PESSOA_3,
                 max(CASE WHEN ms = 3 AND fs = 3 THEN 1 ELSE 0 END) AS FL_MESMA_LINHA
               FROM seen GROUP BY cpf_num""",
            seen=_SEEN,
        ),
    ),
    Entry(
        "b23_payroll_flag_current_family",
        lambda s: _text_key(cpf_payroll_flag(_trail(s), "current_family")),
        oracle(
            """SELECT CAST(a.cpf_num AS VARCHAR) AS CPF_NUM, CASE WHEN c.family IN (SELECT CO_FAMILIAR FROM paid) THEN 1 ELSE 0 END AS FL_PBF,
                 CASE WHEN c.family IN (SELECT CO_FAMILIAR FROM queued) THEN 1 ELSE 0 END AS FL_PRE_HAB
               FROM (SELECT DISTINCT cpf_num FROM seen) a LEFT JOIN current_one c USING (cpf_num)""",
            seen=_SEEN,
            current_one="""SELECT * FROM seen WHERE ms = 3 AND fs = 3 QUALIFY row_number() OVER (PARTITION BY cpf_num
                ORDER BY DT_ATUAL_MEMB DESC NULLS LAST, DT_ATUALIZACAO_FAM DESC NULLS LAST, person, family) = 1""",
        ),
    ),
    Entry(
        "b23_payroll_flag_any_family",
        lambda s: _text_key(cpf_payroll_flag(_trail(s), "any_family")),
        oracle(
            """SELECT CAST(cpf_num AS VARCHAR) AS CPF_NUM, max(CASE WHEN family IN (SELECT CO_FAMILIAR FROM paid) THEN 1 ELSE 0 END) AS FL_PBF
               FROM seen GROUP BY cpf_num""",
            seen=_SEEN,
        ),
    ),
    Entry(
        "b23_payroll_flag_any_family_if_person3",
        lambda s: _text_key(cpf_payroll_flag(_trail(s), "any_family_if_person3")),
        oracle(
            """SELECT CAST(cpf_num AS VARCHAR) AS CPF_NUM, least(max(CASE WHEN family IN (SELECT CO_FAMILIAR FROM paid) THEN 1 ELSE 0 END),
                 max(CASE ms WHEN 3 THEN 1 ELSE 0 END)) AS FL_PBF FROM seen GROUP BY cpf_num""",
            seen=_SEEN,
        ),
    ),
    Entry(
        "b24_reconcile_report",
        lambda s: reconcile_report(
            s.people,
            cpf_evidence(_trail(s)).join(cpf_payroll_flag(_trail(s), "any_family"), "CPF_NUM"),
            WORDING["any_family"],
        ),
        _SQL["q22_reconcile_any_family"],
    ),
    Entry(
        "b24_reconcile_report_same_row",
        lambda s: reconcile(s.reg, s.people, PERIOD, "any_family", same_row=True),
        _REPORT_SAME_ROW,
    ),
    Entry(
        "b25_count_by_uf_with_total",
        lambda s: count_by_uf(
            active_universe(s.reg.person, s.reg.family), uf_sigla(F.col("CO_MUNIC_IBGE_2_FAM")), "persons", PERSON, True
        ),
        oracle(
            """SELECT coalesce(uf_count, 'TOTAL BRASIL') AS UF, count(DISTINCT CO_CHV_NATURAL_PESSOA) AS persons
               FROM strict GROUP BY ROLLUP (uf_count)"""
        ),
    ),
    Entry(
        "b26_stratified_sample",
        lambda s: stratified_sample(_strata(s), _SMALL_SAMPLE),
        _stratified_sql({"CAD": 100, "PRE": 88, "PBF": 63}),
    ),
    Entry(
        "b26_stratified_sample_large",
        lambda s: stratified_sample(_strata(s), _LARGE_SAMPLE),
        _stratified_sql({"CAD": 80, "PRE": 1440, "PBF": 80}),
    ),
    Entry(
        "b27_simple_sample",
        lambda s: simple_sample(_strata(s), 100),
        oracle("SELECT * FROM strata ORDER BY md5(CPF), CPF LIMIT 100", strata=_STRATA),
    ),
    Entry(
        "b27_simple_sample_large",
        lambda s: simple_sample(_strata(s), 2500),
        oracle("SELECT * FROM strata ORDER BY md5(CPF), CPF LIMIT 2500", strata=_STRATA),
    ),
    Entry(
        "b28_dossier",
        lambda s: _all_people(s).select(
            "DOC_NU_CPF_PESSOA", "PES_CO_CHV_NATURAL_PESSOA", "FAM_CO_FAMILIAR_FAM", "FAM_DT_ULT_ATUAL_FAM"
        ),
        oracle(
            """SELECT doc.NU_CPF_PESSOA AS DOC_NU_CPF_PESSOA, p.CO_CHV_NATURAL_PESSOA AS PES_CO_CHV_NATURAL_PESSOA,
                 f.CO_FAMILIAR_FAM AS FAM_CO_FAMILIAR_FAM, f.DT_ULT_ATUAL_FAM AS FAM_DT_ULT_ATUAL_FAM
               FROM TB_DOCUMENTO_05 doc, TB_PESSOA_04 p, TB_FAMILIA_01 f
               WHERE doc.CO_CHV_NATURAL_PESSOA = p.CO_CHV_NATURAL_PESSOA AND p.CO_FAMILIAR_FAM = f.CO_FAMILIAR_FAM
                 AND doc.NU_CPF_PESSOA IS NOT NULL"""
        ),
    ),
    Entry(
        "b29_latest_payroll_month",
        lambda s: latest_payroll_month(s.reg.payroll),
        oracle("SELECT max(RF_FOLHA) AS RF_FOLHA FROM VW_FOLHA_PAGAMENTO"),
    ),
]
