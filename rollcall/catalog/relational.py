"""Relational building blocks R01-R52, each shown with the library operator that carries it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.catalog.entries import PERIOD, Entry, Star
from rollcall.catalog.oracle import oracle
from rollcall.functions import (
    age_between,
    absolute_month,
    clean_cpf,
    format_cpf,
    recency_filter,
    schooling_level_short,
    sex_label,
    uf_sigla,
)
from rollcall.operators import dossier as d
from rollcall.operators.dedup import current_by_cpf
from rollcall.operators.evidence import cpf_evidence, cpf_person_map, cpf_trail
from rollcall.operators.headcount import count_by_uf
from rollcall.operators.keysets import families_on_payroll, families_prequalified, family_benefits, flag_membership, members_of
from rollcall.operators.recency import recency_buckets
from rollcall.operators.skew import join_salted
from rollcall.operators.sampling import first_per_stratum, simple_sample, take_by_relation
from rollcall.operators.sizing import measure_keys
from rollcall.operators.universe import active_universe, families_of, persons_of
from rollcall.params import Month, Period
from rollcall.plans.headcounts import (
    families_registered_and_paid,
    latest_payroll_month,
    payroll_months,
    registered_persons,
)
from rollcall.sources import SnapshotStore, count_for, people_list, rejected

PERSON, FAMILY = "CO_CHV_NATURAL_PESSOA", "CO_FAMILIAR_FAM"
_ALL_PERSON = "CO_CHV_NATURAL_PESSOA, CO_FAMILIAR_FAM, " + ", ".join(d.PERSON_ALL[2:]) + ", CO_SEXO_PESSOA"


def _snapshot_scan(s: Star) -> DataFrame:
    """Persons of one month out of a table holding many: the month of the last update stands for the snapshot."""
    day = F.coalesce("DT_ATUAL_MEMB", F.lit(PERIOD.month.first_day))
    history = s.reg.person.withColumn("anomes_ods", F.year(day) * 100 + F.month(day))
    return SnapshotStore.frames({"TB_PESSOA_04": history}).at(200006).table("TB_PESSOA_04")


def _benefits(s: Star) -> DataFrame:
    return family_benefits(s.reg.payroll, s.reg.queue, PERIOD.rf_payroll, PERIOD.rf_queue)


def _on_family(keys: DataFrame) -> DataFrame:
    return keys.withColumnRenamed("CO_FAMILIAR", FAMILY)


def _paid(s: Star) -> DataFrame:
    return _on_family(families_on_payroll(s.reg.payroll, PERIOD.rf_payroll))


def _trail(s: Star) -> DataFrame:
    return cpf_trail(cpf_person_map(s.reg.document), s.reg.person, s.reg.family, _benefits(s))


def _by_sex(s: Star) -> DataFrame:
    return s.reg.person.select("NU_NIS_PESSOA", sex_label(F.col("CO_SEXO_PESSOA")).alias("SEXO"))


def _people(s: Star) -> DataFrame:
    return s.reg.person.select("NU_NIS_PESSOA", PERSON, FAMILY)


def _listed_with_evidence(s: Star) -> DataFrame:
    evidence = cpf_evidence(_trail(s)).select("CPF_NUM", "FL_TEM_PESSOA", "FL_FAM_3")
    return join_salted(s.people, evidence, "CPF_NUM", "left").select(
        "NOME", F.coalesce("FL_TEM_PESSOA", F.lit(0)).alias("FL_TEM_PESSOA"), F.coalesce("FL_FAM_3", F.lit(0)).alias("FL_FAM_3")
    )


_SEEN = """SELECT m.cpf_num, p.CO_CHV_NATURAL_PESSOA AS person, f.CO_FAMILIAR_FAM AS family,
      p.CO_EST_CADASTRAL_MEMB AS ms, f.CO_EST_CADASTRAL_FAM AS fs
    FROM (SELECT DISTINCT cpf_num, CO_CHV_NATURAL_PESSOA FROM doc_num WHERE cpf_num IS NOT NULL) m
      LEFT JOIN TB_PESSOA_04 p USING (CO_CHV_NATURAL_PESSOA) LEFT JOIN TB_FAMILIA_01 f ON f.CO_FAMILIAR_FAM = p.CO_FAMILIAR_FAM"""


ENTRIES = [
    # Scans and sources
    Entry(
        "r01_snapshot_scan",
        _snapshot_scan,
        oracle(f"SELECT {_ALL_PERSON} FROM TB_PESSOA_04 WHERE strftime(coalesce(DT_ATUAL_MEMB, DATE '2000-06-01'), '%Y%m') = '200006'"),
    ),
    Entry(
        "r02_monthly_view_scan",
        lambda s: s.reg.payroll.where(F.col("RF_FOLHA") == PERIOD.rf_payroll),
        oracle("SELECT CO_FAMILIAR, RF_FOLHA, NO_TIPO_SITIUACAO_BEN FROM VW_FOLHA_PAGAMENTO WHERE RF_FOLHA = 200007"),
    ),
    Entry(
        "r03_caller_list",
        lambda s: people_list(s.raw_list).withColumn("CPF_NUM", F.col("CPF_NUM").cast("string")),
        oracle("SELECT NOME, CPF_RAW, CAST(cpf_num AS VARCHAR) AS CPF_NUM FROM listed"),
    ),
    Entry(
        "r51_rejected_tax_ids",
        lambda s: rejected(s.people),
        oracle(
            """SELECT NOME, CPF_RAW, CASE WHEN coalesce(digits, '') = '' THEN 'EMPTY' WHEN NOT regexp_full_match(digits, '[0-9]+') THEN 'NOT DIGITS'
                 ELSE 'TOO LONG' END AS PROBLEMA
               FROM (SELECT *, regexp_replace(CPF_RAW, '[ ./-]', '', 'g') AS digits FROM listed WHERE cpf_num IS NULL) t"""
        ),
    ),
    Entry(
        "r51_rejected_counts",
        lambda s: rejected(s.people).groupBy("PROBLEMA").agg(F.count(F.lit(1)).alias("rows")),
        oracle(
            """SELECT CASE WHEN coalesce(digits, '') = '' THEN 'EMPTY' WHEN NOT regexp_full_match(digits, '[0-9]+') THEN 'NOT DIGITS'
                 ELSE 'TOO LONG' END AS PROBLEMA, count(*) AS rows
               FROM (SELECT *, regexp_replace(CPF_RAW, '[ ./-]', '', 'g') AS digits FROM listed WHERE cpf_num IS NULL) t GROUP BY 1"""
        ),
    ),
    Entry(
        "r04_constants",
        lambda s: count_for(s.parameters, "country", s.reg.payroll, "RF_FOLHA", "RF_FOLHA_PBF", "rows").drop("UF_CD", "MUN_CD"),
        oracle(
            """SELECT a AS ANOMES_ODS, b AS RF_FOLHA_PBF, c AS RF_FOLHA_PRE, y AS REF_YM,
                 (SELECT count(*) FROM VW_FOLHA_PAGAMENTO WHERE RF_FOLHA = b) AS rows FROM prm""",
            prm="SELECT 200006 AS a, 200007 AS b, 200006 AS c, 24006 AS y",
        ),
    ),
    Entry(
        "r05_available_months",
        lambda s: payroll_months(s.reg.payroll).crossJoin(
            latest_payroll_month(s.reg.payroll).withColumnRenamed("RF_FOLHA", "LATEST")
        ),
        oracle("SELECT DISTINCT RF_FOLHA, (SELECT max(RF_FOLHA) FROM VW_FOLHA_PAGAMENTO) AS LATEST FROM VW_FOLHA_PAGAMENTO"),
    ),
    # Projection and filters
    Entry(
        "r06_prefixed_projection",
        lambda s: d.prefixed(s.reg.family, "FAM_", d.FAMILY_ALL),
        oracle("SELECT " + ", ".join(f"{c} AS FAM_{c}" for c in d.FAMILY_ALL) + " FROM TB_FAMILIA_01"),
    ),
    Entry(
        "r07_all_columns_plus_new",
        lambda s: s.reg.exclusion.withColumn("EXC_MES", absolute_month(F.col("DT_EXCLUSAO_PESSOA"))),
        oracle("SELECT *, CAST(year(DT_EXCLUSAO_PESSOA) * 12 + month(DT_EXCLUSAO_PESSOA) AS INT) AS EXC_MES FROM TB_PESSOA_EXCLUIDA_19"),
    ),
    Entry(
        "r08_equality_and_in_list",
        lambda s: s.reg.document.join(
            measure_keys(s.people.select(format_cpf(F.col("CPF_NUM")).alias("NU_CPF_PESSOA"))).hinted(),
            "NU_CPF_PESSOA",
            "left_semi",
        ).select("NU_CPF_PESSOA", PERSON),
        oracle(
            """SELECT NU_CPF_PESSOA, CO_CHV_NATURAL_PESSOA FROM TB_DOCUMENTO_05
               WHERE NU_CPF_PESSOA IN (SELECT lpad(CAST(cpf_num AS VARCHAR), 11, '0') FROM listed)"""
        ),
    ),
    Entry(
        "r09_not_in",
        lambda s: families_of(s.reg.family, "strict").select(FAMILY),
        oracle("SELECT CO_FAMILIAR_FAM FROM TB_FAMILIA_01 WHERE CO_EST_CADASTRAL_FAM NOT IN (1, 2, 4)"),
    ),
    Entry(
        "r10_not_equal",
        lambda s: families_of(s.reg.family, "eligible").select(FAMILY),
        oracle(
            """SELECT CO_FAMILIAR_FAM FROM TB_FAMILIA_01 WHERE CO_EST_CADASTRAL_FAM NOT IN (1, 2, 4)
                 AND IN_CADASTRO_VALIDO_FAM <> 2 AND CO_CONDICAO_CADASTRO_FAM <> 6"""
        ),
    ),
    Entry(
        "r11_between",
        lambda s: s.reg.person.where(age_between(F.col("DT_NASC_PESSOA"), 18, 65, PERIOD.as_of)).select("NU_NIS_PESSOA"),
        oracle("SELECT NU_NIS_PESSOA FROM pes WHERE age BETWEEN 18 AND 65"),
    ),
    Entry(
        "r12_null_tests",
        lambda s: s.reg.person.where(F.col("DT_ATUAL_MEMB").isNull()).select("NU_NIS_PESSOA"),
        oracle("SELECT NU_NIS_PESSOA FROM TB_PESSOA_04 WHERE DT_ATUAL_MEMB IS NULL"),
    ),
    Entry(
        "r13_like_prefix",
        lambda s: s.reg.contact.where(F.col("NU_TEL_CONTATO_1_FAM").startswith("0")).select(FAMILY),
        oracle("SELECT CO_FAMILIAR_FAM FROM TB_CONTATO_09 WHERE NU_TEL_CONTATO_1_FAM LIKE '0%'"),
    ),
    Entry(
        "r14_searched_case",
        lambda s: s.reg.schooling.groupBy(schooling_level_short().alias("ESCOLARIDADE")).agg(F.count(F.lit(1)).alias("persons")),
        oracle(
            """SELECT CASE WHEN level IN ('EMI', 'EMC') THEN level ELSE 'OUTROS' END AS ESCOLARIDADE, count(*) AS persons
               FROM esc_level GROUP BY 1"""
        ),
    ),
    Entry(
        "r15_simple_case",
        lambda s: _by_sex(s).groupBy("SEXO").agg(F.count(F.lit(1)).alias("persons")),
        oracle("SELECT sex AS SEXO, count(*) AS persons FROM pes GROUP BY 1"),
    ),
    Entry(
        "r16_filter_on_derived",
        lambda s: s.reg.schooling.withColumn("ESCOLARIDADE", schooling_level_short())
        .where(F.col("ESCOLARIDADE").isin("EMI", "EMC"))
        .select(PERSON, "ESCOLARIDADE"),
        oracle("SELECT person AS CO_CHV_NATURAL_PESSOA, level AS ESCOLARIDADE FROM esc_level WHERE level IN ('EMI', 'EMC')"),
    ),
    Entry(
        "r17_filter_by_parameter",
        lambda s: s.reg.person.where(recency_filter(F.col("DT_ATUAL_MEMB"), PERIOD.anomes_ods, None, 12)).select("NU_NIS_PESSOA"),
        oracle(
            "SELECT NU_NIS_PESSOA FROM pes, prm WHERE months_old <= prm.hi", prm="SELECT 12 AS hi"
        ),
    ),
    Entry(
        "r18_quota_disjunction",
        lambda s: first_per_stratum(_by_sex(s), {"Masculino": 60, "Feminino": 40}, "NU_NIS_PESSOA", "SEXO", "RN"),
        oracle(
            "SELECT NU_NIS_PESSOA, SEXO, RN FROM r WHERE (SEXO = 'Masculino' AND RN <= 60) OR (SEXO = 'Feminino' AND RN <= 40)",
            r="""SELECT NU_NIS_PESSOA, sex AS SEXO, CAST(row_number() OVER (PARTITION BY sex ORDER BY md5(NU_NIS_PESSOA), NU_NIS_PESSOA) AS INT) AS RN
                 FROM pes""",
        ),
    ),
    # Joins
    Entry(
        "r19_join_person_family",
        lambda s: active_universe(s.reg.person, s.reg.family, "all", ("NU_NIS_PESSOA",), ("NO_LOCALIDADE_FAM",)),
        oracle("SELECT CO_FAMILIAR_FAM, NU_NIS_PESSOA, NO_LOCALIDADE_FAM FROM TB_PESSOA_04 JOIN TB_FAMILIA_01 USING (CO_FAMILIAR_FAM)"),
    ),
    Entry(
        "r20_join_document_person",
        lambda s: s.reg.document.select(PERSON, "NU_CPF_PESSOA").join(s.reg.person.select(PERSON, "NU_NIS_PESSOA"), PERSON),
        oracle("SELECT CO_CHV_NATURAL_PESSOA, NU_CPF_PESSOA, NU_NIS_PESSOA FROM TB_DOCUMENTO_05 JOIN TB_PESSOA_04 USING (CO_CHV_NATURAL_PESSOA)"),
    ),
    Entry(
        "r21_left_join",
        lambda s: _people(s)
        .join(s.reg.contact.select(FAMILY, "NU_DDD_CONTATO_1_FAM"), FAMILY, "left")
        .join(s.reg.exclusion.select(PERSON, "CO_MOTIVO_EXCLUSAO"), PERSON, "left")
        .select("NU_NIS_PESSOA", "NU_DDD_CONTATO_1_FAM", "CO_MOTIVO_EXCLUSAO"),
        oracle(
            """SELECT NU_NIS_PESSOA, NU_DDD_CONTATO_1_FAM, CO_MOTIVO_EXCLUSAO FROM TB_PESSOA_04 p
               LEFT JOIN TB_CONTATO_09 USING (CO_FAMILIAR_FAM) LEFT JOIN TB_PESSOA_EXCLUIDA_19 USING (CO_CHV_NATURAL_PESSOA)"""
        ),
    ),
    Entry(
        "r22_existence_flag",
        lambda s: flag_membership(
            _people(s), families_prequalified(s.reg.queue, PERIOD.rf_queue), FAMILY, out="FL_PRE_HAB", yes=1, no=0
        ).select("NU_NIS_PESSOA", "FL_PRE_HAB"),
        oracle(
            """SELECT NU_NIS_PESSOA, CASE WHEN EXISTS (SELECT 1 FROM queued q WHERE q.CO_FAMILIAR = p.CO_FAMILIAR_FAM) THEN 1 ELSE 0 END
                 AS FL_PRE_HAB FROM TB_PESSOA_04 p"""
        ),
    ),
    Entry(
        "r23_semi_join",
        lambda s: members_of(_people(s), _paid(s), FAMILY, FAMILY).select("NU_NIS_PESSOA"),
        oracle("SELECT NU_NIS_PESSOA FROM TB_PESSOA_04 JOIN paid ON CO_FAMILIAR = CO_FAMILIAR_FAM"),
    ),
    Entry(
        "r24_anti_join",
        lambda s: members_of(_people(s), _paid(s), FAMILY, FAMILY, absent=True).select("NU_NIS_PESSOA"),
        oracle("SELECT NU_NIS_PESSOA FROM TB_PESSOA_04 p WHERE NOT EXISTS (SELECT 1 FROM paid x WHERE x.CO_FAMILIAR = p.CO_FAMILIAR_FAM)"),
    ),
    Entry(
        "r25_join_to_one_row",
        lambda s: s.reg.family.select(FAMILY, "CO_EST_CADASTRAL_FAM").crossJoin(
            F.broadcast(s.reg.family.agg(F.max("DT_ULT_ATUAL_FAM").alias("NEWEST")))
        ),
        oracle(
            """SELECT CO_FAMILIAR_FAM, CO_EST_CADASTRAL_FAM, NEWEST FROM TB_FAMILIA_01
               CROSS JOIN (SELECT max(DT_ULT_ATUAL_FAM) AS NEWEST FROM TB_FAMILIA_01) t"""
        ),
    ),
    Entry(
        "r26_join_view_to_parameters",
        lambda s: families_on_payroll(s.reg.payroll, Period(200011).rf_payroll),
        oracle(
            "SELECT DISTINCT CO_FAMILIAR FROM VW_FOLHA_PAGAMENTO JOIN prm ON RF_FOLHA = rf", prm="SELECT 200012 AS rf"
        ),
    ),
    Entry(
        "r27_list_to_aggregates",
        _listed_with_evidence,
        oracle(
            """SELECT l.NOME, coalesce(a.p, 0) AS FL_TEM_PESSOA, coalesce(a.f, 0) AS FL_FAM_3 FROM listed l LEFT JOIN
               (SELECT cpf_num, max(CASE WHEN person IS NULL THEN 0 ELSE 1 END) AS p, max(CASE fs WHEN 3 THEN 1 ELSE 0 END) AS f
                FROM seen GROUP BY 1) a ON a.cpf_num = l.cpf_num""",
            seen=_SEEN,
        ),
    ),
    Entry(
        "r28_state_carried_through_join",
        lambda s: active_universe(s.reg.person, s.reg.family).select(PERSON, FAMILY, "CO_MUNIC_IBGE_2_FAM").distinct(),
        oracle(
            """SELECT u.CO_CHV_NATURAL_PESSOA, u.CO_FAMILIAR_FAM, f.CO_MUNIC_IBGE_2_FAM
               FROM (SELECT DISTINCT CO_CHV_NATURAL_PESSOA, CO_FAMILIAR_FAM FROM strict) u JOIN TB_FAMILIA_01 f USING (CO_FAMILIAR_FAM)"""
        ),
    ),
    # Aggregation
    Entry(
        "r29_count_rows",
        lambda s: active_universe(s.reg.person, s.reg.family).agg(F.count(F.lit(1)).alias("rows")),
        oracle("SELECT count(*) AS rows FROM strict"),
    ),
    Entry(
        "r30_count_distinct",
        lambda s: registered_persons(s.reg),
        oracle("SELECT count(DISTINCT CO_CHV_NATURAL_PESSOA) AS QT_PESSOAS_CADASTRADAS FROM strict"),
    ),
    Entry(
        "r31_grouped_count_distinct",
        lambda s: count_by_uf(
            active_universe(s.reg.person, s.reg.family, "both3"), uf_sigla(F.col("CO_MUNIC_IBGE_2_FAM")), "persons", PERSON
        ),
        oracle(
            "SELECT uf_count AS UF, count(DISTINCT CO_CHV_NATURAL_PESSOA) AS persons FROM strict WHERE CO_EST_CADASTRAL_FAM = 3 GROUP BY 1"
        ),
    ),
    Entry(
        "r32_grouped_count",
        lambda s: count_by_uf(active_universe(s.reg.person, s.reg.family), uf_sigla(F.col("CO_MUNIC_IBGE_2_FAM")), "rows"),
        oracle("SELECT uf_count AS UF, count(*) AS rows FROM strict GROUP BY 1"),
    ),
    Entry(
        "r33_conditional_sums",
        lambda s: recency_buckets(
            persons_of(s.reg.person, "strict"),
            F.lit(PERIOD.month.absolute) - absolute_month(F.col("DT_ATUAL_MEMB")),
            ["CO_SEXO_PESSOA"],
            "QT_TOTAL",
        ),
        oracle(
            """SELECT CO_SEXO_PESSOA, count(*) AS QT_TOTAL,
                 CAST(sum(CASE WHEN months_old IN (0, 1, 2, 3, 4, 5, 6) THEN 1 ELSE 0 END) AS BIGINT) AS QT_0_A_6_MESES,
                 CAST(sum(CASE WHEN months_old BETWEEN 7 AND 12 THEN 1 ELSE 0 END) AS BIGINT) AS QT_7_A_12_MESES,
                 CAST(sum(CASE WHEN months_old BETWEEN 13 AND 18 THEN 1 ELSE 0 END) AS BIGINT) AS QT_13_A_18_MESES,
                 CAST(sum(CASE WHEN months_old BETWEEN 19 AND 24 THEN 1 ELSE 0 END) AS BIGINT) AS QT_19_A_24_MESES,
                 CAST(sum(CASE WHEN months_old >= 25 THEN 1 ELSE 0 END) AS BIGINT) AS QT_MAIOR_OU_IGUAL_25_MESES,
                 CAST(sum(CASE WHEN months_old IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS QT_DT_ATUAL_NULO
               FROM pes WHERE CO_EST_CADASTRAL_MEMB = 3 GROUP BY 1"""
        ),
    ),
    Entry(
        "r34_conditional_max_flag",
        lambda s: cpf_evidence(_trail(s)).select(F.col("CPF_NUM").cast("string").alias("CPF_NUM"), "FL_FAM_3", "FL_PESSOA_3"),
        oracle(
            """SELECT CAST(cpf_num AS VARCHAR) AS CPF_NUM, CAST(coalesce(bool_or(fs = 3), false) AS INT) AS FL_FAM_3,
                 CAST(coalesce(bool_or(ms = 3), false) AS INT) AS FL_PESSOA_3 FROM seen GROUP BY cpf_num""",
            seen=_SEEN,
        ),
    ),
    Entry(
        "r35_max_representative",
        lambda s: cpf_evidence(_trail(s)).select(F.col("CPF_NUM").cast("string").alias("CPF_NUM"), "ANY_EST_PESSOA", "ANY_EST_FAM"),
        oracle(
            "SELECT CAST(cpf_num AS VARCHAR) AS CPF_NUM, max(ms) AS ANY_EST_PESSOA, max(fs) AS ANY_EST_FAM FROM seen GROUP BY cpf_num",
            seen=_SEEN,
        ),
    ),
    Entry(
        "r36_case_over_aggregates",
        lambda s: s.reg.payroll.groupBy("CO_FAMILIAR").agg(
            F.when(F.max(F.when(F.col("RF_FOLHA") == PERIOD.rf_payroll, 1).otherwise(0)) == 0, "FORA")
            .otherwise(F.max("NO_TIPO_SITIUACAO_BEN"))
            .alias("situation")
        ),
        oracle(
            """SELECT CO_FAMILIAR, CASE WHEN count(*) FILTER (RF_FOLHA = 200007) = 0 THEN 'FORA' ELSE max(NO_TIPO_SITIUACAO_BEN) END AS situation
               FROM VW_FOLHA_PAGAMENTO GROUP BY 1"""
        ),
    ),
    Entry(
        "r37_rollup_total",
        lambda s: count_by_uf(s.reg.family, uf_sigla(F.col("CO_MUNIC_IBGE_2_FAM")), "families", total_row=True),
        oracle(
            """SELECT CASE WHEN grouping(uf_count) = 1 THEN 'TOTAL BRASIL' ELSE uf_count END AS UF, count(*) AS families
               FROM fam GROUP BY ROLLUP (uf_count)"""
        ),
    ),
    Entry(
        "r38_group_by_position",
        lambda s: s.spark.sql(
            "SELECT CO_SEXO_PESSOA, count(*) AS persons FROM {person} GROUP BY 1", person=s.reg.person
        ),
        oracle("SELECT CO_SEXO_PESSOA, count(*) AS persons FROM TB_PESSOA_04 GROUP BY CO_SEXO_PESSOA"),
    ),
    Entry(
        "r39_aggregates_side_by_side",
        lambda s: families_registered_and_paid(s.reg, PERIOD),
        oracle(
            """SELECT count(*) AS Familias_inscritas_CadUnico, count(p.CO_FAMILIAR) AS Familias_inscritas_BolsaFamilia
               FROM (SELECT DISTINCT CO_FAMILIAR_FAM FROM strict) u LEFT JOIN paid p ON p.CO_FAMILIAR = u.CO_FAMILIAR_FAM"""
        ),
    ),
    Entry(
        "r40_scalar_subquery",
        lambda s: families_prequalified(s.reg.queue, Month(200006).plus(1).yyyymm),
        oracle(
            "SELECT DISTINCT CO_FAMILIAR FROM VW_PRE_HABILITACAO_PBF WHERE RF_FOLHA = (SELECT ods + 1 FROM prm)",
            prm="SELECT 200006 AS ods",
        ),
    ),
    Entry(
        "r41_distinct",
        lambda s: s.reg.payroll.select("CO_FAMILIAR", "RF_FOLHA").distinct(),
        oracle("SELECT DISTINCT CO_FAMILIAR, RF_FOLHA FROM VW_FOLHA_PAGAMENTO"),
    ),
    # Windows
    Entry(
        "r42_keep_best_per_key",
        lambda s: current_by_cpf(
            s.reg.person,
            [F.col("DT_ATUAL_MEMB").desc_nulls_last(), F.col("NU_NIS_PESSOA").asc_nulls_first()],
            FAMILY,
        ).select(FAMILY, "NU_NIS_PESSOA", "DT_ATUAL_MEMB"),
        oracle(
            """SELECT CO_FAMILIAR_FAM, NU_NIS_PESSOA, DT_ATUAL_MEMB FROM TB_PESSOA_04
               QUALIFY row_number() OVER (PARTITION BY CO_FAMILIAR_FAM ORDER BY DT_ATUAL_MEMB DESC NULLS LAST, NU_NIS_PESSOA NULLS FIRST) = 1"""
        ),
    ),
    Entry(
        "r43_ranked_then_filtered",
        lambda s: s.reg.person.withColumn(
            "RN", F.row_number().over(Window.partitionBy(FAMILY).orderBy(F.col("DT_NASC_PESSOA").asc_nulls_last(), "NU_NIS_PESSOA"))
        )
        .where(F.col("RN") == 1)
        .select(FAMILY, "NU_NIS_PESSOA"),
        oracle(
            """SELECT CO_FAMILIAR_FAM, NU_NIS_PESSOA FROM (SELECT *, row_number() OVER (PARTITION BY CO_FAMILIAR_FAM
                 ORDER BY DT_NASC_PESSOA NULLS LAST, NU_NIS_PESSOA) AS rn FROM TB_PESSOA_04) t WHERE rn = 1"""
        ),
    ),
    Entry(
        "r44_rank_per_category_by_hash",
        lambda s: first_per_stratum(
            _by_sex(s), {"Masculino": 1500, "Feminino": 1200, "Não informado": 2000}, "NU_NIS_PESSOA", "SEXO", "RN"
        ),
        oracle(
            """SELECT NU_NIS_PESSOA, SEXO, RN FROM r
               WHERE RN <= CASE SEXO WHEN 'Masculino' THEN 1500 WHEN 'Feminino' THEN 1200 ELSE 2000 END""",
            r="""SELECT NU_NIS_PESSOA, sex AS SEXO, CAST(row_number() OVER (PARTITION BY sex ORDER BY md5(NU_NIS_PESSOA), NU_NIS_PESSOA) AS INT) AS RN
                 FROM pes""",
        ),
    ),
    Entry(
        "r45_global_rank_by_hash",
        lambda s: simple_sample(s.reg.person.select("NU_NIS_PESSOA", PERSON), 500, "NU_NIS_PESSOA"),
        oracle(
            """SELECT NU_NIS_PESSOA, CO_CHV_NATURAL_PESSOA FROM TB_PESSOA_04
               QUALIFY row_number() OVER (ORDER BY md5(NU_NIS_PESSOA), NU_NIS_PESSOA) <= 500"""
        ),
    ),
    # Sort, limit, sampling
    Entry(
        "r46_order_by",
        lambda s: s.reg.person.select("NO_PESSOA", PERSON, FAMILY).orderBy(
            F.col("NO_PESSOA").asc(), F.col(PERSON).desc(), FAMILY
        ),
        oracle("SELECT NO_PESSOA, CO_CHV_NATURAL_PESSOA, CO_FAMILIAR_FAM FROM TB_PESSOA_04 ORDER BY 1, 2 DESC, 3"),
    ),
    Entry(
        "r47_simple_random_sample",
        lambda s: simple_sample(s.reg.person.select("NU_NIS_PESSOA", FAMILY), 100, "NU_NIS_PESSOA"),
        oracle("SELECT NU_NIS_PESSOA, CO_FAMILIAR_FAM FROM TB_PESSOA_04 ORDER BY md5(NU_NIS_PESSOA), NU_NIS_PESSOA LIMIT 100"),
    ),
    Entry(
        "r47_seeded_samples",
        lambda s: simple_sample(s.reg.person.select("NU_NIS_PESSOA", FAMILY), 100, "NU_NIS_PESSOA", seed=1).unionByName(
            simple_sample(s.reg.person.select("NU_NIS_PESSOA", FAMILY), 100, "NU_NIS_PESSOA", seed=2)
        ),
        oracle(
            """SELECT NU_NIS_PESSOA, CO_FAMILIAR_FAM FROM TB_PESSOA_04, (VALUES ('1:'), ('2:')) seeds(seed)
               QUALIFY row_number() OVER (PARTITION BY seed ORDER BY md5(concat(seed, NU_NIS_PESSOA)), NU_NIS_PESSOA) <= 100"""
        ),
    ),
    Entry(
        "r48_hash_ordered_pick",
        lambda s: first_per_stratum(
            s.reg.payroll.where(F.col("RF_FOLHA") == PERIOD.rf_payroll)
            .select("CO_FAMILIAR", F.coalesce("NO_TIPO_SITIUACAO_BEN", F.lit("-")).alias("CATEGORIA"))
            .distinct(),
            {"LIBERADO": 50, "SUSPENSO": 30, "-": 20},
            "CO_FAMILIAR",
        ),
        oracle(
            "SELECT CO_FAMILIAR, CATEGORIA, RN_CAT FROM r JOIN (VALUES ('LIBERADO', 50), ('SUSPENSO', 30), ('-', 20)) q(CATEGORIA, n) USING (CATEGORIA) WHERE RN_CAT <= n",
            r="""SELECT CO_FAMILIAR, CATEGORIA,
                   CAST(row_number() OVER (PARTITION BY CATEGORIA ORDER BY md5(CAST(CO_FAMILIAR AS VARCHAR)), CO_FAMILIAR) AS INT) AS RN_CAT
                 FROM (SELECT DISTINCT CO_FAMILIAR, coalesce(NO_TIPO_SITIUACAO_BEN, '-') AS CATEGORIA FROM VW_FOLHA_PAGAMENTO WHERE RF_FOLHA = 200007) t""",
        ),
    ),
    Entry(
        "r49_limit_from_relation",
        lambda s: take_by_relation(
            s.reg.person.select("NU_NIS_PESSOA"),
            families_prequalified(s.reg.queue, PERIOD.rf_queue).agg(F.count(F.lit(1)).alias("NEED_EXTRA")),
            "NEED_EXTRA",
            "NU_NIS_PESSOA",
        ),
        oracle(
            """SELECT NU_NIS_PESSOA FROM (SELECT NU_NIS_PESSOA, row_number() OVER (ORDER BY md5(NU_NIS_PESSOA), NU_NIS_PESSOA) AS rn
                 FROM TB_PESSOA_04) t JOIN (SELECT count(*) AS need FROM queued) n ON rn <= need"""
        ),
    ),
    # Set operations and clean-up
    Entry(
        "r50_union_all",
        lambda s: families_on_payroll(s.reg.payroll, PERIOD.rf_payroll)
        .withColumn("ORIGEM", F.lit("PBF"))
        .unionByName(families_prequalified(s.reg.queue, PERIOD.rf_queue).withColumn("ORIGEM", F.lit("PRE"))),
        oracle("SELECT CO_FAMILIAR, 'PBF' AS ORIGEM FROM paid UNION ALL SELECT CO_FAMILIAR, 'PRE' FROM queued"),
    ),
    Entry(
        "r51_fill_column",
        lambda s: s.raw_list.withColumn("CPF_NUM", clean_cpf(F.col("CPF_RAW")).cast("string")),
        oracle("SELECT NOME, CPF_RAW, CAST(cpf_num AS VARCHAR) AS CPF_NUM FROM listed"),
    ),
    Entry(
        "r52_parameter_row",
        lambda s: count_for(s.parameters, "state", s.reg.family, "CO_MUNIC_IBGE_2_FAM", "UF_CD", "families").select("ANOMES_ODS", "UF_CD", "families"),
        oracle(
            "SELECT ANOMES_ODS, UF_CD, (SELECT count(*) FROM TB_FAMILIA_01 WHERE CO_MUNIC_IBGE_2_FAM = UF_CD) AS families FROM prm",
            prm="SELECT 200006 AS ANOMES_ODS, 35 AS UF_CD",
        ),
    ),
]
