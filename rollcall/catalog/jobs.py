"""The complete reports Q01-Q24 over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.catalog.entries import NEXT_QUEUE, PERIOD, Entry, Star
from rollcall.catalog.oracle import oracle, within_quota
from rollcall.functions import format_cpf
from rollcall.operators import dossier as d
from rollcall.params import CandidateRules, SamplePlan, Territory
from rollcall.plans import dossiers, extractions, headcounts, reconciliation

TOWN = Territory.from_codibge("3500158")
STATE = Territory(35)
ONE_CPF = "00000000700"


def _prefixed(alias: str, prefix: str, columns: tuple[str, ...]) -> str:
    return ", ".join(f"{alias}.{c} AS {prefix}{c}" for c in columns)


_DOC_PES_FAM = "TB_DOCUMENTO_05 doc JOIN TB_PESSOA_04 p USING (CO_CHV_NATURAL_PESSOA) JOIN fam f ON f.CO_FAMILIAR_FAM = p.CO_FAMILIAR_FAM"
_CONTACTS = ", ".join(f"c.{column} AS {short}" for column, short in d.CONTACT_NAMES.items())
_DOC_KEYS = _prefixed("doc", "DOC_", d.DOCUMENT_KEYS)
_DOC_ALL = _prefixed("doc", "DOC_", d.DOCUMENT_ALL)
_PES_ALL = _prefixed("p", "PES_", d.PERSON_ALL)
_FAM_ALL = _prefixed("f", "FAM_", d.FAMILY_ALL)

_CURRENT_FIRST = """p.DT_ATUAL_MEMB DESC NULLS LAST, f.DT_ATUALIZACAO_FAM DESC NULLS LAST,
                    p.CO_CHV_NATURAL_PESSOA NULLS FIRST, f.CO_FAMILIAR_FAM NULLS FIRST"""
_FAMILY_FIRST = "f.DT_ULT_ATUAL_FAM DESC NULLS LAST, p.CO_CHV_NATURAL_PESSOA NULLS FIRST, f.CO_FAMILIAR_FAM NULLS FIRST"

_HEAD = """p.NU_NIS_PESSOA AS NIS, p.NO_PESSOA AS NOME, p.sex AS SEXO, p.DT_NASC_PESSOA AS DT_NASC, CAST(p.age AS INT) AS IDADE"""


def _place(town: str) -> str:
    return f"f.uf_report AS UF, {town} AS MUNICIPIO, f.ibge7 AS CODIBGE, '---' AS REGIAO, f.NO_LOCALIDADE_FAM AS BAIRRO"


_PEOPLE = """pes p JOIN fam f ON f.CO_FAMILIAR_FAM = p.CO_FAMILIAR_FAM
          JOIN TB_DOCUMENTO_05 doc ON doc.CO_CHV_NATURAL_PESSOA = p.CO_CHV_NATURAL_PESSOA AND doc.NU_CPF_PESSOA IS NOT NULL
          LEFT JOIN esc_level e ON e.person = p.CO_CHV_NATURAL_PESSOA
          LEFT JOIN contact c ON c.CO_FAMILIAR_FAM = f.CO_FAMILIAR_FAM"""
_LEVEL = "coalesce(e.level, 'Não Informado')"


_LISTED = "doc.NU_CPF_PESSOA IN (SELECT lpad(CAST(cpf_num AS VARCHAR), 11, '0') FROM listed)"
_SECTION_ALIAS = {"DOC_": "doc.", "PES_": "p.", "FAM_": "f."}


def _listed_texts(star: Star) -> DataFrame:
    """Tax ids of the caller's list in text form."""
    return star.people.select(format_cpf(F.col("CPF_NUM")).alias("CPF"))


def _batch_sql() -> str:
    return ", ".join(f"{_SECTION_ALIAS[c[:4]]}{c[4:]} AS {name}" for name, c in dossiers.BATCH_COLUMNS.items())


# Q01 stratified sample ------------------------------------------------------------------------------
_SAMPLE = SamplePlan(total=12)
_SAMPLE_SQL = oracle(
    "SELECT * EXCLUDE (family, nth, place) FROM drawn WHERE " + within_quota({"CAD": 5, "PRE": 5, "PBF": 3}, "CAD"),
    town_people=f"""SELECT doc.NU_CPF_PESSOA AS CPF, {_HEAD}, {_LEVEL} AS ESCOLARIDADE, {_place("'Vila Nova'")},
          c.ddd AS DDD, c.phone AS TELEFONE, f.CO_FAMILIAR_FAM AS family,
          row_number() OVER (PARTITION BY doc.NU_CPF_PESSOA ORDER BY {_FAMILY_FIRST}) AS nth
        FROM {_PEOPLE}
        WHERE p.age BETWEEN 18 AND 65 AND f.CO_EST_CADASTRAL_FAM = 3 AND f.IN_CADASTRO_VALIDO_FAM = 1
          AND f.ibge7 = '3500158' AND p.months_old <= 12""",
    classed="""SELECT t.*, CASE WHEN family IN (SELECT CO_FAMILIAR FROM queued_next) THEN 'PRE'
                              WHEN family IN (SELECT CO_FAMILIAR FROM released) THEN 'PBF' ELSE 'CAD' END AS CATEGORIA
        FROM town_people t WHERE nth = 1""",
    drawn="SELECT *, row_number() OVER (PARTITION BY CATEGORIA ORDER BY md5(CPF), CPF) AS place FROM classed",
)

# Q16 current records of a municipality --------------------------------------------------------------
_CURRENT_SQL = oracle(
    """SELECT r.* EXCLUDE (nth, family),
         CASE WHEN EXISTS (SELECT 1 FROM paid x WHERE x.CO_FAMILIAR = r.family) THEN 'SIM' ELSE 'NAO' END AS FAMILIA_NA_FOLHA_PBF,
         CASE WHEN EXISTS (SELECT 1 FROM queued x WHERE x.CO_FAMILIAR = r.family) THEN 'SIM' ELSE 'NAO' END AS FAMILIA_PRE_HABILITADA
       FROM ranked r WHERE nth = 1""",
    ranked=f"""SELECT doc.NU_CPF_PESSOA AS CPF, {_DOC_ALL}, {_PES_ALL}, {_LEVEL} AS ESCOLARIDADE, {_FAM_ALL}, {_CONTACTS},
          p.DT_ATUAL_MEMB AS ORD_DT_ATUAL_MEMB, f.DT_ATUALIZACAO_FAM AS ORD_DT_ATUALIZACAO_FAM,
          p.CO_CHV_NATURAL_PESSOA AS ORD_CHAVE_PESSOA, f.CO_FAMILIAR_FAM AS family,
          row_number() OVER (PARTITION BY doc.NU_CPF_PESSOA ORDER BY {_CURRENT_FIRST}) AS nth
        FROM TB_DOCUMENTO_05 doc JOIN TB_PESSOA_04 p ON p.CO_CHV_NATURAL_PESSOA = doc.CO_CHV_NATURAL_PESSOA
          JOIN fam f ON f.CO_FAMILIAR_FAM = p.CO_FAMILIAR_FAM
          LEFT JOIN esc_level e ON e.person = p.CO_CHV_NATURAL_PESSOA
          LEFT JOIN TB_CONTATO_09 c ON c.CO_FAMILIAR_FAM = p.CO_FAMILIAR_FAM
        WHERE f.ibge7 = '3500158' AND doc.NU_CPF_PESSOA IS NOT NULL
          AND p.CO_EST_CADASTRAL_MEMB = 3 AND f.CO_EST_CADASTRAL_FAM NOT IN (1, 2, 4)""",
)

# Q19, Q20, Q23 candidates ---------------------------------------------------------------------------
_STATE_RULES = CandidateRules(age=(16, 60), months_since_update=(0, 60), schooling=("EMC", "EMI"))
def _sampled(sql: str, key: str, n: int, seed: int | None = None) -> str:
    """The first ``n`` rows of a statement by the hash of the tax id."""
    text = key if seed is None else f"'{seed}:' || {key}"
    return f"SELECT * FROM ({sql}) ORDER BY md5({text}), {key} LIMIT {n}"


_STATE_SQL = oracle(
    """SELECT lpad(CAST(cpf_num AS VARCHAR), 11, '0') AS CPF, * EXCLUDE (cpf_num, nth, family),
         CASE FL_PRE_HAB WHEN 1 THEN 'PRE' ELSE CASE FL_PBF WHEN 1 THEN 'PBF' ELSE 'CAD' END END AS categoria
       FROM (SELECT r.*, CAST(family IN (SELECT CO_FAMILIAR FROM paid) AS INT) AS FL_PBF,
                    CAST(family IN (SELECT CO_FAMILIAR FROM queued) AS INT) AS FL_PRE_HAB
             FROM ranked r WHERE nth = 1) z
       WHERE ESCOLARIDADE IN ('EMC', 'EMI')""",
    ranked=f"""SELECT doc.cpf_num, {_HEAD}, CASE WHEN e.level IN ('EMI', 'EMC') THEN e.level ELSE 'OUTROS' END AS ESCOLARIDADE,
          {_place("CAST(f.CO_MUNIC_IBGE_5_FAM AS VARCHAR)")}, c.ddd AS DDD, c.phone AS TELEFONE,
          p.DT_ATUAL_MEMB, f.DT_ATUALIZACAO_FAM, f.CO_FAMILIAR_FAM AS family,
          row_number() OVER (PARTITION BY coalesce(CAST(doc.cpf_num AS VARCHAR), doc.NU_CPF_PESSOA) ORDER BY {_CURRENT_FIRST}) AS nth
        FROM {_PEOPLE.replace("TB_DOCUMENTO_05", "doc_num")}
        WHERE f.CO_EST_CADASTRAL_FAM NOT IN (1, 2, 4) AND p.CO_EST_CADASTRAL_MEMB = 3 AND f.CO_MUNIC_IBGE_2_FAM = 35
          AND p.age BETWEEN 16 AND 60 AND p.months_old BETWEEN 0 AND 60""",
)
_ELIGIBLE_RULES = CandidateRules(age=(16, 60), months_since_update=(0, 48), schooling=("EMI", "EMC", "EFC"))
_ELIGIBLE_SQL = oracle(
    """SELECT * EXCLUDE (nth, family), CAST(family IN (SELECT CO_FAMILIAR FROM paid) AS INT) AS FL_PBF,
         CAST(family IN (SELECT CO_FAMILIAR FROM queued) AS INT) AS FL_PRE_HAB
       FROM ranked WHERE nth = 1""",
    ranked=f"""SELECT doc.NU_CPF_PESSOA AS CPF, {_HEAD}, e.level AS ESCOLARIDADE, f.NO_LOCALIDADE_FAM AS BAIRRO,
          c.ddd AS DDD, c.phone AS TELEFONE, p.DT_ATUAL_MEMB, f.DT_ATUALIZACAO_FAM, f.CO_FAMILIAR_FAM AS family,
          row_number() OVER (PARTITION BY doc.NU_CPF_PESSOA ORDER BY {_CURRENT_FIRST}) AS nth
        FROM {_PEOPLE}
        WHERE e.level IN ('EMI', 'EMC', 'EFC') AND p.age BETWEEN 16 AND 60 AND p.months_old BETWEEN 0 AND 48
          AND f.CO_EST_CADASTRAL_FAM NOT IN (1, 2, 4) AND p.CO_EST_CADASTRAL_MEMB = 3
          AND f.IN_CADASTRO_VALIDO_FAM <> 2 AND f.CO_CONDICAO_CADASTRO_FAM <> 6 AND f.CO_MUNIC_IBGE_2_FAM = 35""",
)


def status_sql(payroll_month: str, queue_month: str, limit: str = "") -> str:
    """One situation per family by precedence, then status and flag per current record."""
    return oracle(
        f"""SELECT r.* EXCLUDE (nth, family),
             CASE WHEN s.family IS NULL OR s.situation IN ('SUSPENSO', 'BLOQUEADO') THEN 'FALSE' ELSE 'TRUE' END AS PBF,
             CASE WHEN r.family IN (SELECT CO_FAMILIAR FROM VW_PRE_HABILITACAO_PBF WHERE {queue_month}) THEN 'PRÉ-HABILITADO'
                  WHEN s.family IS NULL THEN NULL
                  WHEN coalesce(s.situation, 'L') IN ('LIBERADO', 'L', 'NAO INFORMADO') THEN 'ATIVO'
                  WHEN s.situation IN ('SUSPENSO', 'BLOQUEADO') THEN s.situation END AS STATUS_PBF
           FROM ranked r LEFT JOIN situations s ON s.family = r.family WHERE nth = 1 {limit}""",
        situations=f"""SELECT CO_FAMILIAR AS family, NO_TIPO_SITIUACAO_BEN AS situation FROM VW_FOLHA_PAGAMENTO WHERE {payroll_month}
            QUALIFY row_number() OVER (PARTITION BY CO_FAMILIAR ORDER BY
              CASE WHEN NO_TIPO_SITIUACAO_BEN IS NULL OR NO_TIPO_SITIUACAO_BEN IN ('LIBERADO', 'L', 'NAO INFORMADO') THEN 0
                   WHEN NO_TIPO_SITIUACAO_BEN = 'SUSPENSO' THEN 1 WHEN NO_TIPO_SITIUACAO_BEN = 'BLOQUEADO' THEN 2 ELSE 3 END,
              NO_TIPO_SITIUACAO_BEN NULLS FIRST) = 1""",
        ranked=f"""SELECT doc.NU_CPF_PESSOA AS CPF, {_HEAD}, {_LEVEL} AS ESCOLARIDADE,
              {_place("CAST(f.CO_MUNIC_IBGE_5_FAM AS VARCHAR)")}, c.ddd AS DDD, c.phone AS TELEFONE, f.CO_FAMILIAR_FAM AS family,
              row_number() OVER (PARTITION BY doc.NU_CPF_PESSOA ORDER BY {_FAMILY_FIRST}) AS nth
            FROM {_PEOPLE}
            WHERE p.age BETWEEN 18 AND 65 AND f.CO_EST_CADASTRAL_FAM = 3 AND f.IN_CADASTRO_VALIDO_FAM = 1 AND f.ibge7 = '3500158'""",
    )


# Q18, Q21, Q22 reconciliation -----------------------------------------------------------------------
def _reconcile_sql(flags: str, queue_column: str, reasons: tuple[str, str, str, str], payroll_reason: str) -> str:
    no_document, no_person, no_family, no_member = reasons
    return oracle(
        f"""SELECT l.NOME, lpad(CAST(l.cpf_num AS VARCHAR), 11, '0') AS CPF,
             CASE WHEN b.member_3 AND b.family_3 THEN 'SIM' ELSE 'NAO' END AS CADUNICO_ATIVO,
             CASE WHEN b.has_person AND b.family_3 THEN 'SIM' ELSE 'NAO' END AS CADUNICO_PRESENCA,
             CASE WHEN x.paid THEN 'SIM' ELSE 'NAO' END AS PBF, {queue_column}
             CASE WHEN b.cpf_num IS NULL THEN '{no_document}' WHEN NOT b.has_person THEN '{no_person}'
                  WHEN NOT b.family_3 THEN '{no_family}' WHEN NOT b.member_3 THEN '{no_member}' ELSE 'OK' END AS MOTIVO_CADUNICO,
             CASE {payroll_reason} ELSE 'OK' END AS MOTIVO_PBF,
             b.member_state AS DEBUG_CO_EST_CADASTRAL_MEMB, b.family_state AS DEBUG_CO_EST_CADASTRAL_FAM
           FROM listed l LEFT JOIN base b ON b.cpf_num = l.cpf_num LEFT JOIN flags x ON x.cpf_num = l.cpf_num""",
        cpf_person="SELECT DISTINCT cpf_num, CO_CHV_NATURAL_PESSOA AS person FROM doc_num WHERE cpf_num IS NOT NULL",
        seen="""SELECT m.cpf_num, p.CO_CHV_NATURAL_PESSOA AS person, f.CO_FAMILIAR_FAM AS family,
              p.CO_EST_CADASTRAL_MEMB AS ms, f.CO_EST_CADASTRAL_FAM AS fs, p.DT_ATUAL_MEMB, f.DT_ATUALIZACAO_FAM
            FROM cpf_person m LEFT JOIN TB_PESSOA_04 p ON p.CO_CHV_NATURAL_PESSOA = m.person
              LEFT JOIN TB_FAMILIA_01 f ON f.CO_FAMILIAR_FAM = p.CO_FAMILIAR_FAM""",
        base="""SELECT cpf_num, bool_or(person IS NOT NULL) AS has_person, coalesce(bool_or(fs = 3), false) AS family_3,
              coalesce(bool_or(ms = 3), false) AS member_3, max(ms) AS member_state, max(fs) AS family_state
            FROM seen GROUP BY 1""",
        flags=flags,
    )


_CURRENT_FAMILY_SQL = _reconcile_sql(
    """SELECT cpf_num, family IN (SELECT CO_FAMILIAR FROM paid) AS paid, family IN (SELECT CO_FAMILIAR FROM queued) AS queued
       FROM (SELECT *, row_number() OVER (PARTITION BY cpf_num ORDER BY DT_ATUAL_MEMB DESC NULLS LAST,
                       DT_ATUALIZACAO_FAM DESC NULLS LAST, person, family) AS nth
             FROM seen WHERE ms = 3 AND fs = 3) z WHERE nth = 1""",
    "CASE WHEN x.queued THEN 'SIM' ELSE 'NAO' END AS PRE_HABILITADO,",
    (
        "CPF NÃO ENCONTRADO NO DOC_05",
        "CPF SEM PESSOA VINCULADA NO ODS",
        "NENHUMA FAMÍLIA COM ESTADO 3 NO ODS",
        "NENHUMA PESSOA COM ESTADO 3 NO ODS",
    ),
    """WHEN NOT coalesce(b.member_3, false) THEN 'SEM PESSOA EM ESTADO 3 → NÃO ELEGÍVEL PARA PBF'
       WHEN NOT coalesce(b.family_3, false) THEN 'SEM FAMÍLIA EM ESTADO 3 → NÃO ELEGÍVEL PARA PBF'
       WHEN NOT coalesce(x.paid, false) THEN 'FAMÍLIA VIGENTE NÃO ENCONTRADA NA FOLHA'""",
)
_SHORT_REASONS = (
    "CPF NÃO ENCONTRADO NO DOC_05",
    "CPF SEM PESSOA VINCULADA",
    "FAMÍLIA ≠ 3 NO ANOMES ODS",
    "PESSOA ≠ 3 NO ANOMES ODS",
)
_NOT_PAID = "WHEN NOT coalesce(x.paid, false) THEN 'FAMÍLIA NÃO ENCONTRADA NA FOLHA'"
_ANY_FAMILY = "coalesce(bool_or(family IN (SELECT CO_FAMILIAR FROM paid)), false)"


ENTRIES = [
    Entry(
        "q01_stratified_sample",
        lambda s: extractions.municipal_sample(s.reg, TOWN, NEXT_QUEUE, _SAMPLE, municipality="Vila Nova"),
        _SAMPLE_SQL,
    ),
    Entry(
        "q02_dossier_full",
        lambda s: dossiers.full_dossier(s.reg, [ONE_CPF]),
        oracle(f"SELECT {_DOC_KEYS}, {_PES_ALL}, {_FAM_ALL} FROM {_DOC_PES_FAM} WHERE doc.NU_CPF_PESSOA = '{ONE_CPF}'"),
    ),
    Entry(
        "q03_dossier_plain",
        lambda s: dossiers.plain_dossier(s.reg, [ONE_CPF]),
        oracle(
            f"""SELECT doc.CO_FAMILIAR_FAM, doc.CO_CHV_NATURAL_PESSOA, doc.NU_CPF_PESSOA,
                  {", ".join("p." + c for c in d.PERSON_ALL if c not in d.DOCUMENT_KEYS)},
                  {", ".join("f." + c for c in d.FAMILY_ALL if c not in d.DOCUMENT_KEYS)}
                FROM {_DOC_PES_FAM} WHERE doc.NU_CPF_PESSOA = '{ONE_CPF}'"""
        ),
    ),
    Entry(
        "q04_dossier_many_cpfs",
        lambda s: dossiers.batch_dossier(s.reg, _listed_texts(s)),
        oracle(f"SELECT {_batch_sql()} FROM {_DOC_PES_FAM} WHERE {_LISTED}"),
    ),
    Entry(
        "q05_queued_families_by_uf",
        lambda s: headcounts.queued_families_by_uf(s.reg, NEXT_QUEUE),
        oracle(
            """SELECT CASE WHEN grouping(uf_count) = 1 THEN 'TOTAL BRASIL' ELSE uf_count END AS UF, count(*) AS Qtd_Familias_PreHabilitadas
               FROM (SELECT DISTINCT f.CO_FAMILIAR_FAM, f.uf_count FROM fam f JOIN queued_next q ON q.CO_FAMILIAR = f.CO_FAMILIAR_FAM) t
               GROUP BY ROLLUP (uf_count)"""
        ),
    ),
    Entry(
        "q06_dossier_exclusions",
        lambda s: dossiers.exclusion_dossier(s.reg, _listed_texts(s)),
        oracle(
            f"""SELECT {_DOC_KEYS}, {_PES_ALL}, {_prefixed("f", "FAM_", d.FAMILY_STATUS)}, f.uf_report AS UF, f.ibge7 AS CODIBGE,
                  x.DT_EXCLUSAO_PESSOA AS EXC_DT_EXCLUSAO_PESSOA, x.CO_MOTIVO_EXCLUSAO AS EXC_CO_MOTIVO_EXCLUSAO
                FROM {_DOC_PES_FAM} LEFT JOIN TB_PESSOA_EXCLUIDA_19 x ON x.CO_CHV_NATURAL_PESSOA = p.CO_CHV_NATURAL_PESSOA
                WHERE {_LISTED}"""
        ),
    ),
    Entry(
        "q07_queued_persons_by_uf",
        lambda s: headcounts.queued_persons_by_uf(s.reg, PERIOD),
        oracle(
            """SELECT CASE WHEN grouping(uf_count) = 1 THEN 'TOTAL BRASIL' ELSE uf_count END AS UF, count(*) AS Qtd_Pessoas_PreHabilitadas
               FROM (SELECT DISTINCT CO_CHV_NATURAL_PESSOA, CO_FAMILIAR_FAM, CO_MUNIC_IBGE_2_FAM, uf_count
                     FROM strict JOIN queued ON CO_FAMILIAR = CO_FAMILIAR_FAM) t GROUP BY ROLLUP (uf_count)"""
        ),
    ),
    Entry(
        "q08_families_registered_and_paid",
        lambda s: headcounts.families_registered_and_paid(s.reg, PERIOD),
        oracle(
            """SELECT (SELECT count(DISTINCT CO_FAMILIAR_FAM) FROM strict) AS Familias_inscritas_CadUnico,
                 (SELECT count(DISTINCT CO_FAMILIAR_FAM) FROM strict JOIN paid ON CO_FAMILIAR = CO_FAMILIAR_FAM) AS Familias_inscritas_BolsaFamilia"""
        ),
    ),
    Entry(
        "q09_registered_persons",
        lambda s: headcounts.registered_persons(s.reg),
        oracle("SELECT count(DISTINCT CO_CHV_NATURAL_PESSOA) AS QT_PESSOAS_CADASTRADAS FROM strict"),
    ),
    Entry(
        "q10_registered_persons_by_uf",
        lambda s: headcounts.registered_persons_by_uf(s.reg),
        oracle(
            """SELECT uf_count AS UF, count(DISTINCT CO_CHV_NATURAL_PESSOA) AS Qtd_Pessoas_inscritas_CadUnico_PorUF
               FROM strict GROUP BY 1"""
        ),
    ),
    Entry(
        "q11_registered_persons_of_municipality",
        lambda s: headcounts.registered_persons_of_municipality(s.reg, TOWN),
        oracle(
            """SELECT '3500158' AS CODIBGE, count(DISTINCT CO_CHV_NATURAL_PESSOA) AS Qtd_Pessoas_inscritas_CadUnico_Ativo
               FROM strict WHERE ibge7 = '3500158'"""
        ),
    ),
    Entry(
        "q12_persons_registered_and_paid",
        lambda s: headcounts.persons_registered_and_paid(s.reg, PERIOD),
        oracle(
            """SELECT (SELECT count(*) FROM (SELECT DISTINCT CO_CHV_NATURAL_PESSOA, CO_FAMILIAR_FAM FROM strict) t) AS Pessoas_inscritos_CadUnico,
                 (SELECT count(DISTINCT CO_CHV_NATURAL_PESSOA) FROM strict JOIN paid ON CO_FAMILIAR = CO_FAMILIAR_FAM)
                   AS Pessoas_inscritas_BolsaFamilia"""
        ),
    ),
    Entry(
        "q13_paid_persons_by_uf",
        lambda s: headcounts.paid_persons_by_uf(s.reg, PERIOD),
        oracle(
            """SELECT uf_count AS UF, count(DISTINCT CO_CHV_NATURAL_PESSOA) AS Qtd_Pessoas_inscritas_BolsaFamilia_PorUF
               FROM strict JOIN paid ON CO_FAMILIAR = CO_FAMILIAR_FAM GROUP BY 1"""
        ),
    ),
    Entry(
        "q14_update_recency_by_uf",
        lambda s: headcounts.update_recency_by_uf(s.reg, PERIOD.anomes_ods),
        oracle(
            """SELECT uf_count AS UF, count(*) AS QT_TOTAL_PESSOAS_UF,
                 count(*) FILTER (months_old BETWEEN 0 AND 6) AS QT_0_A_6_MESES,
                 count(*) FILTER (months_old BETWEEN 7 AND 12) AS QT_7_A_12_MESES,
                 count(*) FILTER (months_old BETWEEN 13 AND 18) AS QT_13_A_18_MESES,
                 count(*) FILTER (months_old BETWEEN 19 AND 24) AS QT_19_A_24_MESES,
                 count(*) FILTER (months_old > 24) AS QT_MAIOR_OU_IGUAL_25_MESES,
                 count(*) FILTER (DT_ATUAL_MEMB IS NULL) AS QT_DT_ATUAL_NULO
               FROM (SELECT DISTINCT CO_CHV_NATURAL_PESSOA, CO_FAMILIAR_FAM, DT_ATUAL_MEMB, months_old, uf_count FROM strict) t GROUP BY 1"""
        ),
    ),
    Entry(
        "q15_dossier_benefits",
        lambda s: dossiers.benefit_dossier(s.reg, _listed_texts(s), PERIOD),
        oracle(
            f"""SELECT {_DOC_ALL}, {_PES_ALL}, {_FAM_ALL}, {_CONTACTS}, f.uf_report AS UF, f.ibge7 AS CODIBGE,
                  x.DT_EXCLUSAO_PESSOA AS EXC_DT_EXCLUSAO_PESSOA, x.CO_MOTIVO_EXCLUSAO AS EXC_CO_MOTIVO_EXCLUSAO,
                  CASE WHEN f.CO_FAMILIAR_FAM IN (SELECT CO_FAMILIAR FROM paid) THEN 'SIM' ELSE 'NAO' END AS FAMILIA_NA_FOLHA_BF,
                  CASE WHEN f.CO_FAMILIAR_FAM IN (SELECT CO_FAMILIAR FROM queued) THEN 'SIM' ELSE 'NAO' END AS FAMILIA_PRE_HABILITADA
                FROM {_DOC_PES_FAM} LEFT JOIN TB_PESSOA_EXCLUIDA_19 x ON x.CO_CHV_NATURAL_PESSOA = p.CO_CHV_NATURAL_PESSOA
                  LEFT JOIN TB_CONTATO_09 c ON c.CO_FAMILIAR_FAM = f.CO_FAMILIAR_FAM
                WHERE {_LISTED}"""
        ),
    ),
    Entry("q16_municipal_current", lambda s: extractions.municipal_current(s.reg, TOWN, PERIOD), _CURRENT_SQL),
    Entry(
        "q17_municipal_history",
        lambda s: extractions.municipal_history(s.reg, TOWN, PERIOD),
        oracle(
            f"""SELECT {_DOC_ALL}, {_PES_ALL}, {_FAM_ALL}, {_CONTACTS}, f.ibge7 AS CODIBGE
                FROM {_DOC_PES_FAM} LEFT JOIN TB_CONTATO_09 c ON c.CO_FAMILIAR_FAM = f.CO_FAMILIAR_FAM
                WHERE f.ibge7 = '3500158' AND doc.NU_CPF_PESSOA IS NOT NULL
                  AND f.CO_EST_CADASTRAL_FAM NOT IN (1, 2, 4) AND p.CO_EST_CADASTRAL_MEMB = 3"""
        ),
    ),
    Entry(
        "q18_reconcile_current_family",
        lambda s: reconciliation.reconcile(s.reg, s.people, PERIOD, "current_family"),
        _CURRENT_FAMILY_SQL,
    ),
    Entry(
        "q19_state_candidates",
        lambda s: extractions.state_candidates(s.reg, STATE, PERIOD, _STATE_RULES),
        _STATE_SQL,
    ),
    Entry(
        "b27_sample_of_state_candidates",
        lambda s: extractions.state_candidates(s.reg, STATE, PERIOD, _STATE_RULES, sample_size=10, seed=7),
        _sampled(_STATE_SQL, "CAST(TRY_CAST(CPF AS DECIMAL(20,0)) AS VARCHAR)", 10, 7),
    ),
    Entry(
        "q20_benefit_status_sample",
        lambda s: extractions.municipal_benefit_status(s.reg, TOWN, PERIOD, sample_size=20),
        status_sql("RF_FOLHA = 200007", "RF_FOLHA = 200006", "ORDER BY md5(r.CPF), r.CPF LIMIT 20"),
    ),
    Entry(
        "q20_benefit_status_any_month",
        lambda s: extractions.municipal_benefit_status(s.reg, TOWN, PERIOD, sample_size=None, any_month=True),
        status_sql("true", "true"),
    ),
    Entry(
        "q21_reconcile_any_family_if_person3",
        lambda s: reconciliation.reconcile(s.reg, s.people, PERIOD, "any_family_if_person3"),
        _reconcile_sql(
            f"SELECT cpf_num, {_ANY_FAMILY} AND coalesce(bool_or(ms = 3), false) AS paid FROM seen GROUP BY 1",
            "",
            _SHORT_REASONS,
            _NOT_PAID,
        ),
    ),
    Entry(
        "q22_reconcile_any_family",
        lambda s: reconciliation.reconcile(s.reg, s.people, PERIOD, "any_family"),
        _reconcile_sql(f"SELECT cpf_num, {_ANY_FAMILY} AS paid FROM seen GROUP BY 1", "", _SHORT_REASONS, _NOT_PAID),
    ),
    Entry(
        "q23_eligible_candidates",
        lambda s: extractions.eligible_candidates(s.reg, STATE, PERIOD, _ELIGIBLE_RULES),
        _ELIGIBLE_SQL,
    ),
    Entry(
        "b27_sample_of_eligible_candidates",
        lambda s: extractions.eligible_candidates(s.reg, STATE, PERIOD, _ELIGIBLE_RULES, sample_size=15),
        _sampled(_ELIGIBLE_SQL, "CPF", 15),
    ),
    Entry(
        "q24_payroll_months",
        lambda s: headcounts.payroll_months(s.reg.payroll),
        oracle("SELECT DISTINCT RF_FOLHA FROM VW_FOLHA_PAGAMENTO"),
    ),
]
