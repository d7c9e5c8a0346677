"""Shared pieces of the SQL counterparts: the registry-shaped views and common sub-relations.

The SQL is written on its own terms (rule table joins, window ranks, EXISTS tests) so that it checks the
Spark code instead of repeating it.
"""

from __future__ import annotations

from rollcall.catalog.star_views import SOURCES, VIEWS
from rollcall.functions.territory import UF_BY_CODE

# Schooling rules as (attending, courses, grades or NULL for any, level, precedence).
_RULES = """
  ('now',  [7],     [1,10],            'EFI', 1), ('now',  [10,11], NULL,             'EFI', 1),
  ('past', [5],     [8,10],            'EFI', 1), ('past', [6],     [9,10],           'EFI', 1),
  ('past', [7],     [8,10],            'EFI', 1), ('past', [11],    NULL,             'EFI', 1),
  ('now',  [4],     [2,3,4,5,6,7,8],   'EFC', 2), ('now',  [5],     [3,4,5,6,7,8,9],  'EFC', 2),
  ('now',  [10],    NULL,              'EFC', 2), ('past', [4],     [1,2,3,4,10],     'EFC', 2),
  ('past', [5],     [5,6,7],           'EFC', 2), ('past', [6],     [2,3,4,5,6,7,8],  'EFC', 2),
  ('past', [7],     [1,2,3,4,5,6,7],   'EFC', 2), ('past', [10],    NULL,             'EFC', 2),
  ('now',  [7],     [2,3,4],           'EMI', 3), ('past', [8,9],   [1,2],            'EMI', 3),
  ('now',  [14],    NULL,              'EMC', 4), ('past', [8,9],   [3,4,10],         'EMC', 4),
  ('past', [12],    NULL,              'EMC', 4), ('now',  [13],    NULL,         'ES OU +', 5),
  ('past', [13],    NULL,          'ES OU +', 5)"""

_SHARED = {
    "uf_map(uf_code, uf_sigla)": "VALUES " + ", ".join(f"({code}, '{uf}')" for code, uf in UF_BY_CODE.items()),
    "esc_rules(attending, courses, grades, level, precedence)": "VALUES " + _RULES,
    # Highest-precedence matching rule per person.
    "esc_level": """
        SELECT e.CO_CHV_NATURAL_PESSOA AS person, coalesce(arg_min(r.level, r.precedence), 'Não Informado') AS level
        FROM TB_ESCOLARIDADE_07 e LEFT JOIN esc_rules r
          ON e.CO_SABE_LER_ESCREVER_MEMB = 1
         AND r.attending = CASE WHEN e.IN_FREQUENTA_ESCOLA_MEMB IN (1, 2) THEN 'now'
                                WHEN e.IN_FREQUENTA_ESCOLA_MEMB = 3 THEN 'past' END
         AND list_contains(r.courses, CASE r.attending WHEN 'now' THEN e.CO_CURSO_FREQUENTA_MEMB
                                                       ELSE e.CO_CURSO_FREQ_PESSOA_MEMB END)
         AND (r.grades IS NULL OR list_contains(r.grades, CASE r.attending WHEN 'now' THEN e.CO_ANO_SERIE_FREQUENTA_MEMB
                                                                           ELSE e.CO_ANO_SERIE_FREQUENTOU_MEMB END))
        GROUP BY 1""",
    # Family attributes every report derives.
    "fam": """
        SELECT f.*, coalesce(m.uf_sigla, 'NA') AS uf_count, coalesce(m.uf_sigla, 'Não Informado') AS uf_report,
          lpad(CAST(f.CO_MUNIC_IBGE_2_FAM AS VARCHAR), 2, '0') || lpad(CAST(f.CO_MUNIC_IBGE_5_FAM AS VARCHAR), 5, '0') AS ibge7
        FROM TB_FAMILIA_01 f LEFT JOIN uf_map m ON m.uf_code = f.CO_MUNIC_IBGE_2_FAM""",
    "pes": """
        SELECT p.*, 24006 - (year(p.DT_ATUAL_MEMB) * 12 + month(p.DT_ATUAL_MEMB)) AS months_old,
          date_diff('day', p.DT_NASC_PESSOA, DATE '2000-06-30') // 365 AS age,
          CASE p.CO_SEXO_PESSOA WHEN 1 THEN 'Masculino' WHEN 2 THEN 'Feminino' ELSE 'Não informado' END AS sex
        FROM TB_PESSOA_04 p""",
    # Registered persons in registered families.
    "strict": """
        SELECT p.*, f.* EXCLUDE (CO_FAMILIAR_FAM) FROM pes p JOIN fam f USING (CO_FAMILIAR_FAM)
        WHERE f.CO_EST_CADASTRAL_FAM NOT IN (1, 2, 4) AND p.CO_EST_CADASTRAL_MEMB = 3""",
    "paid": "SELECT DISTINCT CO_FAMILIAR FROM VW_FOLHA_PAGAMENTO WHERE RF_FOLHA = 200007",
    "queued": "SELECT DISTINCT CO_FAMILIAR FROM VW_PRE_HABILITACAO_PBF WHERE RF_FOLHA = 200006",
    "queued_next": "SELECT DISTINCT CO_FAMILIAR FROM VW_PRE_HABILITACAO_PBF WHERE RF_FOLHA = 200007",
    "released": """
        SELECT DISTINCT CO_FAMILIAR FROM VW_FOLHA_PAGAMENTO
        WHERE RF_FOLHA = 200007 AND trim(upper(NO_TIPO_SITIUACAO_BEN)) IN ('LIBERADO', 'L')""",
    "contact": """
        SELECT CO_FAMILIAR_FAM, NU_DDD_CONTATO_1_FAM AS ddd, NU_TEL_CONTATO_1_FAM AS raw_phone,
          CASE WHEN NU_TEL_CONTATO_1_FAM[1] = '0' THEN NU_TEL_CONTATO_1_FAM[2:] ELSE NU_TEL_CONTATO_1_FAM END AS phone
        FROM TB_CONTATO_09""",
    "doc_num": """
        SELECT *, CASE WHEN regexp_full_match(trim(NU_CPF_PESSOA), '[0-9]+')
                       THEN TRY_CAST(trim(NU_CPF_PESSOA) AS DECIMAL(20,0)) END AS cpf_num
        FROM TB_DOCUMENTO_05""",
    "listed": """
        SELECT NOME, CPF_RAW, CASE WHEN regexp_full_match(digits, '[0-9]+') THEN TRY_CAST(digits AS DECIMAL(20,0)) END AS cpf_num
        FROM (SELECT *, regexp_replace(CPF_RAW, '[ ./-]', '', 'g') AS digits FROM VT_LISTA_CPF) t""",
}


def within_quota(quotas: dict[str, int], fill: str) -> str:
    """The test that a stratified sample takes a row of ``drawn`` (CATEGORIA, place in its stratum)."""
    own = "CASE CATEGORIA " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in quotas.items()) + " ELSE 0 END"
    short = f"{sum(quotas.values())} - (SELECT count(*) FROM drawn WHERE place <= {own})"
    return f"place <= {own} + CASE CATEGORIA WHEN '{fill}' THEN {short} ELSE 0 END"


def oracle(select: str, **ctes: str) -> str:
    """A full statement: views, shared sub-relations, the given CTEs, then ``select``."""
    views = {name: text.format(**{t: t for t in SOURCES}) for name, text in VIEWS.items()}
    parts = {**views, **_SHARED, **ctes}
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in parts.items()) + "\n" + select
