"""Registry-shaped views over the star-schema tables.

Customers become families; orders become persons, documents, payroll and queue rows and the caller's
list. The texts run unchanged on Spark and on DuckDB, so both see the same rows. Whole tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CPF = """CASE WHEN o_orderkey % 50 = 3 THEN lpad(CAST(900000000 + o_orderkey AS STRING), 11, '0')
            ELSE lpad(CAST(CAST(floor(o_orderkey / 3) AS BIGINT) * 7 AS STRING), 11, '0') END"""
_MONTH = "CAST(200000 + month(o_orderdate) AS INT)"

VIEWS = {
    "TB_FAMILIA_01": """
        SELECT c_custkey AS CO_FAMILIAR_FAM,
          DATE '1994-01-01' + CAST(c_custkey % 365 AS INT) AS DT_CADASTRO_FAM,
          DATE '1999-01-01' + CAST(c_custkey * 7 % 540 AS INT) AS DT_ULT_ATUAL_FAM,
          CAST(CASE c_custkey % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN NULL ELSE 3 END AS INT)
            AS CO_EST_CADASTRAL_FAM,
          CAST(CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 1 END AS INT) AS IN_CADASTRO_VALIDO_FAM,
          CAST(CASE WHEN c_custkey % 13 = 0 THEN 6 ELSE 1 END AS INT) AS CO_CONDICAO_CADASTRO_FAM,
          CAST(1 + c_custkey % 3 AS INT) AS CO_MODALIDADE_OPER_FAM,
          CAST(c_nationkey % 4 AS INT) AS CO_ORIGEM_FAMILIA_FAM,
          DATE '1999-06-01' + CAST(c_custkey * 13 % 365 AS INT) AS DT_CDSTR_ATUAL_FMLA,
          CAST(c_custkey % 2 AS INT) AS IN_FAM_ALTERADA_V7,
          DATE '1999-01-01' + CAST(c_custkey * 11 % 540 AS INT) AS DT_ATUALIZACAO_FAM,
          CAST(CASE WHEN c_custkey % 97 = 0 THEN 99 WHEN c_nationkey < 7 THEN 11 + c_nationkey
               WHEN c_nationkey < 16 THEN 14 + c_nationkey WHEN c_nationkey < 19 THEN 15 + c_nationkey
               WHEN c_nationkey = 19 THEN 35 WHEN c_nationkey < 23 THEN 21 + c_nationkey
               ELSE 27 + c_nationkey END AS INT) AS CO_MUNIC_IBGE_2_FAM,
          CAST(58 + 100 * (c_custkey % 3) AS INT) AS CO_MUNIC_IBGE_5_FAM,
          c_mktsegment AS NO_LOCALIDADE_FAM
        FROM {customer}""",
    "TB_PESSOA_04": """
        SELECT CASE WHEN o_orderkey % 50 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS CO_CHV_NATURAL_PESSOA,
          o_custkey AS CO_FAMILIAR_FAM,
          DATE '1994-01-01' + CAST(o_orderkey % 300 AS INT) AS DT_CADASTRAMENTO_MEMB,
          CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS DT_ATUAL_MEMB,
          CAST(CASE o_orderstatus WHEN 'P' THEN 4 ELSE 3 END AS INT) AS CO_EST_CADASTRAL_MEMB,
          concat('PESSOA ', CAST(o_orderkey AS STRING)) AS NO_PESSOA,
          lpad(CAST(o_orderkey AS STRING), 11, '0') AS NU_NIS_PESSOA,
          o_orderpriority AS NO_APELIDO_PESSOA,
          DATE '1935-01-01' + CAST(o_orderkey * 7919 % 25000 AS INT) AS DT_NASC_PESSOA,
          CAST(o_orderkey % 4 AS INT) AS CO_SEXO_PESSOA,
          CAST(o_orderkey % 3 AS INT) AS CO_ORIGEM_FAMILIA_PESSOA,
          CAST(o_orderkey % 2 AS INT) AS IN_ORIGEM_ALTERACAO_PESSOA,
          o_orderkey AS CO_CHV_NAT_PES_ATUAL,
          CAST(NULL AS BIGINT) AS CO_CHV_NAT_PES_ORIGINAL,
          CAST(NULL AS STRING) AS NU_NIS_ORIGINAL,
          CAST(o_orderkey % 5 AS INT) AS IN_TRANSFERENCIA_PESSOA
        FROM {orders}""",
    "TB_DOCUMENTO_05": f"""
        SELECT o_orderkey AS CO_CHV_NATURAL_PESSOA, o_custkey AS CO_FAMILIAR_FAM,
          CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE {_CPF} END AS NU_CPF_PESSOA,
          CAST(o_orderkey % 6 AS STRING) AS CO_CERTIDAO_CIVIL_PESSOA,
          o_orderstatus AS NO_CARTORIO_PESSOA,
          lpad(CAST(o_orderkey AS STRING), 9, '0') AS NU_IDENTIDADE_PESSOA,
          CAST(NULL AS STRING) AS SG_UF_IDENT_PESSOA,
          lpad(CAST(o_custkey AS STRING), 12, '0') AS NU_TITULO_ELEITOR_PESSOA
        FROM {{orders}}""",
    "TB_ESCOLARIDADE_07": """
        SELECT o_orderkey AS CO_CHV_NATURAL_PESSOA,
          CAST(CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 1 END AS INT) AS CO_SABE_LER_ESCREVER_MEMB,
          CAST(1 + o_orderkey % 4 AS INT) AS IN_FREQUENTA_ESCOLA_MEMB,
          CAST(4 + CAST(floor(o_orderkey / 4) AS BIGINT) % 11 AS INT) AS CO_CURSO_FREQUENTA_MEMB,
          CAST(1 + CAST(floor(o_orderkey / 44) AS BIGINT) % 10 AS INT) AS CO_ANO_SERIE_FREQUENTA_MEMB,
          CAST(4 + CAST(floor(o_orderkey / 4) AS BIGINT) % 10 AS INT) AS CO_CURSO_FREQ_PESSOA_MEMB,
          CAST(1 + CAST(floor(o_orderkey / 40) AS BIGINT) % 10 AS INT) AS CO_ANO_SERIE_FREQUENTOU_MEMB
        FROM {orders} WHERE o_totalprice >= 25000""",
    "TB_CONTATO_09": """
        SELECT c_custkey AS CO_FAMILIAR_FAM,
          CAST(11 + c_custkey % 80 AS STRING) AS NU_DDD_CONTATO_1_FAM,
          CASE WHEN c_custkey % 6 = 0 THEN NULL
               WHEN c_custkey % 4 = 1 THEN concat('0', CAST(900000000 + c_custkey AS STRING))
               ELSE CAST(900000000 + c_custkey AS STRING) END AS NU_TEL_CONTATO_1_FAM,
          CAST(NULL AS STRING) AS NU_DDD_CONTATO_2_FAM,
          CAST(NULL AS STRING) AS NU_TEL_CONTATO_2_FAM,
          CAST(c_custkey % 3 AS INT) AS IN_TIPO_EMAIL_FAM,
          concat(lower(c_mktsegment), '@example.org') AS DS_EMAIL_FAM
        FROM {customer} WHERE c_acctbal >= 0""",
    "TB_PESSOA_EXCLUIDA_19": """
        SELECT o_orderkey AS CO_CHV_NATURAL_PESSOA, CAST(o_orderdate AS DATE) + 30 AS DT_EXCLUSAO_PESSOA,
          CAST(1 + o_orderkey % 5 AS INT) AS CO_MOTIVO_EXCLUSAO
        FROM {orders} WHERE o_totalprice > 480000""",
    "VW_FOLHA_PAGAMENTO": f"""
        SELECT o_custkey AS CO_FAMILIAR, {_MONTH} AS RF_FOLHA,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'LIBERADO' WHEN '2' THEN 'SUSPENSO'
               WHEN '3' THEN 'BLOQUEADO' WHEN '5' THEN ' liberado ' ELSE NULL END AS NO_TIPO_SITIUACAO_BEN
        FROM {{orders}}""",
    "VW_PRE_HABILITACAO_PBF": f"""
        SELECT o_custkey AS CO_FAMILIAR, {_MONTH} AS RF_FOLHA
        FROM {{orders}} WHERE o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED')""",
    "VT_LISTA_CPF": f"""
        SELECT concat('PESSOA ', CAST(o_orderkey AS STRING)) AS NOME,
          CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 5 THEN ' .-/' WHEN 1 THEN NULL WHEN 6 THEN '12A45'
               WHEN 4 THEN '99999999999'
               WHEN 9 THEN '111122223333444455556'
               WHEN 2 THEN concat(substr(c, 1, 3), '.', substr(c, 4, 3), '.', substr(c, 7, 3), '-', substr(c, 10, 2))
               ELSE concat(' ', c) END AS CPF_RAW
        FROM (SELECT o_orderkey, {_CPF} AS c FROM {{orders}}) t""",
}
SOURCES = ("customer", "orders")


class StarTables:
    """The views over the Parquet tables of one directory; each source table is opened once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._sources: dict[str, DataFrame] = {}

    def source(self, table: str) -> DataFrame:
        if table not in self._sources:
            self._sources[table] = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return self._sources[table]

    def view(self, name: str) -> DataFrame:
        source = next(t for t in SOURCES if f"{{{t}}}" in VIEWS[name])
        return self.spark.sql(VIEWS[name], **{source: self.source(source)})
