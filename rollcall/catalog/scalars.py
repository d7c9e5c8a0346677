"""Scalar functions S01-S21, each over a whole view."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.catalog.entries import PERIOD, Entry
from rollcall.catalog.oracle import oracle
from rollcall.functions import (
    absolute_month,
    age_years,
    codibge,
    month_to_date,
    months_since,
    parse_cpf,
    phone_clean,
    shift_month,
    strip_mask,
)
from rollcall.operators.sampling import hash_order


ENTRIES = [
    Entry(
        "s01_strip_mask",
        lambda s: s.people.select("NOME", strip_mask(F.col("CPF_RAW")).alias("digits")),
        oracle("SELECT NOME, regexp_replace(CPF_RAW, '[ ./-]', '', 'g') AS digits FROM VT_LISTA_CPF"),
    ),
    Entry(
        "s02_trim",
        lambda s: s.reg.payroll.select("CO_FAMILIAR", "RF_FOLHA", F.trim("NO_TIPO_SITIUACAO_BEN").alias("situation")),
        oracle("SELECT CO_FAMILIAR, RF_FOLHA, trim(NO_TIPO_SITIUACAO_BEN) AS situation FROM VW_FOLHA_PAGAMENTO"),
    ),
    Entry(
        "s03_upper",
        lambda s: s.reg.payroll.select("CO_FAMILIAR", "RF_FOLHA", F.upper("NO_TIPO_SITIUACAO_BEN").alias("situation")),
        oracle("SELECT CO_FAMILIAR, RF_FOLHA, upper(NO_TIPO_SITIUACAO_BEN) AS situation FROM VW_FOLHA_PAGAMENTO"),
    ),
    Entry(
        "s04_lpad",
        lambda s: s.reg.person.select(
            "NU_NIS_PESSOA",
            F.lpad(F.col("CO_CHV_NATURAL_PESSOA").cast("string"), 11, "0").alias("wide"),
            F.lpad(F.col("CO_CHV_NATURAL_PESSOA").cast("string"), 3, "0").alias("narrow"),
        ),
        oracle(
            """SELECT NU_NIS_PESSOA, lpad(CAST(CO_CHV_NATURAL_PESSOA AS VARCHAR), 11, '0') AS wide,
                 lpad(CAST(CO_CHV_NATURAL_PESSOA AS VARCHAR), 3, '0') AS narrow FROM TB_PESSOA_04"""
        ),
    ),
    Entry(
        "s05_concat",
        lambda s: s.reg.family.select(
            "CO_FAMILIAR_FAM", codibge(F.col("CO_MUNIC_IBGE_2_FAM"), F.col("CO_MUNIC_IBGE_5_FAM")).alias("CODIBGE")
        ),
        oracle("SELECT CO_FAMILIAR_FAM, ibge7 AS CODIBGE FROM fam"),
    ),
    Entry(
        "s06_substring_from",
        lambda s: s.reg.contact.select("CO_FAMILIAR_FAM", phone_clean(F.col("NU_TEL_CONTATO_1_FAM")).alias("TELEFONE")),
        oracle("SELECT CO_FAMILIAR_FAM, phone AS TELEFONE FROM contact"),
    ),
    Entry(
        "s07_number_to_text",
        lambda s: s.reg.family.select("CO_FAMILIAR_FAM", F.col("CO_MUNIC_IBGE_5_FAM").cast("string").alias("code")),
        oracle("SELECT CO_FAMILIAR_FAM, CAST(CO_MUNIC_IBGE_5_FAM AS VARCHAR) AS code FROM TB_FAMILIA_01"),
    ),
    Entry(
        "s08_text_to_decimal",
        lambda s: s.people.select("NOME", parse_cpf(F.col("CPF_RAW")).cast("string").alias("number")),
        oracle(
            """SELECT NOME, CAST(CASE WHEN regexp_full_match(trim(CPF_RAW), '[0-9]+') THEN TRY_CAST(trim(CPF_RAW) AS DECIMAL(20,0)) END
                 AS VARCHAR) AS number FROM VT_LISTA_CPF"""
        ),
    ),
    Entry(
        "s09_number_to_integer",
        lambda s: s.reg.person.select("NU_NIS_PESSOA", F.col("CO_CHV_NATURAL_PESSOA").cast("int").alias("key_int")),
        oracle("SELECT NU_NIS_PESSOA, CAST(CO_CHV_NATURAL_PESSOA AS INT) AS key_int FROM TB_PESSOA_04"),
    ),
    Entry(
        "s10_coalesce",
        lambda s: s.reg.payroll.select(
            "CO_FAMILIAR", "RF_FOLHA", F.coalesce("NO_TIPO_SITIUACAO_BEN", F.lit("LIBERADO")).alias("situation")
        ),
        oracle("SELECT CO_FAMILIAR, RF_FOLHA, coalesce(NO_TIPO_SITIUACAO_BEN, 'LIBERADO') AS situation FROM VW_FOLHA_PAGAMENTO"),
    ),
    Entry(
        "s11_greatest",
        lambda s: s.reg.person.select(
            "NU_NIS_PESSOA",
            F.greatest(F.lit(0), months_since(F.col("DT_CADASTRAMENTO_MEMB"), PERIOD.anomes_ods) - 70).alias("over_70"),
        ),
        oracle(
            """SELECT NU_NIS_PESSOA, CAST(greatest(0, 24006 - year(DT_CADASTRAMENTO_MEMB) * 12 - month(DT_CADASTRAMENTO_MEMB) - 70) AS INT)
                 AS over_70 FROM TB_PESSOA_04"""
        ),
    ),
    Entry(
        "s12_month_to_date",
        lambda s: s.reg.payroll.select("CO_FAMILIAR", "RF_FOLHA", month_to_date(F.col("RF_FOLHA")).alias("first_day")),
        oracle("SELECT CO_FAMILIAR, RF_FOLHA, make_date(RF_FOLHA // 100, RF_FOLHA % 100, 1) AS first_day FROM VW_FOLHA_PAGAMENTO"),
    ),
    Entry(
        "s13_absolute_month",
        lambda s: s.reg.person.select("NU_NIS_PESSOA", absolute_month(F.col("DT_ATUAL_MEMB")).alias("month_no")),
        oracle("SELECT NU_NIS_PESSOA, CAST(year(DT_ATUAL_MEMB) * 12 + month(DT_ATUAL_MEMB) AS INT) AS month_no FROM TB_PESSOA_04"),
    ),
    Entry(
        "s14_add_months",
        lambda s: s.reg.payroll.select("CO_FAMILIAR", "RF_FOLHA", shift_month(F.col("RF_FOLHA"), 1).alias("next_month")),
        oracle(
            """SELECT CO_FAMILIAR, RF_FOLHA, CASE WHEN RF_FOLHA % 100 = 12 THEN RF_FOLHA + 89 ELSE RF_FOLHA + 1 END AS next_month
               FROM VW_FOLHA_PAGAMENTO"""
        ),
    ),
    Entry(
        "s15_month_difference",
        lambda s: s.reg.person.select(
            "NU_NIS_PESSOA", months_since(F.col("DT_ATUAL_MEMB"), PERIOD.anomes_ods).alias("months_old")
        ),
        oracle("SELECT NU_NIS_PESSOA, CAST(months_old AS INT) AS months_old FROM pes"),
    ),
    Entry(
        "s16_year_and_month",
        lambda s: s.reg.person.select(
            "NU_NIS_PESSOA", F.year("DT_NASC_PESSOA").alias("born_year"), F.month("DT_NASC_PESSOA").alias("born_month")
        ),
        oracle(
            """SELECT NU_NIS_PESSOA, CAST(year(DT_NASC_PESSOA) AS INT) AS born_year, CAST(month(DT_NASC_PESSOA) AS INT) AS born_month
               FROM TB_PESSOA_04"""
        ),
    ),
    Entry(
        "s17_days_and_whole_years",
        lambda s: s.reg.person.select(
            "NU_NIS_PESSOA",
            F.datediff(F.lit(PERIOD.as_of), "DT_NASC_PESSOA").alias("days"),
            age_years(F.col("DT_NASC_PESSOA"), PERIOD.as_of).alias("years"),
        ),
        oracle(
            """SELECT NU_NIS_PESSOA, CAST(DATE '2000-06-30' - DT_NASC_PESSOA AS INT) AS days,
                 CAST(trunc((DATE '2000-06-30' - DT_NASC_PESSOA) / 365.0) AS INT) AS years FROM TB_PESSOA_04"""
        ),
    ),
    Entry(
        "s18_current_date",
        # Today, but not after the job's date: the result does not change at midnight.
        lambda s: s.reg.person.select(
            "NU_NIS_PESSOA", (age_years(F.col("DT_NASC_PESSOA"), F.least(F.current_date(), F.lit(PERIOD.as_of))) >= 60).alias("is_60")
        ),
        oracle(
            """SELECT NU_NIS_PESSOA, (least(current_date, DATE '2000-06-30') - DT_NASC_PESSOA) // 365 >= 60 AS is_60
               FROM TB_PESSOA_04"""
        ),
    ),
    Entry(
        "s19_ceiling",
        lambda s: s.reg.family.groupBy("CO_MUNIC_IBGE_2_FAM").agg(
            F.ceil(F.count(F.lit(1)) * F.lit("0.35").cast("decimal(3,2)")).cast("int").alias("quota")
        ),
        oracle("SELECT CO_MUNIC_IBGE_2_FAM, CAST((count(*) * 35 + 99) // 100 AS INT) AS quota FROM TB_FAMILIA_01 GROUP BY 1"),
    ),
    Entry(
        "s20_hash_order",
        lambda s: s.reg.document.select("CO_CHV_NATURAL_PESSOA", hash_order("NU_CPF_PESSOA").alias("sort_value")),
        oracle("SELECT CO_CHV_NATURAL_PESSOA, md5(NU_CPF_PESSOA) AS sort_value FROM TB_DOCUMENTO_05"),
    ),
    Entry(
        "s21_arithmetic_and_literals",
        lambda s: s.reg.family.select(
            "CO_FAMILIAR_FAM",
            (F.col("CO_MUNIC_IBGE_2_FAM") * 100000 + F.col("CO_MUNIC_IBGE_5_FAM") - 1).alias("code"),
            F.lit("---").alias("REGIAO"),
        ),
        oracle(
            """SELECT CO_FAMILIAR_FAM, CO_MUNIC_IBGE_2_FAM * 100000 + CO_MUNIC_IBGE_5_FAM - 1 AS code, '---' AS REGIAO
               FROM TB_FAMILIA_01"""
        ),
    ),
]
