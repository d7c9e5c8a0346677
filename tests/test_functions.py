from datetime import date, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from rollcall import functions as f
from rollcall.params import Month, Period, SamplePlan, Territory
from rollcall.schemas import CONTACT, PERSON, SCHOOLING

AS_OF = date(2000, 6, 30)


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def texts(spark, *items):
    return spark.createDataFrame([(i,) for i in items], "x string")


def test_clean_cpf(spark):
    given = ["  111.222.333-44 ", "1/2", "", " .-/", None, "12a", "1e5", "000700", "9" * 12, "9" * 20, "9" * 21, "-5"]
    got = [None if v is None else int(v) for v in values(texts(spark, *given), f.clean_cpf(F.col("x")))]
    assert got == [11122233344, 12, None, None, None, None, None, 700, int("9" * 12), int("9" * 20), None, 5]


def test_parse_cpf_does_not_strip_masks(spark):
    assert values(texts(spark, " 12 ", "1.2", "x", None), f.parse_cpf(F.col("x")).cast("int")) == [12, None, None, None]


def test_format_cpf_pads_and_cuts(spark):
    df = spark.createDataFrame([("700",), ("111222333445",), (None,)], "x string")
    assert values(df, f.format_cpf(F.col("x").cast("decimal(20,0)"))) == ["00000000700", "11122233344", None]


def test_uf_sigla_knows_all_27_codes(spark):
    df = spark.createDataFrame([(c,) for c in (*f.UF_BY_CODE, 99, None)], "c int")
    assert values(df, f.uf_sigla(F.col("c"))) == [*f.UF_BY_CODE.values(), "NA", "NA"]
    assert values(df.where("c = 99 OR c IS NULL"), f.uf_sigla(F.col("c"), "?")) == ["?", "?"]
    assert len(f.UF_BY_CODE) == 27


def test_codibge_and_territory_agree(spark):
    df = spark.createDataFrame([(52, 258), (5, 1), (35, 50308)], "uf int, mun int")
    assert values(df, f.codibge(F.col("uf"), F.col("mun"))) == ["5200258", "0500001", "3550308"]
    for code in ("5200258", "0500001", "3550308", "9999999"):
        here = f.in_territory(Territory.from_codibge(code), F.col("uf"), F.col("mun"))
        assert df.where(here).count() == df.where(f.codibge(F.col("uf"), F.col("mun")) == code).count()
        assert Territory.from_codibge(code).codibge == code
    with pytest.raises(ValueError):
        Territory.from_codibge("123")


def test_age_is_whole_365_day_years_cut_toward_zero(spark):
    born = [AS_OF - timedelta(days=n) for n in (365 * 18, 365 * 18 - 1, 364, 0)] + [AS_OF + timedelta(days=400), None]
    df = spark.createDataFrame([(b,) for b in born], "d date")
    assert values(df, f.age_years(F.col("d"), AS_OF)) == [18, 17, 0, 0, -1, None]
    assert values(df.limit(1), f.age_years(F.col("d"), AS_OF, exact=True)) == [17]


@pytest.mark.parametrize("lo,hi", [(18, 65), (0, 0), (0, 1), (-2, 0), (-3, -1), (16, 16)])
def test_age_range_selects_what_the_computed_age_selects(spark, lo, hi):
    days = spark.range(-1200, 365 * 67).select(F.date_sub(F.lit(AS_OF), F.col("id").cast("int")).alias("d"))
    differing = days.where(
        f.age_between(F.col("d"), lo, hi, AS_OF) != f.age_years(F.col("d"), AS_OF).between(lo, hi)
    )
    assert differing.count() == 0


def test_months_since(spark):
    df = spark.createDataFrame([(date(2000, 6, 30),), (date(2000, 7, 1),), (date(1999, 6, 1),), (None,)], "d date")
    assert values(df, f.months_since(F.col("d"), 200006)) == [0, -1, 12, None]


@pytest.mark.parametrize("lo,hi", [(0, 12), (None, 12), (0, 13), (6, 6), (-3, 0)])
def test_recency_range_selects_what_the_month_count_selects(spark, lo, hi):
    days = spark.range(0, 1500).select(F.date_add(F.lit(date(1998, 1, 1)), F.col("id").cast("int")).alias("d"))
    months = f.months_since(F.col("d"), 200006)
    computed = months <= hi if lo is None else months.between(lo, hi)
    assert days.where(f.recency_filter(F.col("d"), 200006, lo, hi) != computed).count() == 0
    undated = spark.createDataFrame([(None,)], "d date")
    assert undated.where(f.recency_filter(F.col("d"), 200006, lo, hi)).count() == 0


def test_month_columns(spark):
    df = spark.createDataFrame([(199912,), (200001,)], "m int")
    assert values(df, f.month_to_date(F.col("m"))) == [date(1999, 12, 1), date(2000, 1, 1)]
    assert values(df, f.shift_month(F.col("m"), 1)) == [200001, 200002]
    assert values(df, f.shift_month(F.col("m"), -1)) == [199911, 199912]


def test_month_parameters():
    assert Month(199912).plus(1) == Month(200001) and Month(200001).plus(-13) == Month(199812)
    assert Month(200002).last_day == date(2000, 2, 29)
    assert Month(202510).absolute == 2025 * 12 + 10
    assert (Period(202512).rf_payroll, Period(202512).rf_queue) == (202601, 202512)
    with pytest.raises(ValueError):
        Month(202513)


def expected_level(literate, attends, course_now, grade_now, course_past, grade_past):
    """The level table, cell by cell, as nested plain tests."""
    if literate != 1:
        return "Não Informado"
    c, s = (course_now, grade_now) if attends in (1, 2) else (course_past, grade_past)
    if attends in (1, 2):
        if (c == 7 and s in (1, 10)) or c in (10, 11):
            return "EFI"
        if (c == 4 and s in range(2, 9)) or (c == 5 and s in range(3, 10)):
            return "EFC"
        return {7: "EMI" if s in (2, 3, 4) else None, 14: "EMC", 13: "ES OU +"}.get(c) or "Não Informado"
    if attends == 3:
        if (c in (5, 7) and s in (8, 10)) or (c == 6 and s in (9, 10)) or c == 11:
            return "EFI"
        grades = {4: (1, 2, 3, 4, 10), 5: (5, 6, 7), 6: range(2, 9), 7: range(1, 8), 10: range(0, 99)}
        if s in grades.get(c, ()):
            return "EFC"
        if c in (8, 9) and s in (1, 2):
            return "EMI"
        if (c in (8, 9) and s in (3, 4, 10)) or c == 12:
            return "EMC"
        return "ES OU +" if c == 13 else "Não Informado"
    return "Não Informado"


def test_schooling_levels_over_every_cell(frame):
    names = [x.name for x in SCHOOLING.fields][1:]
    cells = [(lit, att, c, s, 15 - c, s) for lit, att, c, s in product((1, 2), (1, 2, 3, 4), range(1, 15), range(0, 12))]
    rows = frame(SCHOOLING, [dict(zip(names, cell)) for cell in cells])
    got = rows.select(*names, f.schooling_level().alias("full"), f.schooling_level_short().alias("short")).collect()
    for r in got:
        want = expected_level(*r[:6])
        assert r["full"] == want, r
        assert r["short"] == (want if want in ("EMI", "EMC") else "OUTROS"), r


def test_schooling_without_codes(frame):
    rows = frame(SCHOOLING, [{}, {"CO_SABE_LER_ESCREVER_MEMB": 1}, {"CO_SABE_LER_ESCREVER_MEMB": 1, "IN_FREQUENTA_ESCOLA_MEMB": 1}])
    assert values(rows, f.schooling_level()) == ["Não Informado"] * 3
    # Attending course 10 counts as EFI, although it is listed under EFC too; no grade is needed.
    ten = {"CO_SABE_LER_ESCREVER_MEMB": 1, "IN_FREQUENTA_ESCOLA_MEMB": 2, "CO_CURSO_FREQUENTA_MEMB": 10}
    assert values(frame(SCHOOLING, [ten]), f.schooling_level()) == ["EFI"]


def test_phone_and_sex(frame):
    phones = frame(CONTACT, [{"NU_TEL_CONTATO_1_FAM": t} for t in (None, "0999", "00999", "999", "")])
    assert values(phones, f.phone_clean(F.col("NU_TEL_CONTATO_1_FAM"))) == [None, "999", "0999", "999", ""]
    people = frame(PERSON, [{"CO_SEXO_PESSOA": s} for s in (1, 2, 3, None)])
    assert values(people, f.sex_label(F.col("CO_SEXO_PESSOA"))) == ["Masculino", "Feminino"] + ["Não informado"] * 2


def test_benefit_columns(spark):
    rows = [  # on payroll, in queue, situation -> flag, status, category
        (True, False, None, "TRUE", "ATIVO", "PBF"),
        (True, False, "L", "TRUE", "ATIVO", "PBF"),
        (True, False, "NAO INFORMADO", "TRUE", "ATIVO", "PBF"),
        (True, False, "SUSPENSO", "FALSE", "SUSPENSO", "PBF"),
        (True, False, "BLOQUEADO", "FALSE", "BLOQUEADO", "PBF"),
        (True, False, " liberado ", "TRUE", None, "PBF"),
        (False, False, None, "FALSE", None, "CAD"),
        (False, True, None, "FALSE", "PRÉ-HABILITADO", "PRE"),
        (True, True, "SUSPENSO", "FALSE", "PRÉ-HABILITADO", "PRE"),
    ]
    df = spark.createDataFrame(rows, "paid boolean, queued boolean, s string, a string, b string, c string")
    paid, queued, s = F.col("paid"), F.col("queued"), F.col("s")
    got = df.select(f.benefit_flag(paid, s), f.benefit_status(queued, paid, s), f.category(queued, paid)).collect()
    assert [tuple(r) for r in got] == [r[3:] for r in rows]


def test_quotas_round_up_one_by_one():
    plan = SamplePlan(250)
    assert plan.quotas() == {"CAD": 100, "PRE": 88, "PBF": 63}
    assert SamplePlan(250, cap=True).quotas() == {"CAD": 99, "PRE": 88, "PBF": 63}
