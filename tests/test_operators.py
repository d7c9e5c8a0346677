from collections import Counter
from datetime import date
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from rollcall.operators import sampling, sizing
from rollcall.operators.dedup import current_by_cpf, member_recency, one_per_key
from rollcall.operators.headcount import count_by_uf
from rollcall.operators.joins import attach
from rollcall.operators.keysets import families_on_payroll, family_benefits, family_situation, flag_membership
from rollcall.operators.recency import recency_buckets
from rollcall.operators.universe import active_universe, policy
from rollcall.params import SamplePlan
from rollcall.schemas import FAMILY, PAYROLL, PERSON, QUEUE


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_status_policies(frame):
    states = (1, 2, 3, 4, 5, None)
    families = [
        {"CO_FAMILIAR_FAM": i, "CO_EST_CADASTRAL_FAM": fs, "IN_CADASTRO_VALIDO_FAM": v, "CO_CONDICAO_CADASTRO_FAM": c}
        for i, (fs, v, c) in enumerate((fs, v, c) for fs in states for v in (1, 2, None) for c in (1, 6, None))
    ]
    persons = [
        {"CO_CHV_NATURAL_PESSOA": p, "CO_FAMILIAR_FAM": f["CO_FAMILIAR_FAM"], "CO_EST_CADASTRAL_MEMB": ms}
        for f in families
        for p, ms in enumerate((3, 4, None))
    ]
    out = lambda s: s is not None and s not in (1, 2, 4)
    tests = {
        "strict": lambda f, m: out(f["CO_EST_CADASTRAL_FAM"]) and m == 3,
        "registered_valid": lambda f, m: f["CO_EST_CADASTRAL_FAM"] == 3 and f["IN_CADASTRO_VALIDO_FAM"] == 1,
        "both3": lambda f, m: f["CO_EST_CADASTRAL_FAM"] == 3 and m == 3,
        "eligible": lambda f, m: out(f["CO_EST_CADASTRAL_FAM"])
        and m == 3
        and f["IN_CADASTRO_VALIDO_FAM"] == 1
        and f["CO_CONDICAO_CADASTRO_FAM"] == 1,
        "all": lambda f, m: True,
    }
    by_key = {f["CO_FAMILIAR_FAM"]: f for f in families}
    for rule, test in tests.items():
        got = active_universe(frame(PERSON, persons), frame(FAMILY, families), rule, family_columns=())
        want = [
            (p["CO_FAMILIAR_FAM"], p["CO_CHV_NATURAL_PESSOA"])
            for p in persons
            if test(by_key[p["CO_FAMILIAR_FAM"]], p["CO_EST_CADASTRAL_MEMB"])
        ]
        assert rows_of(got) == sorted(want, key=repr), rule
    with pytest.raises(ValueError):
        policy("none")


def payroll_rows():
    return [
        {"CO_FAMILIAR": 1, "RF_FOLHA": 200007, "NO_TIPO_SITIUACAO_BEN": "SUSPENSO"},
        {"CO_FAMILIAR": 1, "RF_FOLHA": 200007, "NO_TIPO_SITIUACAO_BEN": "LIBERADO"},
        {"CO_FAMILIAR": 1, "RF_FOLHA": 200008, "NO_TIPO_SITIUACAO_BEN": "BLOQUEADO"},
        {"CO_FAMILIAR": 2, "RF_FOLHA": 200007, "NO_TIPO_SITIUACAO_BEN": " liberado "},
        {"CO_FAMILIAR": 3, "RF_FOLHA": 200007, "NO_TIPO_SITIUACAO_BEN": None},
        {"CO_FAMILIAR": 3, "RF_FOLHA": 200007, "NO_TIPO_SITIUACAO_BEN": "BLOQUEADO"},
        {"CO_FAMILIAR": 4, "RF_FOLHA": 200008, "NO_TIPO_SITIUACAO_BEN": "BLOQUEADO"},
    ]


def test_payroll_sets(frame):
    payroll = frame(PAYROLL, payroll_rows())
    assert rows_of(families_on_payroll(payroll, 200007)) == [(1,), (2,), (3,)]
    assert rows_of(families_on_payroll(payroll, 200007, ("LIBERADO", "L"))) == [(1,), (2,)]
    assert rows_of(families_on_payroll(payroll, None)) == [(1,), (2,), (3,), (4,)]
    assert rows_of(family_situation(payroll, 200007)) == [(1, "LIBERADO"), (2, " liberado "), (3, None)]
    queue = frame(QUEUE, [{"CO_FAMILIAR": f, "RF_FOLHA": 200006} for f in (3, 3, 9)])
    got = rows_of(family_benefits(payroll, queue, 200007, 200006))
    assert got == [(1, True, False), (2, True, False), (3, True, True), (9, False, True)]


def test_flag_membership_keeps_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    keys = spark.createDataFrame([(1,), (1,), (None,)], "CO_FAMILIAR long")
    got = flag_membership(df, keys, "k", out="FL", yes=1, no=0)
    assert rows_of(got) == [(1, 1), (1, 1), (2, 0), (None, 0)]


def test_current_by_cpf_ties(spark):
    data = [
        ("a", date(2000, 1, 1), date(2000, 1, 1), 2, 1),
        ("a", date(2000, 1, 1), date(2000, 1, 1), 1, 5),
        ("a", date(2000, 1, 1), date(2000, 1, 1), 1, 4),
        ("b", None, date(2001, 1, 1), 1, 1),
        ("b", date(1990, 1, 1), None, 9, 9),
        ("c", None, None, 3, 3),
        ("d", date(2000, 1, 1), date(2000, 1, 2), 8, 8),
        ("d", date(2000, 1, 1), None, 1, 1),
    ]
    df = spark.createDataFrame(data, "CPF string, m date, f date, p long, fam long")
    got = current_by_cpf(df, member_recency("m", "f", "p", "fam")).select("CPF", "p", "fam")
    assert rows_of(got) == [("a", 1, 4), ("b", 9, 9), ("c", 3, 3), ("d", 8, 8)]


def test_one_per_key(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", "z"), (1, "a", None), (2, None, "q")], "k long, u string, v string")
    assert rows_of(one_per_key(df, "k")) == [(1, "a", None), (2, None, "q")]


def test_attach_equals_left_join(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k long, t string")
    table = spark.createDataFrame([(1, "x"), (1, "y"), (3, None), (7, "z")], "tk long, v string")
    got = attach(rows, table, "k", "tk")
    want = rows.join(table, rows.k == table.tk, "left").select("k", "t", "v")
    assert rows_of(got.select("k", "t", "v")) == rows_of(want)


def test_recency_buckets_bounds(spark):
    months = [-1, 0, 6, 7, 12, 13, 18, 19, 24, 25, 99, None]
    df = spark.createDataFrame([(m,) for m in months], "m int")
    assert [tuple(r) for r in recency_buckets(df, F.col("m"), [F.lit("x").alias("g")]).collect()] == [
        ("x", 12, 2, 2, 2, 2, 2, 1)
    ]


def test_total_row(spark):
    df = spark.createDataFrame([(35, 1), (35, 2), (31, 1), (99, 4)], "c int, p int")
    uf = F.when(F.col("c") == 35, "SP").when(F.col("c") == 31, "MG").otherwise("NA")
    assert rows_of(count_by_uf(df, uf, "n", total_row=True)) == [("MG", 1), ("NA", 1), ("SP", 2), ("TOTAL BRASIL", 4)]
    distinct = rows_of(count_by_uf(df, uf, "n", distinct="p", total_row=True))
    assert distinct == [("MG", 1), ("NA", 1), ("SP", 2), ("TOTAL BRASIL", 3)]
    none = df.where("c < 0")
    assert rows_of(count_by_uf(none, uf, "n", total_row=True)) == [("TOTAL BRASIL", 0)]
    assert rows_of(count_by_uf(none, uf, "n", distinct="p", total_row=True)) == [("TOTAL BRASIL", 0)]
    assert rows_of(count_by_uf(none, uf, "n")) == []


# Sampling against brute force ------------------------------------------------------------------------
def hash_key(cpf):
    return md5(cpf.encode()).hexdigest(), cpf


def brute_sample(rows, quotas, fill):
    ranked = {c: sorted((cpf for cpf, cat in rows if cat == c), key=hash_key) for c in quotas}
    picked = {(cpf, c) for c, q in quotas.items() for cpf in ranked[c][:q]}
    lacking = sum(quotas.values()) - len(picked)
    rest = [cpf for cpf in ranked[fill] if (cpf, fill) not in picked]
    return sorted(picked | {(cpf, fill) for cpf in rest[:lacking]})


@pytest.mark.parametrize("group_limit", [1000, 0], ids=["group_limit", "histogram"])
@pytest.mark.parametrize(
    "sizes",
    [
        {"CAD": 300, "PRE": 200, "PBF": 200},
        {"CAD": 300, "PRE": 10, "PBF": 5},
        {"CAD": 20, "PRE": 300, "PBF": 0},
        {"CAD": 0, "PRE": 0, "PBF": 300},
        {"CAD": 0, "PRE": 0, "PBF": 0},
    ],
)
def test_stratified_sample_against_brute_force(spark, monkeypatch, sizes, group_limit):
    monkeypatch.setattr(sampling, "GROUP_LIMIT_RANKS", group_limit)
    rows = [(f"{i:011d}{c}", c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "CPF string, CATEGORIA string")
    plan = SamplePlan(100)
    got = sampling.stratified_sample(df, plan)
    assert [tuple(r) for r in sorted(got.collect())] == brute_sample(rows, plan.quotas(), "CAD")


@pytest.mark.parametrize("group_limit", [1000, 0], ids=["top_n", "histogram"])
def test_simple_sample_against_brute_force(spark, monkeypatch, group_limit):
    monkeypatch.setattr(sampling, "GROUP_LIMIT_RANKS", group_limit)
    rows = [f"{i:011d}" for i in range(500)]
    df = spark.createDataFrame([(r,) for r in rows], "CPF string")
    for n in (0, 1, 77, 500, 900):
        got = sorted(r[0] for r in sampling.simple_sample(df, n).collect())
        assert got == sorted(sorted(rows, key=hash_key)[:n])


def test_first_per_stratum_and_take_by_relation(spark, monkeypatch):
    rows = [(f"{i:05d}", "AB"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "CPF string, CATEGORIA string")
    want = sorted(
        (cpf, c, n)
        for c, q in (("A", 30), ("B", 7))
        for n, cpf in enumerate(sorted((x for x, k in rows if k == c), key=hash_key)[:q], 1)
    )
    for limit in (1000, 0):
        monkeypatch.setattr(sampling, "GROUP_LIMIT_RANKS", limit)
        got = sampling.first_per_stratum(df, {"A": 30, "B": 7})
        assert sorted(tuple(r) for r in got.collect()) == want
    one_row = spark.createDataFrame([(55,)], "n long")
    got = sampling.take_by_relation(df, one_row, "n")
    assert sorted(r[0] for r in got.collect()) == sorted(sorted((x for x, _ in rows), key=hash_key)[:55])


# Size checks -----------------------------------------------------------------------------------------
def test_measure_broadcasts_only_below_the_limit(spark):
    keys = spark.createDataFrame([(i % 10,) for i in range(40)] + [(None,)], "k long")
    big = spark.range(1000).withColumnRenamed("id", "k")
    small = sizing.measure_keys(keys)
    assert small.small and small.narrow(big, "k").count() == 10
    assert sizing.measure_keys(keys, max_rows=10).small  # too many rows, but few enough keys
    large = sizing.measure_keys(keys, max_rows=9)
    assert not large.small and large.narrow(big, "k") is big and large.hinted() is large.frame
    assert Counter(r[0] for r in large.frame.collect()) == Counter(range(10))
    kept = sizing.measure(big.where("k < 5"), keep=True)
    assert kept.rows == 5 and kept.frame.count() == 5


# Seeds and missing keys ------------------------------------------------------------------------------
@pytest.mark.parametrize("group_limit", [1000, 0], ids=["top_n", "histogram"])
def test_a_seed_draws_others_and_repeats_itself(spark, monkeypatch, group_limit):
    monkeypatch.setattr(sampling, "GROUP_LIMIT_RANKS", group_limit)
    rows = [f"{i:011d}" for i in range(500)]
    df = spark.createDataFrame([(r, "CAD") for r in rows], "CPF string, CATEGORIA string")
    for seed in (1, 2):
        want = sorted(sorted(rows, key=lambda r: hash_key(f"{seed}:{r}"))[:40])
        assert sorted(r[0] for r in sampling.simple_sample(df, 40, seed=seed).collect()) == want
        plan = SamplePlan(40, shares={"CAD": 1}, seed=seed)
        assert sorted(r[0] for r in sampling.stratified_sample(df, plan).collect()) == want


def test_strata_outside_the_plan_do_not_count(spark):
    rows = [(f"{i:05d}", f"S{i}") for i in range(300)] + [(f"{i:05d}", "CAD") for i in range(300, 400)]
    df = spark.createDataFrame(rows, "CPF string, CATEGORIA string")
    got = sampling.stratified_sample(df, SamplePlan(20)).collect()
    assert len(got) == 20 and {r["CATEGORIA"] for r in got} == {"CAD"}


def test_vacancies_give_the_sample_size():
    assert [SamplePlan.for_vacancies(n).total for n in (0, 12, 13, 100)] == [250, 250, 260, 2000]
