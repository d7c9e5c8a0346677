"""Every catalogue query against its SQL counterpart, and again without any broadcast or size limit met."""

import os

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect
from rollcall.catalog import all_entries
from rollcall.catalog.entries import Star
from rollcall.operators import sizing

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ENTRIES = all_entries()
JOBS = [e for e in ENTRIES if e.name.startswith(("q", "b24", "r08"))]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("entry", ENTRIES, ids=lambda e: e.name)
def test_matches_sql(spark, con, entry):
    _, problem = compare(spark, con, entry, SF_DIR)
    assert problem is None


@pytest.mark.parametrize("entry", JOBS, ids=lambda e: e.name)
def test_large_path_matches_sql(spark, con, entry, monkeypatch):
    """Nothing counts as small: every size check takes its other way, through shuffled joins."""
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, problem = compare(spark, con, entry, SF_DIR)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert problem is None


def test_contract(spark):
    names = [e.name for e in ENTRIES]
    assert len(names) == len(set(names))
    # Training-data queries are registered too where their package is present; not all of them have SQL.
    others = set(contract.LLM_QUERIES) | ({"pipeline"} if contract.corpus_pipeline else set())
    assert set(contract.queries()) == set(names) | others
    assert set(names) <= set(contract.oracle_sql()) <= set(names) | others
    assert contract.entry(spark).count() > 0


def test_every_inventory_line_has_a_query():
    ids = {e.name.split("_")[0] for e in ENTRIES}
    wanted = {f"{kind}{n:02d}" for kind, last in (("r", 52), ("s", 21), ("b", 29), ("q", 24)) for n in range(1, last + 1)}
    assert wanted <= ids


def test_payroll_policies_contain_each_other(spark):
    """Paid under the strictest policy implies paid under the looser ones."""
    from pyspark.sql import functions as F

    from rollcall.catalog.entries import PERIOD
    from rollcall.plans.reconciliation import reconcile

    star = Star(spark, SF_DIR)
    paid = {
        p: {tuple(r) for r in reconcile(star.reg, star.people, PERIOD, p).where(F.col("PBF") == "SIM").select("NOME", "CPF").collect()}
        for p in ("current_family", "any_family_if_person3", "any_family")
    }
    assert paid["current_family"] <= paid["any_family_if_person3"] <= paid["any_family"]
    assert paid["current_family"]


def test_counts_add_up(spark):
    from rollcall.catalog.entries import NEXT_QUEUE, PERIOD
    from rollcall.plans import headcounts

    reg = Star(spark, SF_DIR).reg
    by_uf = {r[0]: r[1] for r in headcounts.queued_families_by_uf(reg, NEXT_QUEUE).collect()}
    total = by_uf.pop("TOTAL BRASIL")
    assert total == sum(by_uf.values()) > 0
    for row in headcounts.update_recency_by_uf(reg, PERIOD.anomes_ods).collect():
        assert sum(row[2:]) <= row[1]
    months = [r[0] for r in headcounts.payroll_months(reg.payroll).collect()]
    assert months == sorted(months, reverse=True)
    assert headcounts.latest_payroll_month(reg.payroll).collect()[0][0] == months[0]
