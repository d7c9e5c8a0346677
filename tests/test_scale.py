"""Plans keep their shape, and a key holding a third of the rows is split rather than piled on one task."""

from contextlib import contextmanager
from datetime import date

import pytest
from pyspark.sql import functions as F

from rollcall.catalog import all_entries
from rollcall.catalog.entries import PERIOD, Star
from rollcall.operators import sampling, sizing, skew
from rollcall.operators.dedup import current_by_cpf
from rollcall.operators.evidence import cpf_evidence, cpf_payroll_flag, cpf_trail
from rollcall.operators.joins import attach
from rollcall.operators.keysets import flag_membership, members_of
from rollcall.operators.universe import active_universe
from rollcall.params import SamplePlan
from rollcall.plans import headcounts, reconciliation
from rollcall.registry import Registry
from rollcall.sources import people_list

SF_DIR = "/root/testdata/sf0.001"
ROWS = 60_000


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffled(spark):
    """Joins shuffle, and partitions above a few KB already count as skewed."""
    return settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="1KB",
        spark__sql__shuffle__partitions="16",
    )


def executed(df):
    rows = [tuple(r) for r in df.collect()]
    return rows, df._jdf.queryExecution().executedPlan().toString()


def hot(spark, key_if_hot, key_else, **columns):
    """Rows of which every third has the hot key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(key_if_hot)).otherwise(key_else)
    return spark.range(0, ROWS, numPartitions=6).select(key.alias("k"), "id", *[c.alias(n) for n, c in columns.items()])


@pytest.fixture
def hot_family(spark):
    """A third of the persons live in one family."""
    people = hot(spark, 7, F.col("id") % 5000).selectExpr(
        "id AS CO_CHV_NATURAL_PESSOA", "k AS CO_FAMILIAR_FAM", "3 AS CO_EST_CADASTRAL_MEMB", "DATE '2000-01-01' AS DT_ATUAL_MEMB"
    )
    families = spark.range(0, 5000, numPartitions=2).selectExpr(
        "id AS CO_FAMILIAR_FAM", "3 AS CO_EST_CADASTRAL_FAM", "35 AS CO_MUNIC_IBGE_2_FAM", "1 AS CO_MUNIC_IBGE_5_FAM"
    )
    paid = spark.range(0, 10).selectExpr("id AS CO_FAMILIAR", "200007 AS RF_FOLHA", "'L' AS NO_TIPO_SITIUACAO_BEN")
    tables = {"TB_PESSOA_04": people, "TB_FAMILIA_01": families, "VW_FOLHA_PAGAMENTO": paid}

    def open_table(name):
        from rollcall.schemas import TABLES

        df = tables[name]
        return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name].fields if f.name not in df.columns])

    return Registry(open_table), people


def test_hot_family_is_split_where_stored_tables_meet(spark, hot_family):
    """Adaptive execution splits it, also below a distinct that reuses the join's partitioning."""
    reg, _ = hot_family
    with shuffled(spark):
        rows, plan = executed(headcounts.update_recency_by_uf(reg, 200006))
        assert "skew=true" in plan and rows[0][:3] == ("SP", ROWS, ROWS)
        rows, plan = executed(headcounts.registered_persons_by_uf(reg))
        assert "skew=true" in plan and rows == [("SP", ROWS)]


def balanced(df, tasks=16):
    """Rows of each task that makes ``df``; the fullest has at most twice its share."""
    with settings(df.sparkSession, spark__sql__shuffle__partitions=str(tasks), spark__sql__adaptive__coalescePartitions__enabled="false"):
        counts = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(counts) <= 2 * sum(counts) / tasks, sorted(counts)
    return sum(counts)


def test_hot_family_is_spread_where_derived_families_are_joined(spark, hot_family):
    reg, people = hot_family
    assert list(skew.frequent_keys(people, "CO_FAMILIAR_FAM").first()[0]) == [7]
    in_paid = sum(1 for i in range(ROWS) if (7 if i % 3 == 0 else i % 5000) < 10)
    with shuffled(spark):
        rows, plan = executed(headcounts.persons_registered_and_paid(reg, PERIOD))
        assert rows == [(ROWS, in_paid)] and "Union" not in plan
        rows, _ = executed(headcounts.paid_persons_by_uf(reg, PERIOD))
        assert rows == [("SP", in_paid)]
        families = reg.family.join(reg.family.select("CO_FAMILIAR_FAM").distinct(), "CO_FAMILIAR_FAM", "left_semi")
        assert balanced(active_universe(reg.person, families, derived=True)) == ROWS


@pytest.fixture
def third_hot_third_null(spark):
    return hot(spark, 7, F.when(F.col("id") % 3 == 1, F.col("id") % 5000))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, third_hot_third_null, how):
    left = third_hot_third_null
    right = spark.range(0, 3000).select(F.when(F.col("id") != 5, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    right = right.unionByName(right.where("k in (7, 10)"))  # keys may repeat
    with shuffled(spark):
        salted = skew.join_salted(left, right, "k", how)
        plain = left.join(right, "k", how).select(*salted.columns)
        assert salted.count() == plain.count()
        assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_salted_join_is_balanced_and_costs_one_more_exchange(spark, third_hot_third_null):
    left = third_hot_third_null
    right = spark.range(0, 20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.max("id").alias("v"))
    with shuffled(spark):
        assert balanced(skew.join_salted(left, right, "k", "left")) == ROWS
        assert balanced(skew.join_salted(left, right, "k", "inner")) == 2 * ROWS // 3
        assert balanced(skew.join_salted(left, right.where("k % 2 = 0"), "k", "left_anti")) > ROWS // 2

        def exchanges(df):
            return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

        assert exchanges(skew.join_salted(left, right, "k", "left")) == 1.5 * exchanges(left.join(right, "k", "left")) == 3


def test_repeated_rows_of_a_hot_key_are_attached_in_balance(spark, third_hot_third_null):
    """A third of the attached table on one key, which some rows have, some lack, and some rows have none."""
    table = third_hot_third_null.select(F.col("k").alias("tk"), F.col("id").alias("v"))
    rows = spark.range(0, 9000, numPartitions=3).selectExpr("IF(id % 3 = 0, NULL, id) AS k", "id AS r")
    rows = rows.unionByName(spark.range(2).selectExpr("7L AS k", "id + 9000 AS r"))
    with shuffled(spark):
        got = attach(rows, table, "k", "tk")
        assert got.columns == ["k", "r", "v"]
        want = rows.join(table, rows.k == table.tk, "left").select("k", "r", "v")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        tasks = got.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.sum("count")).first()
        assert tasks[0] < 0.2 * tasks[1]


def test_frequent_keys_are_all_found_however_many(spark):
    """300 keys with a five-hundredth of the rows each stay unmarked, 100 with a 150th each are all marked."""
    even = spark.range(0, 50_000).select((F.col("id") % 500).alias("k"))
    assert skew.frequent_keys(even, "k").first()[0] == {}
    some = spark.range(0, 60_000).select(F.when(F.col("id") % 3 < 2, F.col("id") % 100 - 100).otherwise(F.col("id")).alias("k"))
    found = skew.frequent_keys(some, "k").first()[0]
    assert set(found) == set(range(-100, 0)) and set(found.values()) <= {6, 7, 8}
    assert skew.frequent_keys(spark.range(0), "id").first()[0] == {}


def test_memberships_with_a_hot_and_a_missing_family_are_balanced(spark, third_hot_third_null):
    people, keys = third_hot_third_null, spark.range(0, 2000).select(F.col("id").alias("CO_FAMILIAR"))
    inside = people.where("k < 2000").count()
    with shuffled(spark):
        flagged = flag_membership(people, keys, "k", out="FL", yes=1, no=0)
        assert balanced(flagged) == ROWS and flagged.agg(F.sum("FL")).first()[0] == inside
        assert balanced(members_of(people, keys, "k")) == inside
        assert balanced(members_of(people, keys, "k", absent=True)) == ROWS - inside


def test_evidence_with_a_third_of_persons_in_one_family_and_a_third_in_none_is_balanced(spark, third_hot_third_null):
    people = third_hot_third_null.selectExpr("id AS CO_CHV_NATURAL_PESSOA", "k AS CO_FAMILIAR_FAM", "3 AS CO_EST_CADASTRAL_MEMB", "DATE '2000-01-01' AS DT_ATUAL_MEMB")
    families = spark.range(0, 5000).selectExpr("id AS CO_FAMILIAR_FAM", "3 AS CO_EST_CADASTRAL_FAM", "DATE '2000-01-01' AS DT_ATUALIZACAO_FAM")
    benefits = spark.range(0, 10).selectExpr("id AS CO_FAMILIAR", "true AS ON_PAYROLL", "false AS IN_QUEUE")
    numbers = people.selectExpr("CAST(CO_CHV_NATURAL_PESSOA % 20000 AS DECIMAL(20,0)) AS CPF_NUM", "CO_CHV_NATURAL_PESSOA")
    with shuffled(spark):
        trail = cpf_trail(numbers, people, families, benefits)
        assert balanced(trail.where("PERSON_KEY IS NOT NULL")) == ROWS
        evidence = cpf_evidence(trail).agg(F.count("*"), F.sum("FL_TEM_FAMILIA"), F.sum("FL_PESSOA_3")).first()
        paid = cpf_payroll_flag(trail, "any_family").agg(F.sum("FL_PBF")).first()[0]
    in_family = {i % 20000 for i in range(ROWS) if i % 3 < 2}
    in_paid = {i % 20000 for i in range(ROWS) if i % 3 == 0 or i % 3 == 1 and i % 5000 < 10}
    assert tuple(evidence) == (20000, len(in_family), 20000) and paid == len(in_paid)


def test_hot_family_shrinks_before_the_shuffle_when_only_keys_matter(spark, hot_family):
    reg, _ = hot_family
    with shuffled(spark):
        rows, plan = executed(headcounts.families_registered_and_paid(reg, PERIOD))
    assert rows == [(5000, 10)] and "skew=true" not in plan


def test_hot_cpf_is_cut_before_the_shuffle(spark):
    df = hot(spark, "00000000000", F.lpad(F.col("id").cast("string"), 11, "0"), d=F.date_add(F.lit(date(2000, 1, 1)), (F.col("id") % 50).cast("int")))
    best = current_by_cpf(df, [F.col("d").desc_nulls_last(), F.col("id").asc()], "k")
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the exchange
    assert best.count() == ROWS - ROWS // 3 + 1
    assert best.where("k = '00000000000'").select("id").collect()[0][0] == 99  # day 49, smallest multiple of 3


@pytest.mark.parametrize("files", [1, 6])
def test_hot_cpf_in_a_large_list(spark, monkeypatch, files):
    """A list too large to broadcast, a third of it one tax id and a third without any, also from a single file."""
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", -1)
    raw = F.when(F.col("id") % 3 == 0, "7").when(F.col("id") % 3 == 1, F.lit(None).cast("string")).otherwise(F.col("id").cast("string"))
    people = people_list(
        spark.range(0, ROWS, numPartitions=files).select(F.concat(F.lit("N"), F.col("id") % 1000).alias("NOME"), raw.alias("CPF_RAW"))
    )
    with shuffled(spark):
        star = Star(spark, SF_DIR)
        report = reconciliation.reconcile(star.reg, people, PERIOD, "any_family")
        rows, plan = executed(report)
        evidence = spark.range(0, 100).selectExpr("CAST(id AS DECIMAL(20,0)) AS CPF_NUM", "1 AS FL").distinct()
        assert balanced(skew.join_salted(people, evidence, "CPF_NUM", "left", vary=("NOME", "CPF_NUM"))) == ROWS
    assert len(rows) == ROWS
    assert sum(r[1] is None for r in rows) == ROWS // 3
    assert sum(r[1] == "00000000007" for r in rows) == ROWS // 3


def test_large_sample_is_ranked_in_many_small_groups(spark):
    df = hot(spark, "CAD", F.when(F.col("id") % 3 == 1, "PRE").otherwise("PBF")).selectExpr(
        "k AS CATEGORIA", "lpad(CAST(id AS STRING), 11, '0') AS CPF"
    )
    plan = SamplePlan(30_000)
    assert sum(plan.quotas().values()) > sampling.GROUP_LIMIT_RANKS
    out = sampling.stratified_sample(df, plan)
    text = out._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line and "row_number" in line]
    assert windows and all("_bucket" in line for line in windows)
    assert {r[0]: r[1] for r in out.groupBy("CATEGORIA").count().collect()} == plan.quotas()


def test_wide_rows_are_not_broadcast_but_their_keys_are(spark, monkeypatch):
    wide = spark.range(0, 100).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("text"), F.lit(1).cast("decimal(20,0)").alias("n"))
    for keep in (False, True):
        found = sizing.measure(wide, keep=keep)
        assert (found.rows, found.bytes) == (100, 100 * (8 + 8 + 1008 + 16))
    big = spark.range(0, 10_000).withColumnRenamed("id", "k")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):

        def plan(df):
            return df._jdf.queryExecution().executedPlan().toString()

        assert "BroadcastHashJoin" in plan(big.join(found.hinted(), "k"))
        monkeypatch.setattr(sizing, "MAX_BROADCAST_BYTES", 50_000)
        joined = found.narrow(big, "k").join(found.hinted(), "k")
        assert "SortMergeJoin" in plan(joined) and plan(joined).count("BroadcastHashJoin") == 1 and joined.count() == 100
    keys = sizing.measure_keys(spark.createDataFrame([("ab",), ("ab",), (None,)], "k string"))
    assert (keys.rows, keys.bytes, keys.frame.count()) == (3, 3 * 16 + 4, 1)


def test_large_samples_write_no_table(spark, monkeypatch):
    """The population is not copied: rows are read once for the cut-off, key and stratum only, and once for the sample."""
    from rollcall import session

    monkeypatch.setattr(session, "settle", None)
    df = spark.range(0, 50_000).selectExpr("IF(id % 2 = 0, 'CAD', 'PRE') AS CATEGORIA", "CAST(id AS STRING) AS CPF", "id AS other")
    assert sampling.simple_sample(df, 5_000).count() == 5_000
    picked = sampling.stratified_sample(df, SamplePlan(total=3_000, shares={"CAD": 0.5, "PRE": 0.5}))
    assert picked.count() == 3_000
    assert sampling.take_by_relation(df, spark.sql("SELECT 2000 AS n"), "n").count() == 2_000


def test_small_sample_is_cut_before_the_shuffle(spark):
    df = spark.range(0, 1000).selectExpr("IF(id % 2 = 0, 'CAD', 'PRE') AS CATEGORIA", "CAST(id AS STRING) AS CPF")
    text = sampling.stratified_sample(df, SamplePlan(100))._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2
    top = sampling.simple_sample(df, 100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


@pytest.mark.parametrize("entry", [e for e in all_entries() if e.name.startswith("q")], ids=lambda e: e.name)
def test_jobs_have_no_pairwise_joins_and_no_python(spark, entry, monkeypatch):
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", -1)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = entry.run(Star(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan
    # Without a small side nothing is broadcast: every relation that grows goes through a shuffled join.
    assert "BroadcastHashJoin" not in plan
