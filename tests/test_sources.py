from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rollcall.params import Period, Territory
from rollcall.schemas import FAMILY, PAYROLL, PEOPLE_LIST, TABLES, MissingColumns, conform
from rollcall.sources import (
    SnapshotStore,
    count_for,
    parameter_rows,
    people_list,
    read_people_list,
    rejected,
    write_bucketed,
    write_monthly_view,
    write_report,
    write_snapshot_table,
)


def formatted_plan(df):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark, frame, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("snapshots"))
    for month, shift in ((200005, 0), (200006, 100)):
        rows = [
            {
                "CO_FAMILIAR_FAM": shift + i,
                "CO_EST_CADASTRAL_FAM": 3,
                "CO_MUNIC_IBGE_2_FAM": 35 if i % 2 else 31,
                "CO_MUNIC_IBGE_5_FAM": i,
                "DT_ULT_ATUAL_FAM": date(2000, 1, 1),
            }
            for i in range(20)
        ]
        write_snapshot_table(frame(FAMILY, rows), root, "TB_FAMILIA_01", month)
        for name in set(TABLES) - {"TB_FAMILIA_01", "VW_FOLHA_PAGAMENTO", "VW_PRE_HABILITACAO_PBF"}:
            write_snapshot_table(frame(TABLES[name], [{}]), root, name, month)
    pay = [{"CO_FAMILIAR": f, "RF_FOLHA": m} for m in (200006, 200007) for f in range(5)]
    write_monthly_view(frame(PAYROLL, pay), root, "VW_FOLHA_PAGAMENTO")
    write_monthly_view(frame(TABLES["VW_PRE_HABILITACAO_PBF"], pay), root, "VW_PRE_HABILITACAO_PBF")
    return root


def test_snapshot_reads_one_month(spark, stored):
    store = SnapshotStore.parquet(spark, stored)
    families = store.at(200006).registry().family
    assert families.columns == FAMILY.names
    assert sorted(r[0] for r in families.select("CO_FAMILIAR_FAM").collect()) == list(range(100, 120))
    plan = formatted_plan(families.where("CO_MUNIC_IBGE_2_FAM = 35").select("CO_FAMILIAR_FAM"))
    assert "PartitionFilters: [isnotnull(anomes_ods" in plan and "= 200006)]" in plan
    assert "EqualTo(CO_MUNIC_IBGE_2_FAM,35)" in plan
    assert "ReadSchema: struct<CO_FAMILIAR_FAM:bigint,CO_MUNIC_IBGE_2_FAM:int>" in plan


def test_rewriting_a_month_keeps_the_others(spark, frame, stored, tmp_path):
    root = str(tmp_path)
    view = "VW_FOLHA_PAGAMENTO"
    write_monthly_view(frame(PAYROLL, [{"CO_FAMILIAR": 1, "RF_FOLHA": m} for m in (200001, 200002)]), root, view)
    write_monthly_view(frame(PAYROLL, [{"CO_FAMILIAR": 2, "RF_FOLHA": 200002}]), root, view)
    rows = SnapshotStore.parquet(spark, root).at(200001).table(view).collect()
    assert sorted((r.CO_FAMILIAR, r.RF_FOLHA) for r in rows) == [(1, 200001), (2, 200002)]


def test_jobs_push_filters_into_stored_tables(spark, stored):
    from rollcall.functions import age_between, recency_filter
    from rollcall.operators.keysets import families_on_payroll
    from rollcall.operators.universe import families_of

    reg = SnapshotStore.parquet(spark, stored).at(200006).registry()
    assert "PartitionFilters: [isnotnull(RF_FOLHA" in formatted_plan(families_on_payroll(reg.payroll, 200007))
    assert "Not(In(CO_EST_CADASTRAL_FAM, [1,2,4]))" in formatted_plan(families_of(reg.family, "strict").select("CO_FAMILIAR_FAM"))
    people = reg.person.where(recency_filter(F.col("DT_ATUAL_MEMB"), 200006, 0, 12))
    plan = formatted_plan(people.where(age_between(F.col("DT_NASC_PESSOA"), 18, 65, date(2000, 6, 30))).select("NO_PESSOA"))
    assert "GreaterThanOrEqual(DT_ATUAL_MEMB,1999-06-01)" in plan and "LessThanOrEqual(DT_ATUAL_MEMB,2000-06-30)" in plan
    oldest = date(2000, 6, 30) - timedelta(days=65 * 365 + 364)
    assert f"GreaterThanOrEqual(DT_NASC_PESSOA,{oldest})" in plan


def scanned(spark, df):
    """Rows that came out of each scan of the executed plan, from its metrics."""
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name == "FileSourceScanExec":
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return found


def test_looked_up_person_is_found_by_the_bloom_filter(spark, frame, tmp_path):
    """Persons are sorted by family, so each file spans all person keys; only its Bloom filter can exclude it."""
    n = 20_000
    person = frame(TABLES["TB_PESSOA_04"], [{"CO_FAMILIAR_FAM": i, "CO_CHV_NATURAL_PESSOA": i * 7919 % n} for i in range(n)])
    shuffle, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(shuffle)
    spark.conf.set(shuffle, "8")
    spark.conf.set(coalesce, "false")
    try:
        write_snapshot_table(person, str(tmp_path), "TB_PESSOA_04", 200006)
    finally:
        spark.conf.set(shuffle, before)
        spark.conf.unset(coalesce)
    # Parquet could also tell by its dictionaries, which it drops for many different values.
    plain = spark.read.option("parquet.filter.dictionary.enabled", "false").option("parquet.filter.columnindex.enabled", "false")
    stored = SnapshotStore(lambda name: plain.parquet(f"{tmp_path}/{name}")).at(200006).registry().person
    assert len(stored.inputFiles()) == 8
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")  # whole row groups are counted either way
    try:
        assert sum(scanned(spark, stored.where("CO_CHV_NATURAL_PESSOA = 12345").select("CO_FAMILIAR_FAM"))) <= n / 4
    finally:
        spark.conf.unset("spark.sql.parquet.enableVectorizedReader")


def test_lookup_of_one_tax_id_reaches_every_scan(spark, frame, tmp_path):
    from rollcall.plans import dossiers
    from rollcall.session import tune

    root, i = str(tmp_path), range(300)
    tables = {
        "TB_DOCUMENTO_05": [{"CO_CHV_NATURAL_PESSOA": k, "NU_CPF_PESSOA": f"{k % 100:011d}"} for k in i],
        "TB_PESSOA_04": [{"CO_CHV_NATURAL_PESSOA": k, "CO_FAMILIAR_FAM": k // 3} for k in i],
        "TB_FAMILIA_01": [{"CO_FAMILIAR_FAM": k} for k in range(100)],
        "TB_PESSOA_EXCLUIDA_19": [{"CO_CHV_NATURAL_PESSOA": 107, "CO_MOTIVO_EXCLUSAO": 4}],
    }
    for name, rows in tables.items():
        write_snapshot_table(frame(TABLES[name], rows), root, name, 200006)
    reg = SnapshotStore.parquet(spark, root).at(200006).registry()
    tune(spark)
    got = dossiers.exclusion_dossier(reg, ["00000000007"])
    plan = formatted_plan(got)
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
    assert pushed and all("In(" in line for line in pushed)
    assert any("In(CO_FAMILIAR_FAM, [2,35,69])" in line for line in pushed)
    assert any("In(CO_CHV_NATURAL_PESSOA, [107,207,7])" in line for line in pushed)
    assert sorted((r.PES_CO_CHV_NATURAL_PESSOA, r.FAM_CO_FAMILIAR_FAM, r.EXC_CO_MOTIVO_EXCLUSAO) for r in got.collect()) == [
        (7, 2, None), (107, 35, 4), (207, 69, None),
    ]
    assert dossiers.exclusion_dossier(reg, ["99999999999"]).isEmpty()
    many = [f"{k:011d}" for k in range(250)]  # more than go into a scan as literals
    assert dossiers.full_dossier(reg, many).count() == 300


def test_catalog_store(spark, frame):
    frame(PAYROLL, [{"CO_FAMILIAR": 1, "RF_FOLHA": 200001}]).createOrReplaceTempView("VW_FOLHA_PAGAMENTO")
    assert SnapshotStore.catalog(spark).at(200001).registry().payroll.count() == 1
    spark.catalog.dropTempView("VW_FOLHA_PAGAMENTO")


@pytest.fixture
def bucketed(spark, frame, tmp_path):
    spark.sql("CREATE DATABASE bucketed")
    for month, shift in ((200005, 0), (200006, 1000), (200006, 500)):  # the last replaces its month
        rows = [{"CO_FAMILIAR_FAM": shift + i, "CO_EST_CADASTRAL_FAM": 3, "CO_MUNIC_IBGE_2_FAM": 35} for i in range(200)]
        write_bucketed(frame(FAMILY, rows), "TB_FAMILIA_01", 4, month, "bucketed", str(tmp_path / "families"))
        people = [{"CO_CHV_NATURAL_PESSOA": i, "CO_FAMILIAR_FAM": shift + i % 200, "CO_EST_CADASTRAL_MEMB": 3} for i in range(600)]
        write_bucketed(frame(TABLES["TB_PESSOA_04"], people), "TB_PESSOA_04", 4, month, "bucketed", str(tmp_path / "people"))
        documents = [{"CO_CHV_NATURAL_PESSOA": i, "NU_CPF_PESSOA": str(i)} for i in range(600)]
        write_bucketed(frame(TABLES["TB_DOCUMENTO_05"], documents), "TB_DOCUMENTO_05", 4, month, "bucketed", str(tmp_path / "documents"))
    pay = [{"CO_FAMILIAR": f, "RF_FOLHA": m} for m in (200006, 200007) for f in range(500, 520)]
    write_bucketed(frame(PAYROLL, pay), "VW_FOLHA_PAGAMENTO", 4, database="bucketed", path=str(tmp_path / "paid"))
    yield SnapshotStore.catalog(spark, "bucketed").at(200006).registry()
    spark.sql("DROP DATABASE bucketed CASCADE")


def test_bucketed_tables_are_joined_without_moving_either(spark, frame, bucketed):
    from rollcall.operators.universe import active_universe

    reg = bucketed
    threshold, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(threshold, "-1")
    try:
        joined = active_universe(reg.person, reg.family)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 600
        paid = reg.payroll.where("RF_FOLHA = 200007").select(F.col("CO_FAMILIAR").alias("CO_FAMILIAR_FAM")).distinct()
        families = reg.family.join(paid, "CO_FAMILIAR_FAM", "left_semi")
        assert "Exchange" not in families._jdf.queryExecution().executedPlan().toString() and families.count() == 20
        documents = reg.document.join(reg.person, "CO_CHV_NATURAL_PESSOA")
        assert documents._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert documents.count() == 600
    finally:
        spark.conf.set(threshold, before)
    with pytest.raises(ValueError, match="anomes_ods"):
        write_bucketed(frame(FAMILY, [{}]), "TB_FAMILIA_01", 4)


def test_people_list_counts_what_it_rejects(spark):
    from pyspark.sql import Observation

    raw = [None, "", " .-/", "12A45", "1\t2", "9" * 21, "0" * 30 + "7", "123.456.789-09", "9" * 20]
    seen = Observation()
    people = people_list(spark.createDataFrame([(f"N{i}", r) for i, r in enumerate(raw)], "NOME string, CPF_RAW string"), seen)
    bad = {r["NOME"]: r["PROBLEMA"] for r in rejected(people).collect()}
    assert bad == {"N0": "EMPTY", "N1": "EMPTY", "N2": "EMPTY", "N3": "NOT DIGITS", "N4": "NOT DIGITS", "N5": "TOO LONG"}
    assert seen.get == {"rows": 9, "empty": 3, "not_digits": 2, "too_long": 1}


def test_conform_checks_and_casts(spark):
    df = spark.createDataFrame([("1", "200001", None, "x")], "CO_FAMILIAR string, RF_FOLHA string, NO_TIPO_SITIUACAO_BEN string, other string")
    assert [tuple(r) for r in conform(df, PAYROLL).collect()] == [(1, 200001, None)]
    assert conform(df, PAYROLL).schema == PAYROLL
    with pytest.raises(MissingColumns, match="RF_FOLHA"):
        conform(df.drop("RF_FOLHA"), PAYROLL, "VW_FOLHA_PAGAMENTO")


def test_people_list_from_csv_keeps_leading_zeros(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('NOME,CPF_RAW,NOTE\nAna,007,a\n"Silva, B",,b\nAna,007,c\n', encoding="utf-8")
    got = read_people_list(spark, str(path))
    assert got.columns == [*PEOPLE_LIST.names, "CPF_NUM"]
    assert sorted((r.NOME, r.CPF_RAW, None if r.CPF_NUM is None else int(r.CPF_NUM)) for r in got.collect()) == [
        ("Ana", "007", 7),
        ("Ana", "007", 7),
        ("Silva, B", None, None),
    ]
    write_report(got.select("NOME", "CPF_RAW"), str(tmp_path / "out"), "parquet")
    assert read_people_list(spark, str(tmp_path / "out"), "parquet").count() == 3


def test_write_report_csv(spark, tmp_path):
    df = spark.createDataFrame([("SP", 1), ("MG", 2)], "UF string, n int")
    write_report(df, str(tmp_path / "csv"), "csv", partition_by=["UF"])
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert sorted((r.UF, r.n) for r in back.collect()) == [("MG", "2"), ("SP", "1")]
    with pytest.raises(ValueError):
        write_report(df, str(tmp_path / "x"), "xlsx")


def test_stored_parameters_are_joined_and_prune_the_months(spark, tmp_path):
    jobs = {"state": (Period(202312), Territory(35)), "country": (Period(202312, queue_offset=1), None)}
    parameter_rows(spark, jobs).write.parquet(str(tmp_path / "parameters"))
    stored = spark.read.parquet(str(tmp_path / "parameters"))
    spark.range(90).selectExpr("id", "CAST(202311 + IF(id % 3 = 0, 90, id % 3) AS INT) AS RF_FOLHA").write.partitionBy("RF_FOLHA").parquet(str(tmp_path / "view"))
    view = spark.read.parquet(str(tmp_path / "view"))
    counted = count_for(stored, "state", view, "RF_FOLHA", "RF_FOLHA_PBF", "rows")
    assert "dynamicpruning" in formatted_plan(counted).lower()
    assert counted.columns == ["ANOMES_ODS", "RF_FOLHA_PBF", "RF_FOLHA_PRE", "REF_YM", "UF_CD", "MUN_CD", "rows"]
    assert [tuple(r) for r in counted.collect()] == [(202312, 202401, 202312, 2023 * 12 + 12, 35, None, 30)]
    assert count_for(stored, "country", view, "RF_FOLHA", "UF_CD", "rows").first()["rows"] == 0
    assert count_for(stored, "other", view, "RF_FOLHA", "RF_FOLHA_PBF", "rows").isEmpty()
