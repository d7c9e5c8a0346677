from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from rollcall.params import CandidateRules, Period, SamplePlan, Territory
from rollcall.plans import dossiers, extractions, headcounts, reconciliation
from rollcall.schemas import PEOPLE_LIST
from rollcall.sources import people_list

PERIOD = Period(200006, as_of=date(2000, 6, 30))


def family(key, state=3, **extra):
    return {
        "CO_FAMILIAR_FAM": key,
        "CO_EST_CADASTRAL_FAM": state,
        "IN_CADASTRO_VALIDO_FAM": 1,
        "CO_CONDICAO_CADASTRO_FAM": 1,
        "DT_ULT_ATUAL_FAM": date(2000, 1, 1),
        "DT_ATUALIZACAO_FAM": date(2000, 1, 1),
        "CO_MUNIC_IBGE_2_FAM": 52,
        "CO_MUNIC_IBGE_5_FAM": 258,
        **extra,
    }


def person(key, fam, state=3, updated=date(2000, 3, 1), **extra):
    return {
        "CO_CHV_NATURAL_PESSOA": key,
        "CO_FAMILIAR_FAM": fam,
        "CO_EST_CADASTRAL_MEMB": state,
        "DT_ATUAL_MEMB": updated,
        "DT_NASC_PESSOA": date(1970, 1, 1),
        "NO_PESSOA": f"P{key}",
        **extra,
    }


def document(cpf, key):
    return {"CO_CHV_NATURAL_PESSOA": key, "NU_CPF_PESSOA": cpf}


def paid(fam, situation="LIBERADO", month=200007):
    return {"CO_FAMILIAR": fam, "RF_FOLHA": month, "NO_TIPO_SITIUACAO_BEN": situation}


def queued(fam, month=200006):
    return {"CO_FAMILIAR": fam, "RF_FOLHA": month}


def cases(registry):
    """One tax id per reconciliation case; the first digits tell them apart."""
    return registry(
        TB_DOCUMENTO_05=[
            document("00000000001", 1),  # all in order, paid and queued
            document("00000000002", 2),  # document without a person
            document("00000000003", 3),  # person without a family
            document("00000000004", 4),  # family 3, person 4, family paid
            document("00000000005", 5),  # person 3 in family 4, person 4 in family 3
            document("00000000006", 6),  # current family not paid, older family paid
            document("7", 7),  # not padded in the registry
            document("x9", 9),  # unreadable
            document(None, 10),
        ],
        TB_PESSOA_04=[
            person(1, 10),
            person(3, 999),
            person(4, 11, state=4),
            person(5, 12, state=3),
            person(5, 13, state=4),
            person(6, 14, updated=date(2000, 5, 1)),
            person(6, 15, updated=date(1999, 5, 1)),
            person(7, 16),
        ],
        TB_FAMILIA_01=[family(f) for f in (10, 11, 13, 14, 15, 16)] + [family(12, state=4)],
        VW_FOLHA_PAGAMENTO=[paid(f) for f in (10, 10, 11, 15)],
        VW_PRE_HABILITACAO_PBF=[queued(10), queued(14, month=200005)],
    )


def listed(frame, *raw):
    return people_list(frame(PEOPLE_LIST, [{"NOME": f"N{i:02d}", "CPF_RAW": r} for i, r in enumerate(raw)]))


def answers(df, *columns):
    return [tuple(r) for r in df.orderBy("NOME").select(*columns).collect()]


RAW = ("000.000.000-01", "2", "3", "4", "5", "6", "07", "8", "", None, "abc", "1", "1")


def test_reconciliation_with_current_family(frame, registry):
    report = reconciliation.reconcile(cases(registry), listed(frame, *RAW), PERIOD)
    not_found = ("NAO", "NAO", "NAO", "NAO", "CPF NÃO ENCONTRADO NO DOC_05")
    registered = "SIM", "SIM"
    got = answers(report, "CADUNICO_ATIVO", "CADUNICO_PRESENCA", "PBF", "PRE_HABILITADO", "MOTIVO_CADUNICO")
    assert got == [
        (*registered, "SIM", "SIM", "OK"),
        ("NAO", "NAO", "NAO", "NAO", "CPF SEM PESSOA VINCULADA NO ODS"),
        ("NAO", "NAO", "NAO", "NAO", "NENHUMA FAMÍLIA COM ESTADO 3 NO ODS"),
        ("NAO", "SIM", "NAO", "NAO", "NENHUMA PESSOA COM ESTADO 3 NO ODS"),
        (*registered, "NAO", "NAO", "OK"),
        (*registered, "NAO", "NAO", "OK"),
        (*registered, "NAO", "NAO", "OK"),
        not_found,
        not_found,
        not_found,
        not_found,
        (*registered, "SIM", "SIM", "OK"),
        (*registered, "SIM", "SIM", "OK"),
    ]
    reasons = [r[0] for r in answers(report, "MOTIVO_PBF")]
    assert reasons[0] == "OK"
    assert reasons[3] == "SEM PESSOA EM ESTADO 3 → NÃO ELEGÍVEL PARA PBF"
    assert reasons[5] == "FAMÍLIA VIGENTE NÃO ENCONTRADA NA FOLHA"
    assert reasons[7] == "SEM PESSOA EM ESTADO 3 → NÃO ELEGÍVEL PARA PBF"
    cpfs = [r[0] for r in answers(report, "CPF")]
    assert cpfs[0] == "00000000001" and cpfs[6] == "00000000007" and cpfs[8:11] == [None] * 3
    states = answers(report, "DEBUG_CO_EST_CADASTRAL_MEMB", "DEBUG_CO_EST_CADASTRAL_FAM")
    assert states[4] == (4, 4) and states[7] == (None, None)


def test_reconciliation_policies(frame, registry):
    people = listed(frame, *RAW)
    answer = lambda policy: [r[0] for r in answers(reconciliation.reconcile(cases(registry), people, PERIOD, policy), "PBF")]
    assert [answer("any_family")[i] for i in (0, 3, 5)] == ["SIM", "SIM", "SIM"]
    assert [answer("any_family_if_person3")[i] for i in (0, 3, 5)] == ["SIM", "NAO", "SIM"]
    assert [answer("current_family")[i] for i in (0, 3, 5)] == ["SIM", "NAO", "NAO"]
    short = reconciliation.reconcile(cases(registry), people, PERIOD, "any_family")
    assert "PRE_HABILITADO" not in short.columns
    assert answers(short, "MOTIVO_CADUNICO")[1] == ("CPF SEM PESSOA VINCULADA",)
    # State-3 person and state-3 family on different rows count as active unless one row must have both.
    assert answers(short, "CADUNICO_ATIVO")[4] == ("SIM",)
    same_row = reconciliation.reconcile(cases(registry), people, PERIOD, "any_family", same_row=True)
    assert answers(same_row, "CADUNICO_ATIVO")[4] == ("NAO",)


def test_dossiers_keep_every_combination(spark, registry):
    reg = registry(
        TB_DOCUMENTO_05=[document("1", 1), document("2", 2)],
        TB_PESSOA_04=[person(1, 10), person(1, 11), person(2, 10)],
        TB_FAMILIA_01=[family(10), family(11)],
        TB_CONTATO_09=[{"CO_FAMILIAR_FAM": 10, "DS_EMAIL_FAM": e} for e in ("a", "b")],
        TB_PESSOA_EXCLUIDA_19=[{"CO_CHV_NATURAL_PESSOA": 1, "CO_MOTIVO_EXCLUSAO": m} for m in (5, 6)],
        VW_FOLHA_PAGAMENTO=[paid(11), paid(11)],
        VW_PRE_HABILITACAO_PBF=[queued(10)],
    )
    full = dossiers.benefit_dossier(reg, ["1"], PERIOD)
    columns = ["FAM_CO_FAMILIAR_FAM", "CONT_EMAIL", "EXC_CO_MOTIVO_EXCLUSAO", "FAMILIA_NA_FOLHA_BF", "FAMILIA_PRE_HABILITADA"]
    got = sorted((tuple(r) for r in full.select(*columns).collect()), key=repr)
    assert got == sorted(
        [(10, e, m, "NAO", "SIM") for e in ("a", "b") for m in (5, 6)] + [(11, None, m, "SIM", "NAO") for m in (5, 6)],
        key=repr,
    )
    assert len(full.columns) == 46 and len(dossiers.full_dossier(reg, ["1"]).columns) == 29
    assert len(dossiers.batch_dossier(reg, ["1"]).columns) == 25 and len(dossiers.exclusion_dossier(reg, ["1"]).columns) == 28
    both = dossiers.batch_dossier(reg, spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "c string"))
    assert [r[0] for r in both.select("NU_CPF_PESSOA").collect()] == ["1", "1", "2"]
    assert dossiers.full_dossier(reg, []).count() == 0
    assert dossiers.full_dossier(reg, None).count() == 3


def people_of_town(registry):
    return registry(
        TB_FAMILIA_01=[family(10), family(11, DT_ULT_ATUAL_FAM=date(2000, 6, 1)), family(12, CO_MUNIC_IBGE_5_FAM=1), family(13)],
        TB_PESSOA_04=[person(1, 10), person(1, 11, updated=date(2000, 4, 1)), person(2, 10), person(3, 12), person(4, 13, state=4)],
        TB_DOCUMENTO_05=[document("1", 1), document("2", 2), document("2", 4), document("3", 3)],
        TB_ESCOLARIDADE_07=[
            {"CO_CHV_NATURAL_PESSOA": 1, "CO_SABE_LER_ESCREVER_MEMB": 1, "IN_FREQUENTA_ESCOLA_MEMB": 1, "CO_CURSO_FREQUENTA_MEMB": 14}
        ],
        TB_CONTATO_09=[{"CO_FAMILIAR_FAM": 10, "NU_DDD_CONTATO_1_FAM": ddd, "NU_TEL_CONTATO_1_FAM": "01"} for ddd in ("62", "61")],
        VW_FOLHA_PAGAMENTO=[paid(10), paid(10, "SUSPENSO")],
        VW_PRE_HABILITACAO_PBF=[queued(11)],
    )


TOWN = Territory.from_codibge("5200258")


def test_municipal_current_has_one_row_per_cpf(registry):
    out = extractions.municipal_current(people_of_town(registry), TOWN, PERIOD)
    assert len(out.columns) == 47
    got = [tuple(r) for r in out.select("CPF", "FAM_CO_FAMILIAR_FAM", "ESCOLARIDADE", "CONT_DDD_1", "FAMILIA_NA_FOLHA_PBF", "FAMILIA_PRE_HABILITADA").collect()]
    # The repeated contact of family 10 is settled to its smallest row.
    assert got == [("1", 11, "EMC", None, "NAO", "SIM"), ("2", 10, "Não Informado", "61", "SIM", "NAO")]


def test_municipal_history_policies(registry):
    strict = extractions.municipal_history(people_of_town(registry), TOWN, PERIOD)
    assert len(strict.columns) == 41 and strict.count() == 5  # two contacts of family 10 on two persons
    assert extractions.municipal_history(people_of_town(registry), TOWN, PERIOD, rule="all").count() == 6


def test_benefit_status_prefers_the_active_situation(registry):
    out = extractions.municipal_benefit_status(people_of_town(registry), TOWN, PERIOD, sample_size=None, municipality="Vila")
    got = [tuple(r) for r in out.orderBy("CPF").select("CPF", "MUNICIPIO", "PBF", "STATUS_PBF").collect()]
    assert got == [("1", "Vila", "FALSE", "PRÉ-HABILITADO"), ("2", "Vila", "TRUE", "ATIVO")]
    assert len(out.columns) == 16


def test_schooling_filter_before_or_after_the_choice(registry):
    level = lambda key, course: {
        "CO_CHV_NATURAL_PESSOA": key,
        "CO_SABE_LER_ESCREVER_MEMB": 1,
        "IN_FREQUENTA_ESCOLA_MEMB": 1,
        "CO_CURSO_FREQUENTA_MEMB": course,
    }
    reg = registry(
        TB_FAMILIA_01=[family(10), family(11)],
        TB_PESSOA_04=[person(1, 10, updated=date(2000, 5, 1)), person(2, 11, updated=date(2000, 1, 1))],
        TB_DOCUMENTO_05=[document("00000000005", 1), document("5", 2)],
        TB_ESCOLARIDADE_07=[level(1, 13), level(2, 14)],
    )
    rules = CandidateRules(age=(16, 50), months_since_update=(0, 12), schooling=("EMC", "EMI"))
    # As numbers both documents are tax id 5; its newest record has higher education, so none is left.
    assert extractions.state_candidates(reg, Territory(52), PERIOD, rules).count() == 0
    open_rules = CandidateRules(age=(16, 50), months_since_update=(0, 12))
    row = extractions.state_candidates(reg, Territory(52), PERIOD, open_rules).collect()
    assert [(r["CPF"], r["NIS"], r["categoria"]) for r in row] == [("00000000005", None, "CAD")]
    # The other report filters first, so the older record with secondary school is found.
    got = extractions.eligible_candidates(reg, Territory(52), PERIOD, rules).collect()
    assert [(r["CPF"], r["ESCOLARIDADE"], r["IDADE"]) for r in got] == [("5", "EMC", 30)]


def test_unreadable_cpfs_stay_apart(registry):
    reg = registry(
        TB_FAMILIA_01=[family(10)],
        TB_PESSOA_04=[person(1, 10), person(2, 10), person(3, 10)],
        TB_DOCUMENTO_05=[document("x1", 1), document("x2", 2), document("x2", 3)],
    )
    got = extractions.state_candidates(reg, Territory(52), PERIOD, CandidateRules()).collect()
    assert [(r["CPF"], r["NOME"]) for r in got] == [(None, "P1"), (None, "P2")]


def test_municipal_sample_fills_up_from_the_registry(registry):
    n = 60
    reg = registry(
        TB_FAMILIA_01=[family(f) for f in range(n)],
        TB_PESSOA_04=[person(f, f) for f in range(n)],
        TB_DOCUMENTO_05=[document(f"{f:011d}", f) for f in range(n)],
        VW_FOLHA_PAGAMENTO=[paid(f, " liberado ") for f in range(10)] + [paid(f, "SUSPENSO") for f in range(10, 20)],
        VW_PRE_HABILITACAO_PBF=[queued(f, 200007) for f in range(3)],
    )
    period = Period(200006, queue_offset=1, as_of=date(2000, 6, 30))
    out = extractions.municipal_sample(reg, TOWN, period, SamplePlan(20))
    by = {r[0]: r[1] for r in out.groupBy("CATEGORIA").count().collect()}
    assert by == {"CAD": 8 + 4, "PRE": 3, "PBF": 5}  # quotas 8/7/5, four queued families lacking
    assert out.select("CPF").distinct().count() == 20 and len(out.columns) == 15
    capped = SamplePlan(250, {"CAD": Decimal("0.4"), "PRE": Decimal("0.35"), "PBF": Decimal("0.25")}, cap=True)
    assert extractions.municipal_sample(reg, TOWN, period, capped).count() == n - 0


def test_names_of_municipalities(spark, registry):
    report = extractions.municipal_benefit_status(people_of_town(registry), TOWN, PERIOD, sample_size=None)
    assert {r[0] for r in report.select("MUNICIPIO").collect()} == {"258"}
    names = spark.createDataFrame([("5200258", "Vila Nova")], "CODIBGE string, NOME_MUNICIPIO string")
    named = extractions.name_municipalities(report, names)
    assert named.columns == report.columns and {r[0] for r in named.select("MUNICIPIO").collect()} == {"Vila Nova"}


def test_headcounts_of_nothing(registry):
    reg = registry()
    assert [tuple(r) for r in headcounts.registered_persons_of_municipality(reg, TOWN).collect()] == [("5200258", 0)]
    assert [tuple(r) for r in headcounts.queued_families_by_uf(reg, PERIOD).collect()] == [("TOTAL BRASIL", 0)]
    assert [tuple(r) for r in headcounts.persons_registered_and_paid(reg, PERIOD).collect()] == [(0, 0)]


def test_count_units_differ(registry):
    """A person in two families is one person, but two (person, family) pairs."""
    reg = registry(
        TB_FAMILIA_01=[family(10), family(11, CO_MUNIC_IBGE_2_FAM=35)],
        TB_PESSOA_04=[person(1, 10), person(1, 10), person(1, 11)],
        VW_FOLHA_PAGAMENTO=[paid(10), paid(11)],
        VW_PRE_HABILITACAO_PBF=[queued(10), queued(11)],
    )
    one = lambda df: [tuple(r) for r in df.collect()]
    assert one(headcounts.registered_persons(reg)) == [(1,)]
    assert one(headcounts.registered_persons_by_uf(reg)) == [("GO", 1), ("SP", 1)]
    assert one(headcounts.persons_registered_and_paid(reg, PERIOD)) == [(2, 1)]
    assert one(headcounts.queued_persons_by_uf(reg, PERIOD)) == [("GO", 1), ("SP", 1), ("TOTAL BRASIL", 2)]
    assert [r[1] for r in headcounts.update_recency_by_uf(reg, 200006).collect()] == [1, 1]
    assert headcounts.registered_persons_by_uf(reg).where(F.col("UF") == "SP").count() == 1
