"""Joined document, person and family rows with optional further sections, one prefix per table.

Nothing is deduplicated: a tax id gives one row per document, person, family, contact and exclusion
combination found.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.joins import attach
from rollcall.operators.sizing import Measured, measure, measure_keys
from rollcall.operators.skew import join_salted
from rollcall.registry import Registry
from rollcall.session import MAX_LITERAL_KEYS

PERSON_KEY = "CO_CHV_NATURAL_PESSOA"
FAMILY_KEY = "CO_FAMILIAR_FAM"

# The columns of each section, in report order.
DOCUMENT_KEYS = ("CO_FAMILIAR_FAM", "CO_CHV_NATURAL_PESSOA", "NU_CPF_PESSOA")
DOCUMENT_ALL = DOCUMENT_KEYS + (
    "CO_CERTIDAO_CIVIL_PESSOA",
    "NO_CARTORIO_PESSOA",
    "NU_IDENTIDADE_PESSOA",
    "SG_UF_IDENT_PESSOA",
    "NU_TITULO_ELEITOR_PESSOA",
)
PERSON_ALL = (
    "CO_FAMILIAR_FAM",
    "CO_CHV_NATURAL_PESSOA",
    "DT_CADASTRAMENTO_MEMB",
    "DT_ATUAL_MEMB",
    "CO_EST_CADASTRAL_MEMB",
    "NO_PESSOA",
    "NU_NIS_PESSOA",
    "NO_APELIDO_PESSOA",
    "DT_NASC_PESSOA",
    "CO_ORIGEM_FAMILIA_PESSOA",
    "IN_ORIGEM_ALTERACAO_PESSOA",
    "CO_CHV_NAT_PES_ATUAL",
    "CO_CHV_NAT_PES_ORIGINAL",
    "NU_NIS_ORIGINAL",
    "IN_TRANSFERENCIA_PESSOA",
)
FAMILY_STATUS = (
    "CO_FAMILIAR_FAM",
    "DT_CADASTRO_FAM",
    "DT_ULT_ATUAL_FAM",
    "CO_EST_CADASTRAL_FAM",
    "IN_CADASTRO_VALIDO_FAM",
    "CO_CONDICAO_CADASTRO_FAM",
)
FAMILY_ALL = FAMILY_STATUS + (
    "CO_MODALIDADE_OPER_FAM",
    "CO_ORIGEM_FAMILIA_FAM",
    "DT_CDSTR_ATUAL_FMLA",
    "IN_FAM_ALTERADA_V7",
    "DT_ATUALIZACAO_FAM",
)
TERRITORY = ("CO_MUNIC_IBGE_2_FAM", "CO_MUNIC_IBGE_5_FAM")
EXCLUSION_ALL = ("DT_EXCLUSAO_PESSOA", "CO_MOTIVO_EXCLUSAO")
CONTACT_NAMES = {
    "NU_DDD_CONTATO_1_FAM": "CONT_DDD_1",
    "NU_TEL_CONTATO_1_FAM": "CONT_TEL_1",
    "NU_DDD_CONTATO_2_FAM": "CONT_DDD_2",
    "NU_TEL_CONTATO_2_FAM": "CONT_TEL_2",
    "IN_TIPO_EMAIL_FAM": "CONT_TIPO_EMAIL",
    "DS_EMAIL_FAM": "CONT_EMAIL",
}


def prefixed(df: DataFrame, prefix: str, columns: Iterable[str]) -> DataFrame:
    """Select columns under ``prefix``; joined tables then share no names."""
    return df.selectExpr(*[f"{c} AS {prefix}{c}" for c in columns])


def with_prefix(prefix: str, columns: Iterable[str]) -> list[str]:
    return [prefix + c for c in columns]


def contacts(contact: DataFrame) -> DataFrame:
    """Contact columns under their short names, with the family key as ``CONT_FAMILY``."""
    return contact.selectExpr(
        f"{FAMILY_KEY} AS CONT_FAMILY", *[f"{c} AS {short}" for c, short in CONTACT_NAMES.items()]
    )


def documents_of(document: DataFrame, cpfs: Sequence[str] | DataFrame | None) -> Measured:
    """Documents with the given tax ids (text form), measured; ``None`` takes every document.

    A Python list of up to ``MAX_LITERAL_KEYS`` is pushed into the scan; a longer one becomes a frame. A frame of tax ids (first column) becomes a semi-join, whose
    keys are broadcast only when they were counted and are few.
    """
    if cpfs is None:
        return Measured(document, None)
    if not isinstance(cpfs, DataFrame) and len(cpfs) > MAX_LITERAL_KEYS:
        cpfs = document.sparkSession.createDataFrame([(c,) for c in cpfs], "NU_CPF_PESSOA string")
    if isinstance(cpfs, DataFrame):
        keys = measure_keys(cpfs.select(F.col(cpfs.columns[0]).alias("NU_CPF_PESSOA")))
        hits = document.join(keys.hinted(), "NU_CPF_PESSOA", "left_semi")
        if not keys.small:
            return Measured(hits, None)
    else:
        wanted = sorted(set(cpfs))
        hits = document.where(F.col("NU_CPF_PESSOA").isin(*wanted)) if wanted else document.where(F.lit(False))
    return measure(hits, keep=True)


def dossier_rows(
    reg: Registry,
    cpfs: Sequence[str] | DataFrame | None,
    exclusions: bool = False,
    contact: bool = False,
    benefits: DataFrame | None = None,
) -> DataFrame:
    """Document, person and family columns (DOC_/PES_/FAM_), plus the sections asked for.

    The lookup starts from the few documents that match; person, family and the other tables are cut down
    to those keys on the map side, so none of them is shuffled whole.
    """
    hits = documents_of(reg.document, cpfs)
    docs = prefixed(hits.frame, "DOC_", DOCUMENT_ALL)
    people = hits.narrow(reg.person, PERSON_KEY)
    rows = docs.join(
        prefixed(people, "PES_", PERSON_ALL),
        F.col("DOC_" + PERSON_KEY) == F.col("PES_" + PERSON_KEY),
    )
    found = measure(rows, keep=True) if hits.small else Measured(rows, None)

    families = found.narrow(reg.family, FAMILY_KEY, "PES_" + FAMILY_KEY)
    household = prefixed(families, "FAM_", FAMILY_ALL + TERRITORY)
    if benefits is not None:
        on_family = F.col("FAM_" + FAMILY_KEY) == F.col("CO_FAMILIAR")
        narrowed = found.narrow(benefits, "CO_FAMILIAR", "PES_" + FAMILY_KEY)
        household = household.join(narrowed, on_family, "left").drop("CO_FAMILIAR")
    household = household.withColumn("PES_" + FAMILY_KEY, F.col("FAM_" + FAMILY_KEY))
    on = "PES_" + FAMILY_KEY
    if found.small:
        out = found.frame.join(household, on)
    else:
        vary = ("DOC_" + PERSON_KEY, "DOC_NU_CPF_PESSOA")
        out = join_salted(found.frame, household, on, counted=reg.person.select(F.col(FAMILY_KEY).alias(on)), vary=vary)
    if contact:
        phones = found.narrow(contacts(reg.contact), "CONT_FAMILY", "PES_" + FAMILY_KEY)
        out = attach(out, phones, "FAM_" + FAMILY_KEY, "CONT_FAMILY")
    if exclusions:
        removed = found.narrow(reg.exclusion, PERSON_KEY, "PES_" + PERSON_KEY)
        removed = prefixed(removed, "EXC_", (PERSON_KEY,) + EXCLUSION_ALL)
        out = attach(out, removed, "PES_" + PERSON_KEY, "EXC_" + PERSON_KEY)
    return out


def yes_no(flag: Column) -> Column:
    return F.when(flag, "SIM").otherwise("NAO")
