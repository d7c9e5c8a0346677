"""Lookups by tax id: everything the registry holds on a person, without deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import codibge, uf_sigla
from rollcall.functions.territory import UNKNOWN_IN_REPORTS
from rollcall.operators import dossier as d
from rollcall.operators.keysets import family_benefits, has_flag
from rollcall.params import Period
from rollcall.registry import Registry

Cpfs = Sequence[str] | DataFrame | None

# Columns of the many-ids report, taken from the prefixed section columns.
BATCH_COLUMNS = {
    "NU_CPF_PESSOA": "DOC_NU_CPF_PESSOA",
    "NO_PESSOA": "PES_NO_PESSOA",
    "NU_NIS_PESSOA": "PES_NU_NIS_PESSOA",
    "CO_FAMILIAR_FAM": "FAM_CO_FAMILIAR_FAM",
    "DOC_CHAVE_PESSOA": "DOC_CO_CHV_NATURAL_PESSOA",
    "DT_CADASTRAMENTO_MEMB": "PES_DT_CADASTRAMENTO_MEMB",
    "DT_ATUAL_MEMB": "PES_DT_ATUAL_MEMB",
    "DT_NASC_PESSOA": "PES_DT_NASC_PESSOA",
    "CO_EST_CADASTRAL_MEMB": "PES_CO_EST_CADASTRAL_MEMB",
    "CO_ORIGEM_FAMILIA_PESSOA": "PES_CO_ORIGEM_FAMILIA_PESSOA",
    "IN_ORIGEM_ALTERACAO_PESSOA": "PES_IN_ORIGEM_ALTERACAO_PESSOA",
    "IN_TRANSFERENCIA_PESSOA": "PES_IN_TRANSFERENCIA_PESSOA",
    "CO_CHV_NAT_PES_ATUAL": "PES_CO_CHV_NAT_PES_ATUAL",
    "CO_CHV_NAT_PES_ORIGINAL": "PES_CO_CHV_NAT_PES_ORIGINAL",
    "NU_NIS_ORIGINAL": "PES_NU_NIS_ORIGINAL",
    "DT_CADASTRO_FAM": "FAM_DT_CADASTRO_FAM",
    "DT_ULT_ATUAL_FAM": "FAM_DT_ULT_ATUAL_FAM",
    "DT_ATUALIZACAO_FAM": "FAM_DT_ATUALIZACAO_FAM",
    "DT_CDSTR_ATUAL_FMLA": "FAM_DT_CDSTR_ATUAL_FMLA",
    "CO_EST_CADASTRAL_FAM": "FAM_CO_EST_CADASTRAL_FAM",
    "IN_CADASTRO_VALIDO_FAM": "FAM_IN_CADASTRO_VALIDO_FAM",
    "CO_CONDICAO_CADASTRO_FAM": "FAM_CO_CONDICAO_CADASTRO_FAM",
    "CO_MODALIDADE_OPER_FAM": "FAM_CO_MODALIDADE_OPER_FAM",
    "CO_ORIGEM_FAMILIA_FAM": "FAM_CO_ORIGEM_FAMILIA_FAM",
    "IN_FAM_ALTERADA_V7": "FAM_IN_FAM_ALTERADA_V7",
}

uf_code, municipality_code = (f"FAM_{c}" for c in d.TERRITORY)


def _place() -> list:
    return [
        uf_sigla(F.col(uf_code), UNKNOWN_IN_REPORTS).alias("UF"),
        codibge(F.col(uf_code), F.col(municipality_code)).alias("CODIBGE"),
    ]


def full_dossier(reg: Registry, cpfs: Cpfs) -> DataFrame:
    """Document keys, person and family, each column prefixed with its table."""
    return d.dossier_rows(reg, cpfs).select(
        *d.with_prefix("DOC_", d.DOCUMENT_KEYS),
        *d.with_prefix("PES_", d.PERSON_ALL),
        *d.with_prefix("FAM_", d.FAMILY_ALL),
    )


def plain_dossier(reg: Registry, cpfs: Cpfs) -> DataFrame:
    """The same report without prefixes; the keys appear once, as the document has them."""
    person = [c for c in d.PERSON_ALL if c not in d.DOCUMENT_KEYS]
    family = [c for c in d.FAMILY_ALL if c not in d.DOCUMENT_KEYS]
    return d.dossier_rows(reg, cpfs).selectExpr(
        *[
            f"{prefix}{c} AS {c}"
            for prefix, columns in (("DOC_", d.DOCUMENT_KEYS), ("PES_", person), ("FAM_", family))
            for c in columns
        ]
    )


def batch_dossier(reg: Registry, cpfs: Cpfs) -> DataFrame:
    """Short report for many tax ids, sorted by tax id."""
    rows = d.dossier_rows(reg, cpfs)
    return rows.selectExpr(*[f"{c} AS {name}" for name, c in BATCH_COLUMNS.items()]).orderBy(
        "NU_CPF_PESSOA", "DOC_CHAVE_PESSOA", "CO_FAMILIAR_FAM"
    )


def exclusion_dossier(reg: Registry, cpfs: Cpfs) -> DataFrame:
    """Dossier with state, municipality code and the person's exclusions."""
    return d.dossier_rows(reg, cpfs, exclusions=True).select(
        *d.with_prefix("DOC_", d.DOCUMENT_KEYS),
        *d.with_prefix("PES_", d.PERSON_ALL),
        *d.with_prefix("FAM_", d.FAMILY_STATUS),
        *_place(),
        *d.with_prefix("EXC_", d.EXCLUSION_ALL),
    )


def benefit_dossier(reg: Registry, cpfs: Cpfs, period: Period) -> DataFrame:
    """Dossier with contacts, exclusions and whether the family is paid or queued."""
    benefits = family_benefits(reg.payroll, reg.queue, period.rf_payroll, period.rf_queue)
    rows = d.dossier_rows(reg, cpfs, exclusions=True, contact=True, benefits=benefits)
    return rows.select(
        *d.with_prefix("DOC_", d.DOCUMENT_ALL),
        *d.with_prefix("PES_", d.PERSON_ALL),
        *d.with_prefix("FAM_", d.FAMILY_ALL),
        *d.CONTACT_NAMES.values(),
        *_place(),
        *d.with_prefix("EXC_", d.EXCLUSION_ALL),
        d.yes_no(has_flag("ON_PAYROLL")).alias("FAMILIA_NA_FOLHA_BF"),
        d.yes_no(has_flag("IN_QUEUE")).alias("FAMILIA_PRE_HABILITADA"),
    ).orderBy("DOC_NU_CPF_PESSOA", "PES_CO_CHV_NATURAL_PESSOA", "FAM_CO_FAMILIAR_FAM")
