"""State labels and municipality codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.params import Territory

# Official state codes and their two-letter labels.
UF_BY_CODE = {
    11: "RO", 12: "AC", 13: "AM", 14: "RR", 15: "PA", 16: "AP", 17: "TO",
    21: "MA", 22: "PI", 23: "CE", 24: "RN", 25: "PB", 26: "PE", 27: "AL", 28: "SE", 29: "BA",
    31: "MG", 32: "ES", 33: "RJ", 35: "SP",
    41: "PR", 42: "SC", 43: "RS",
    50: "MS", 51: "MT", 52: "GO", 53: "DF",
}

# Label of an unknown state, in headcounts and in person-level reports.
UNKNOWN_IN_COUNTS = "NA"
UNKNOWN_IN_REPORTS = "Não Informado"


def uf_sigla(code: Column, default: str = UNKNOWN_IN_COUNTS) -> Column:
    """Two-letter label of a state code; ``default`` for unknown codes and NULL."""
    pairs = ", ".join(f"{number}, '{label}'" for number, label in UF_BY_CODE.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), code.cast("int")), F.lit(default))


def codibge(uf: Column, municipality: Column) -> Column:
    """Seven-digit municipality code: state on two digits, municipality on five, both zero-padded."""
    return F.concat(F.lpad(uf.cast("string"), 2, "0"), F.lpad(municipality.cast("string"), 5, "0"))


def in_territory(territory: Territory, uf: Column, municipality: Column) -> Column:
    """Territory test on the plain code columns, so that it is pushed into the scan.

    It selects the same rows as comparing ``codibge(uf, municipality)`` with the 7-digit code.
    """
    test = uf == F.lit(territory.uf)
    if territory.municipality is not None:
        test = test & (municipality == F.lit(territory.municipality))
    return test
