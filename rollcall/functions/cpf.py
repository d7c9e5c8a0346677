"""Tax-id (CPF) cleaning and formatting.

The number form is ``decimal(20,0)``: it holds any 20-digit text, drops leading zeros, and compares
equal whatever the padding. The text form is only for output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mask characters removed from a caller's CPF text.
MASK_CHARACTERS = " .-/"

CPF_NUMBER = "decimal(20,0)"
CPF_DIGITS = 11


def strip_mask(text: Column) -> Column:
    """Remove blanks, dots, dashes and slashes."""
    return F.translate(text, MASK_CHARACTERS, "")


def parse_cpf(text: Column) -> Column:
    """Digits to ``decimal(20,0)``; anything else, or more than 20 digits, gives NULL instead of an error."""
    digits = F.trim(text)
    return F.when(digits.rlike("^[0-9]+$"), digits.try_cast(CPF_NUMBER))


def clean_cpf(text: Column) -> Column:
    """Mask stripped, empty or non-numeric text to NULL, number otherwise."""
    return parse_cpf(strip_mask(text))


def cpf_problem(text: Column) -> Column:
    """Why ``clean_cpf`` gives no number: EMPTY, NOT DIGITS or TOO LONG; NULL where it gives one."""
    plain = F.trim(strip_mask(text))
    return (
        F.when(F.coalesce(plain, F.lit("")) == "", "EMPTY")
        .when(~plain.rlike("^[0-9]+$"), "NOT DIGITS")
        .when(plain.try_cast(CPF_NUMBER).isNull(), "TOO LONG")
    )


def format_cpf(number: Column) -> Column:
    """Zero-padded text of 11 digits; longer numbers are cut to their first 11, as padding does."""
    return F.lpad(number.cast("string"), CPF_DIGITS, "0")
