"""Column functions: each takes and returns ``Column`` and stays on built-in Spark expressions."""

from rollcall.functions.benefits import benefit_flag, benefit_status, category
from rollcall.functions.calendar import (
    absolute_month,
    age_between,
    age_years,
    month_to_date,
    months_since,
    recency_filter,
    shift_month,
)
from rollcall.functions.cpf import clean_cpf, format_cpf, parse_cpf, strip_mask
from rollcall.functions.people import phone_clean, sex_label
from rollcall.functions.schooling import schooling_level, schooling_level_short
from rollcall.functions.territory import UF_BY_CODE, codibge, in_territory, uf_sigla

__all__ = [
    "UF_BY_CODE",
    "absolute_month",
    "age_between",
    "age_years",
    "benefit_flag",
    "benefit_status",
    "category",
    "clean_cpf",
    "codibge",
    "format_cpf",
    "in_territory",
    "month_to_date",
    "months_since",
    "parse_cpf",
    "phone_clean",
    "recency_filter",
    "schooling_level",
    "schooling_level_short",
    "sex_label",
    "shift_month",
    "strip_mask",
    "uf_sigla",
]
