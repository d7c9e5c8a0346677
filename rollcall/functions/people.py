"""Labels and clean-up of person and contact fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the sex code.
SEX_BY_CODE = {1: "Masculino", 2: "Feminino"}
SEX_UNKNOWN = "Não informado"


def sex_label(code: Column) -> Column:
    label = F
    for value, text in SEX_BY_CODE.items():
        label = label.when(code == value, text)
    return label.otherwise(SEX_UNKNOWN)


def phone_clean(phone: Column) -> Column:
    """Drop one leading zero (a trunk prefix); NULL stays NULL."""
    return F.when(phone.startswith("0"), F.substr(phone, F.lit(2))).otherwise(phone)
