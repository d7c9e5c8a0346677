"""Who counts as registered: status policies on the person and family tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.skew import join_salted

# Registration states.
REGISTERED = 3
NOT_REGISTERED = (1, 2, 4)
VALID = 1
INVALID = 2
CONDITION_OUT = 6


@dataclass(frozen=True)
class Policy:
    """A status rule, split by table so that each half filters its own scan before the join."""

    family: Column | None
    person: Column | None


def _not_out(code: Column) -> Column:
    # NULL is dropped, as NOT IN drops it.
    return ~code.isin(*NOT_REGISTERED)


def policy(name: str) -> Policy:
    """Named status policies.

    ``strict``            family state outside 1/2/4 and person state 3
    ``registered_valid``  family state 3 and valid, person state not tested
    ``both3``             family state 3 and person state 3
    ``eligible``          ``strict``, and family neither invalid nor in condition 6
    ``all``               no test
    """
    family_state = F.col("CO_EST_CADASTRAL_FAM")
    person_3 = F.col("CO_EST_CADASTRAL_MEMB") == REGISTERED
    valid = F.col("IN_CADASTRO_VALIDO_FAM")
    policies = {
        "strict": Policy(_not_out(family_state), person_3),
        "registered_valid": Policy((family_state == REGISTERED) & (valid == VALID), None),
        "both3": Policy(family_state == REGISTERED, person_3),
        "eligible": Policy(
            _not_out(family_state)
            & (valid != INVALID)
            & (F.col("CO_CONDICAO_CADASTRO_FAM") != CONDITION_OUT),
            person_3,
        ),
        "all": Policy(None, None),
    }
    if name not in policies:
        raise ValueError(f"unknown status policy {name!r}; one of {', '.join(policies)}")
    return policies[name]


def families_of(family: DataFrame, rule: str) -> DataFrame:
    test = policy(rule).family
    return family if test is None else family.where(test)


def persons_of(person: DataFrame, rule: str) -> DataFrame:
    test = policy(rule).person
    return person if test is None else person.where(test)


def active_universe(
    person: DataFrame,
    family: DataFrame,
    rule: str = "strict",
    person_columns: Sequence[str] = ("CO_CHV_NATURAL_PESSOA",),
    family_columns: Sequence[str] = ("CO_MUNIC_IBGE_2_FAM",),
    derived: bool = False,
) -> DataFrame:
    """Persons joined to their family under a status policy; one row per (person, family) row pair.

    Adaptive execution splits a family with very many persons when ``family`` is a stored table. For a
    ``derived`` one (joined or aggregated by family) the join deals such a family over many tasks itself.
    """
    key = "CO_FAMILIAR_FAM"
    left = persons_of(person, rule).select(key, *person_columns)
    right = families_of(family, rule).select(key, *family_columns)
    return join_salted(left, right, key) if derived else left.join(right, key)
