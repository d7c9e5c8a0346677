"""Schooling level from the school-attendance codes."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """One cell of the level table: courses, and the grades in them that count (None: any grade)."""

    attending: bool
    courses: tuple[int, ...]
    grades: tuple[int, ...] | None = None


NOW, PAST = True, False

# Levels from lowest to highest. The first level with a matching rule wins, so course 10
# attended now is EFI although EFC lists it too.
LEVELS: dict[str, tuple[Rule, ...]] = {
    "EFI": (
        Rule(NOW, (7,), (1, 10)),
        Rule(NOW, (10, 11)),
        Rule(PAST, (5,), (8, 10)),
        Rule(PAST, (6,), (9, 10)),
        Rule(PAST, (7,), (8, 10)),
        Rule(PAST, (11,)),
    ),
    "EFC": (
        Rule(NOW, (4,), (2, 3, 4, 5, 6, 7, 8)),
        Rule(NOW, (5,), (3, 4, 5, 6, 7, 8, 9)),
        Rule(NOW, (10,)),
        Rule(PAST, (4,), (1, 2, 3, 4, 10)),
        Rule(PAST, (5,), (5, 6, 7)),
        Rule(PAST, (6,), (2, 3, 4, 5, 6, 7, 8)),
        Rule(PAST, (7,), (1, 2, 3, 4, 5, 6, 7)),
        Rule(PAST, (10,)),
    ),
    "EMI": (Rule(NOW, (7,), (2, 3, 4)), Rule(PAST, (8, 9), (1, 2))),
    "EMC": (Rule(NOW, (14,)), Rule(PAST, (8, 9), (3, 4, 10)), Rule(PAST, (12,))),
    "ES OU +": (Rule(NOW, (13,)), Rule(PAST, (13,))),
}
NOT_INFORMED = "Não Informado"
OTHERS = "OUTROS"


def _in(code: str, values: Iterable[int]) -> str:
    return f"{code} IN ({', '.join(map(str, values))})"


def _level(levels: Iterable[str], default: str, prefix: str) -> Column:
    def cascade(attending: bool, course: str, grade: str) -> str:
        branches = []
        for level in levels:
            tests = [
                f"({_in(prefix + course, rule.courses)}"
                + (f" AND {_in(prefix + grade, rule.grades)})" if rule.grades else ")")
                for rule in LEVELS[level]
                if rule.attending is attending
            ]
            if tests:
                branches.append(f"WHEN {' OR '.join(tests)} THEN '{level}'")
        return f"CASE {' '.join(branches)} ELSE '{default}' END"

    now = cascade(NOW, "CO_CURSO_FREQUENTA_MEMB", "CO_ANO_SERIE_FREQUENTA_MEMB")
    past = cascade(PAST, "CO_CURSO_FREQ_PESSOA_MEMB", "CO_ANO_SERIE_FREQUENTOU_MEMB")
    # Literacy and attendance are tested once, not once per rule.
    return F.expr(
        f"""CASE WHEN {prefix}CO_SABE_LER_ESCREVER_MEMB = 1 THEN
              CASE WHEN {_in(prefix + "IN_FREQUENTA_ESCOLA_MEMB", (1, 2))} THEN {now}
                   WHEN {prefix}IN_FREQUENTA_ESCOLA_MEMB = 3 THEN {past}
                   ELSE '{default}' END
            ELSE '{default}' END"""
    )


def schooling_level(prefix: str = "") -> Column:
    """EFI, EFC, EMI, EMC, ES OU + or 'Não Informado', from the schooling columns named with ``prefix``."""
    return _level(LEVELS, NOT_INFORMED, prefix)


def schooling_level_short(prefix: str = "") -> Column:
    """Only the two secondary levels; everything else is OUTROS."""
    return _level(("EMI", "EMC"), OTHERS, prefix)
