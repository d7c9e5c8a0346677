"""The catalogue entry type and the complete list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from rollcall.catalog.star_views import StarTables
from rollcall.params import Period, Territory
from rollcall.registry import Registry
from rollcall.session import settle
from rollcall.sources import people_list
from rollcall.sources.parameters import parameter_rows

# The month and day every catalogue query is run for.
PERIOD = Period(200006, as_of=date(2000, 6, 30))
NEXT_QUEUE = Period(200006, queue_offset=1, as_of=date(2000, 6, 30))


@dataclass(frozen=True)
class Star:
    """The registry derived from one directory of star-schema tables."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def tables(self) -> StarTables:
        return StarTables(self.spark, self.sf_dir)

    @cached_property
    def reg(self) -> Registry:
        return Registry(self.tables.view)

    @cached_property
    def raw_list(self) -> DataFrame:
        return self.tables.view("VT_LISTA_CPF")

    @cached_property
    def parameters(self) -> DataFrame:
        return settle(parameter_rows(self.spark, {"country": (PERIOD, None), "state": (PERIOD, Territory(35))}))

    @cached_property
    def people(self) -> DataFrame:
        return people_list(self.raw_list)


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[Star], DataFrame]
    sql: str


def all_entries() -> list[Entry]:
    from rollcall.catalog import domain, jobs, relational, scalars

    return [*jobs.ENTRIES, *domain.ENTRIES, *relational.ENTRIES, *scalars.ENTRIES]
