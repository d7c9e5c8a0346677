"""The set of tables one job reads: a month of the registry plus the two monthly benefit views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from rollcall.schemas import TABLES, conform


@dataclass(frozen=True)
class Registry:
    """One monthly snapshot. ``payroll`` and ``queue`` keep all their months; jobs pick the month.

    ``open_table`` gives a frame for a table name of the source system. Tables are opened, and their columns
    checked, when a job first uses them.
    """

    open_table: Callable[[str], DataFrame]

    def _table(self, name: str) -> DataFrame:
        return conform(self.open_table(name), TABLES[name], name)

    @cached_property
    def family(self) -> DataFrame:
        return self._table("TB_FAMILIA_01")

    @cached_property
    def person(self) -> DataFrame:
        return self._table("TB_PESSOA_04")

    @cached_property
    def document(self) -> DataFrame:
        return self._table("TB_DOCUMENTO_05")

    @cached_property
    def schooling(self) -> DataFrame:
        return self._table("TB_ESCOLARIDADE_07")

    @cached_property
    def contact(self) -> DataFrame:
        return self._table("TB_CONTATO_09")

    @cached_property
    def exclusion(self) -> DataFrame:
        return self._table("TB_PESSOA_EXCLUIDA_19")

    @cached_property
    def payroll(self) -> DataFrame:
        return self._table("VW_FOLHA_PAGAMENTO")

    @cached_property
    def queue(self) -> DataFrame:
        return self._table("VW_PRE_HABILITACAO_PBF")
