"""Benefit situation of a family: payroll flag, detailed status and exclusive category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Payroll situations. A missing situation on a payroll row counts as released.
RELEASED = "LIBERADO"
ACTIVE_SITUATIONS = ("LIBERADO", "L", "NAO INFORMADO")
HELD_SITUATIONS = ("SUSPENSO", "BLOQUEADO")


def benefit_flag(on_payroll: Column, situation: Column) -> Column:
    """'TRUE' for a family on the payroll that is neither suspended nor blocked, else 'FALSE'."""
    paid = on_payroll & ~F.coalesce(situation, F.lit(RELEASED)).isin(*HELD_SITUATIONS)
    return F.when(paid, "TRUE").otherwise("FALSE")


def benefit_status(in_queue: Column, on_payroll: Column, situation: Column) -> Column:
    """Queue first, then active, suspended, blocked; NULL off the programme or for an unknown situation."""
    return (
        F.when(in_queue, "PRÉ-HABILITADO")
        .when(on_payroll & F.coalesce(situation, F.lit(RELEASED)).isin(*ACTIVE_SITUATIONS), "ATIVO")
        .when(on_payroll & situation.isin(*HELD_SITUATIONS), situation)
    )


def category(in_queue: Column, on_payroll: Column) -> Column:
    """Exclusive class: PRE (queued) before PBF (on the payroll) before CAD (registry only)."""
    return F.when(in_queue, "PRE").when(on_payroll, "PBF").otherwise("CAD")
