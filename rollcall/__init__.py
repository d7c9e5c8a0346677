"""Social-registry analytics on Spark: headcounts, dossiers, extractions, reconciliation and sampling."""

from rollcall.params import Month, Period
from rollcall.registry import Registry

__all__ = ["Month", "Period", "Registry"]
