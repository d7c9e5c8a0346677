"""Every operator and job as a query over the star-schema test tables, each with its SQL counterpart."""

from rollcall.catalog.entries import Entry, all_entries

__all__ = ["Entry", "all_entries"]
