"""Readers and writers: monthly snapshots, monthly benefit views, caller lists, job parameters, reports."""

from rollcall.sources.parameters import count_for, parameter_rows
from rollcall.sources.people_list import people_list, read_people_list, rejected
from rollcall.sources.reports import write_report
from rollcall.sources.snapshots import Snapshot, SnapshotStore, write_bucketed, write_monthly_view, write_snapshot_table

__all__ = [
    "Snapshot",
    "SnapshotStore",
    "count_for",
    "parameter_rows",
    "people_list",
    "read_people_list",
    "rejected",
    "write_bucketed",
    "write_monthly_view",
    "write_report",
    "write_snapshot_table",
]
