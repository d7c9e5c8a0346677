"""Helpers for functions over a stream of Arrow batches: sorted groups, slices, and memory given back at the end."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


Batches = Iterable[pa.RecordBatch]


def tidy(run: Callable[[Batches], Iterator[pa.RecordBatch]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """``run``, after which its task hands free memory back to the system: the worker process lives on, idle or for
    other tasks, and the allocators would keep what this task needed at its peak."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
            if trim:
                trim(0)

    return whole


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 2) -> Iterator[pa.RecordBatch]:
    """Each run of rows equal in ``keys`` (never null), whole even where it crosses batches, if it has ``least`` rows."""
    open_: list[pa.RecordBatch] = []

    def key_of(batch, i):
        return tuple(batch.column(k)[i].as_py() for k in keys)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
        new[0] = bool(open_) and key_of(open_[-1], open_[-1].num_rows - 1) != key_of(batch, 0)
        starts = np.flatnonzero(new)
        if not len(starts):
            open_.append(batch)
            continue
        open_.append(batch.slice(0, starts[0]))
        if sum(b.num_rows for b in open_) >= least:
            yield _joined(open_)
        if len(starts) > 1:
            lengths = np.diff(starts)
            for at, size in zip(starts[:-1][lengths >= least].tolist(), lengths[lengths >= least].tolist(), strict=True):
                yield batch.slice(at, size)
        open_ = [batch.slice(starts[-1])]
    if open_ and sum(b.num_rows for b in open_) >= least:
        yield _joined(open_)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    parts = [p for p in parts if p.num_rows]
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def sliced(batches: Iterable[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, so that what a task makes of them stays small."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
