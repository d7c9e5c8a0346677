"""SimHash near-dedup with bit-sliced comparison.

Distinct fingerprints are keyed by combinations of bit blocks: with ``m`` blocks, two fingerprints within the radius
agree on at least ``m - radius`` of them, so each choice of that many blocks is a table, and no link is missed. The
members of a bucket are held as 64 vertical bit planes; fingerprints are compared with all of them at once by adding
the planes' differing bits in carry-save counters, and a comparison ends once every counter exceeds the radius. A
search visits each member once, so a bucket emits fewer links than it has members.

Defined cases: a null or blank text has fingerprint zero and links like any other; null or repeated identifiers are
rows like any other, and a component's identifier is its smallest one (null only if it has none); an empty table
gives an empty result; only the identifier and text columns are looked at, others are carried along whatever their
names; a very long text is hashed in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.buckets import block_pairs
from rollcall.llm.components import components
from rollcall.llm.storage import numbered, settle, spare
from rollcall.llm.streams import sorted_groups, tidy

SHINGLE = 4
RADIUS = 4
SEED = 42
# Shingles counted at once; longer texts are counted in parts.
CHUNK = 1 << 15
# Fingerprints in a bucket that one task compares at once.
BLOCK = 8192
# Words of 64 members compared with rows at once.
CELLS = 4096
# Fingerprints an average bucket may have before more blocks are used.
BUCKET = 64


def shingle_hashes(text: str | None, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of all shingles, repeats included, in parts; nothing for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(width, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in more than half of the shingles' hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fp", width: int = SHINGLE) -> DataFrame:
    """``df`` without ``text``, plus the fingerprint as a signed long."""
    kept = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)

    def run(batches):
        for batch in batches:
            found = pa.array([_signed(fingerprint(x.as_py(), width)) for x in batch.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, found], names=[*kept, name])

    return df.mapInArrow(tidy(run), f"{schema}, `{name}` long")


def tables(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Bit ranges (from, to) of each table's key, for ``n`` fingerprints."""
    for m in range(radius + 1, max(1, 2 * radius) + 1):
        if n / 2 ** (64 * (m - radius) / m) <= BUCKET:
            break
    cuts = [64 * i // m for i in range(m + 1)]
    chosen = list(combinations(range(m), m - radius))
    assert len(chosen) == comb(m, radius)
    return [[(cuts[i], cuts[i + 1]) for i in c] for c in chosen]


def _key(fp, ranges):
    mask = 0
    for a, b in ranges:
        mask |= (1 << b) - (1 << a)
    return fp.bitwiseAND(F.lit(_signed(mask)))


def near_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (positions) that connect exactly what pairs within the radius connect: a spanning forest.

    ``fps``: one row of 64-bit words per fingerprint, or one word each.
    """
    rows = np.ascontiguousarray(fps, np.uint64).reshape(len(fps), -1)
    near = {}
    for at, hits in _within(rows, radius):
        for i in np.flatnonzero(hits.any(axis=1)).tolist():
            near[at + i] = int.from_bytes(hits[i].tobytes(), "little")
    waiting, links = (1 << len(rows)) - 1, []
    for first in near:
        todo = [first] if waiting >> first & 1 else []
        waiting &= ~(1 << first)
        while todo:
            i = todo.pop()
            hits = near[i] & waiting
            waiting ^= hits
            while hits:
                low = hits & -hits
                j = low.bit_length() - 1
                links.append((i, j))
                todo.append(j)
                hits ^= low
    return links


def _add(a, b, c):
    """Carry-save addition of three planes: sum and carry."""
    half = a ^ b
    return half ^ c, a & b | half & c


def _within(rows: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For some rows at a time, from a position on: the other rows within the radius, as a bit set for each.

    The rows' bits are planes, one bit set over all rows for each bit. The planes' differences from a row are added
    eight at a time in carry-save counters of 1, 2, 4 and so on; a sum that outgrows its counters is remembered by
    ``over``, and the rows at hand are done once all others exceed the radius.
    """
    n, width = len(rows), -(-len(rows) // 64)
    bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")
    padded = np.zeros((64 * width, bits.shape[1]), np.uint8)
    padded[:n] = bits
    planes = np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view(np.uint64)
    flips = (-bits.astype(np.int64)).view(np.uint64)
    step = max(1, CELLS // width)
    for at in range(0, n, step):
        flip = flips[at : at + step, :, None]
        mine = np.arange(at, at + len(flip))
        counters = [np.zeros((len(flip), width), np.uint64) for _ in range(max(3, radius.bit_length()))]
        over = np.zeros((len(flip), width), np.uint64)
        over[:, n // 64 :] = ~np.uint64(0) << np.uint64(n % 64) if n % 64 else 0
        over[mine - at, mine // 64] |= np.uint64(1) << (mine % 64).astype(np.uint64)
        for b in range(0, len(planes), 8):
            p = [planes[b + i] ^ flip[:, b + i] for i in range(8)]
            one, two, four = counters[:3]
            one, two_a = _add(one, p[0], p[1])
            one, two_b = _add(one, p[2], p[3])
            two, four_a = _add(two, two_a, two_b)
            one, two_a = _add(one, p[4], p[5])
            one, two_b = _add(one, p[6], p[7])
            two, four_b = _add(two, two_a, two_b)
            four, carry = _add(four, four_a, four_b)
            counters[:3] = one, two, four
            for i in range(3, len(counters)):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over |= carry
            over |= _exceeds(counters, radius)
            if not np.any(~over):
                break
        yield at, ~over


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Counters greater than ``radius``."""
    out, equal = np.uint64(0), ~np.uint64(0)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            out = out | equal & counters[i]
            equal = equal & ~counters[i]
    return out


def fingerprint_links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """``fps``: one long column fp, distinct, a stored table of ``n`` rows. Links (a, b) between near fingerprints."""
    if not 0 <= radius < 32:
        raise ValueError("radius must be 0 to 31")
    keys = [F.struct(F.lit(t).alias("t"), _key(F.col("fp"), ranges).alias("key")) for t, ranges in enumerate(tables(n, radius))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    groups = ["t", "key", "_lo", "_hi"]
    met = block_pairs(rows, ["t", "key"], "fp", BLOCK).select("fp", *groups)

    def run(batches):
        for group in sorted_groups(batches, groups):
            fp = group.column("fp").to_numpy()
            links = near_links(fp.view(np.uint64), radius)
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return met.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(tidy(run), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str = "_row", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs`` (which carries ``row_col``): id, fp, component_id, first_row (of the component), row."""
    marked = settle(with_fingerprint(docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), width=width))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    fps = settle(marked.groupBy("fp").agg(best))
    found = components(fingerprint_links(fps.select("fp"), fps.count(), radius))
    # Both sides are stored, so that adaptive execution can split a root that very many fingerprints have.
    rooted = settle(fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "best"))
    whole = settle(rooted.groupBy("root").agg(F.min("best").alias("first")))
    named = settle(rooted.join(whole, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.row").alias("first_row")))
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "first_row", F.col("row").alias(row_col))


def keep_first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near copies, columns as they are. ``docs`` should be a stored table."""
    row = spare(docs.columns, "_row")
    rows = numbered(docs, row)
    found = near_groups(rows.select(F.col(row).alias("_row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", width=width, radius=radius)
    dropped = found.where("first_row <> _row").select(F.col("_row").alias(row))
    return rows.join(dropped, row, "left_anti").select(*docs.columns)
