"""Exact running totals over a global order, by range partitions whose boundaries come from a weighted sample.

No task holds more than one range. Boundaries are quantiles of a bounded sample drawn with a chance proportional
to weight; ranges that still hold too much (a frequent key, a sample that missed) are sampled again and subdivided,
until none is overfull or ``FRUITLESS`` samples in a row bring no new boundary, which leaves ranges heavy by a single
row. Only boundaries and one total per range reach the driver, a few times ``MAX_RANGES`` numbers at most. Key columns
are longs; nulls sort first. The last key should tell all rows apart, or rows equal in all keys stay in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Most ranges made at first, and sample rows drawn per range.
MAX_RANGES = 65_536
PER_RANGE = 8
FRUITLESS = 2
# Ranges of so few rows are left whole whatever they weigh.
FEW_ROWS = 64
LOWEST = -(2**63)


def with_range(df: DataFrame, keys: list[str], boundaries: list[tuple]) -> DataFrame:
    """Adds ``_range``, the number of boundaries at or below the row: a binary search over literal arrays."""
    n = len(boundaries)
    if not n:
        return df.withColumn("_range", F.lit(0))
    # One string each, which Spark folds into an array; thousands of single literals would burden every plan.
    arrays = [F.split(F.lit(",".join(str(b[i]) for b in boundaries)), ",").cast("array<bigint>") for i in range(len(keys))]
    values = [F.coalesce(F.col(k), F.lit(LOWEST)) for k in keys]
    steps = F.array(*[F.lit(1 << power) for power in reversed(range(n.bit_length()))])

    def further(at: Column, step: Column) -> Column:
        probe = at + step
        below = F.lit(True)
        for array, value in reversed(list(zip(arrays, values, strict=True))):
            bound = F.element_at(array, F.least(probe, F.lit(n)))
            below = (bound < value) | ((bound == value) & below)
        return F.when((probe <= n) & below, probe).otherwise(at)

    return df.withColumn("_range", F.aggregate(steps, F.lit(0), further))


def boundaries_of(df: DataFrame, keys: list[str], weight: str, id_col: str, total: int, ranges: int, coarse: int | None = None) -> list[tuple]:
    """Sorted boundaries of about ``ranges`` ranges. The first cuts look at the first ``coarse`` keys only, so rows
    equal in those stay together unless their range is overfull (more than twice its share)."""
    width, limit = coarse or len(keys), 2 * total / ranges

    def draw(rows: DataFrame, mass: int, count: int, seed: int) -> list[tuple]:
        chance = F.col(weight) * F.lit(count * PER_RANGE / mass)
        u = F.xxhash64(F.col(id_col), *keys, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
        found = rows.where(u < chance).select(*keys).collect()
        return sorted(tuple(LOWEST if v is None else v for v in r) for r in found)

    first = draw(df, total, ranges, 0)[PER_RANGE // 2 :: PER_RANGE]
    bounds = sorted({s[:width] + (LOWEST,) * (len(keys) - width) for s in first})
    seed = fruitless = 0
    while fruitless < FRUITLESS:
        seed += 1
        ranged = with_range(df, keys, bounds)
        totals = ranged.groupBy("_range").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
        over = totals.where((F.col("w") > limit) & (F.col("n") > FEW_ROWS)).collect()
        if not over:
            break
        mass = sum(r["w"] for r in over)
        more = draw(ranged.where(F.col("_range").isin([r["_range"] for r in over])), mass, int(2 * mass / limit) + 1, seed)
        finer = sorted({*bounds, *(more[PER_RANGE // 2 :: PER_RANGE])})
        fruitless = fruitless + 1 if finer == bounds else 0
        bounds = finer
    return bounds


def running(df: DataFrame, keys: list[str], sums: list[str], bounds: list[tuple]) -> DataFrame:
    """Adds ``_range``, ``_n`` (row number in the whole order, from 0) and ``<sum>_before`` (total of all earlier rows)."""
    ranged = with_range(df, keys, bounds)
    per = ranged.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(s).alias(s) for s in sums]).collect()
    starts, run = [], [0] * (1 + len(sums))
    for r in sorted(per, key=lambda r: r["_range"]):
        starts.append((r["_range"], *run))
        run = [a + b for a, b in zip(run, [r["_rows"], *[r[s] for s in sums]], strict=True)]
    table = df.sparkSession.createDataFrame(starts, "_range int, _n0 long" + "".join(f", {s}_0 long" for s in sums))
    order = Window.partitionBy("_range").orderBy(*keys)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {"_n": F.row_number().over(order).cast("long") - 1}
    columns |= {f"{s}_before": F.sum(s).over(so_far) - F.col(s) for s in sums}
    out = ranged.withColumns(columns).join(F.broadcast(table), "_range")
    moved = {"_n": F.col("_n") + F.col("_n0")} | {f"{s}_before": F.col(f"{s}_before") + F.col(f"{s}_0") for s in sums}
    return out.withColumns(moved).drop("_n0", *[f"{s}_0" for s in sums])
