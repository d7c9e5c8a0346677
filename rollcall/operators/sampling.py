"""Repeatable random samples, simple and stratified.

The random order is the MD5 of the tax id, then the tax id itself: any two runs pick the same rows. A seed put
before the tax id gives another draw, as repeatable as the first.
No step ranks all rows of a stratum in one task. A large sample reads its input twice and copies none of it: once the
key and stratum only, for the histogram of hash prefixes, and once to rank the rows whose prefix can be in the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.params import SamplePlan

# Up to this many ranks per stratum Spark cuts each task's rows to the ranks asked for before the shuffle
# (its own default for that optimisation). Larger samples find their cut-off from a histogram.
GROUP_LIMIT_RANKS = 1000

# Hash prefixes of this many hex digits split a stratum into at most 65,536 buckets.
BUCKET_DIGITS = 4


def hash_order(key: str, seed: int | None = None) -> Column:
    """Pseudo-random sort value of a key, spread evenly and the same on every run with the same seed."""
    text = F.col(key).cast("string")
    return F.md5(text if seed is None else F.concat(F.lit(f"{seed}:"), text))


def _histogram(df: DataFrame, stratum: str) -> DataFrame:
    """Rows per (stratum, hash bucket) with the rows of the stratum's earlier buckets as ``_before``.

    Its size is bounded by strata times buckets, whatever the number of rows counted.
    """
    counts = df.groupBy(stratum, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(stratum).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def _bucketed(df: DataFrame, key: str, seed: int | None = None) -> DataFrame:
    hashed = df.withColumn("_hash", hash_order(key, seed))
    return hashed.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))


def _ranked_by_histogram(df: DataFrame, histogram: DataFrame, limit: Column, key: str, stratum: str) -> DataFrame:
    """Rank the rows of the buckets that start below ``limit``, one bucket at a time."""
    near = F.broadcast(histogram.where(F.col("_before") < limit).select(stratum, "_bucket", "_before"))
    within = Window.partitionBy(stratum, "_bucket").orderBy("_hash", key)
    return df.join(near, [stratum, "_bucket"]).withColumn("_rn", F.col("_before") + F.row_number().over(within))


def simple_sample(df: DataFrame, n: int, key: str = "CPF", seed: int | None = None) -> DataFrame:
    """``n`` rows in hash order (all rows when there are fewer)."""
    if n <= GROUP_LIMIT_RANKS:
        return df.withColumn("_hash", hash_order(key, seed)).orderBy("_hash", key).limit(n).drop("_hash")
    rows = _bucketed(df, key, seed).withColumn("_all", F.lit(0))
    ranked = _ranked_by_histogram(rows, _histogram(rows, "_all"), F.lit(n), key, "_all")
    return ranked.where(F.col("_rn") <= n).select(*df.columns)


def take_by_relation(
    df: DataFrame, one_row: DataFrame, count: str, key: str = "CPF", seed: int | None = None
) -> DataFrame:
    """The first rows in hash order, as many as ``one_row[count]`` says (a relation of one row)."""
    rows = _bucketed(df, key, seed).withColumn("_all", F.lit(0))
    wanted = F.broadcast(one_row.select(F.col(count).alias("_wanted")))
    histogram = _histogram(rows, "_all").crossJoin(wanted)
    ranked = _ranked_by_histogram(rows, histogram, F.col("_wanted"), key, "_all").crossJoin(wanted)
    return ranked.where(F.col("_rn") <= F.col("_wanted")).select(*df.columns)


def first_per_stratum(
    df: DataFrame,
    quotas: dict[str, int],
    key: str = "CPF",
    stratum: str = "CATEGORIA",
    rank: str = "RN_CAT",
    seed: int | None = None,
) -> DataFrame:
    """Rows within their stratum's quota in hash order, with their rank; strata without quota give none."""
    quota = _quota_of(quotas, stratum)
    most = max(quotas.values())
    if most <= GROUP_LIMIT_RANKS:
        by_stratum = Window.partitionBy(stratum).orderBy("_hash", key)
        hashed = df.where(F.col(stratum).isin(*quotas)).withColumn("_hash", hash_order(key, seed))
        ranked = hashed.withColumn(rank, F.row_number().over(by_stratum)).where(F.col(rank) <= most)
    else:
        rows = _bucketed(df.where(F.col(stratum).isin(*quotas)), key, seed)
        ranked = _ranked_by_histogram(rows, _histogram(rows, stratum), quota, key, stratum).withColumn(
            rank, F.col("_rn").cast("int")
        )
    return ranked.where(F.col(rank) <= quota).select(*df.columns, rank)


def _quota_of(quotas: dict[str, int], stratum: str) -> Column:
    quota = F
    for name, size in quotas.items():
        quota = quota.when(F.col(stratum) == name, size)
    return quota.otherwise(0)


def stratified_sample(df: DataFrame, plan: SamplePlan, key: str = "CPF", stratum: str = "CATEGORIA") -> DataFrame:
    """Quota per stratum in hash order; what the strata lack is filled from the rest of ``plan.fill``.

    The rows left over in the fill stratum are those ranked after its quota, so quota and fill together
    are one rank test per row. ``key`` must be unique in ``df``. Strata the plan does not name are left out
    before anything is ranked.
    """
    quotas = plan.quotas()
    wanted = sum(quotas.values())
    quota = _quota_of(quotas, stratum)
    is_fill = F.col(stratum) == plan.fill
    df = df.where(F.col(stratum).isin(*quotas, plan.fill))

    if wanted <= GROUP_LIMIT_RANKS:
        by_stratum = Window.partitionBy(stratum).orderBy("_hash", key)
        ranked = (
            df.withColumn("_hash", hash_order(key, plan.seed))
            .withColumn("_rn", F.row_number().over(by_stratum))
            .where(F.col("_rn") <= wanted)
        )
        # At most `wanted` rows of each stratum of the plan are left here, so one task can count them.
        everything = Window.partitionBy(F.lit(0))
        picked = F.sum(F.when(F.col("_rn") <= quota, 1).otherwise(0)).over(everything)
        ranked = ranked.withColumn("_missing", F.lit(wanted) - picked)
    else:
        rows = _bucketed(df, key, plan.seed)
        histogram = _histogram(rows, stratum)
        per_stratum = histogram.groupBy(stratum).agg(F.sum("_n").alias("_n"))
        missing = per_stratum.agg(
            (F.lit(wanted) - F.coalesce(F.sum(F.least("_n", quota)), F.lit(0))).alias("_missing")
        )
        near_limit = F.when(is_fill, wanted).otherwise(quota)
        ranked = _ranked_by_histogram(rows, histogram, near_limit, key, stratum).crossJoin(F.broadcast(missing))

    allowed = quota + F.when(is_fill, F.col("_missing")).otherwise(0)
    return ranked.where(F.col("_rn") <= allowed).select(*df.columns)
