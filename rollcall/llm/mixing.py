"""Mixing sources to target weights by entropy balancing.

Each source has one constraint: the words taken from it. Of all document rates that meet it, the ones closest to
1 in relative entropy, with no rate above ``cap``, are ``min(cap, exp(t * size / scale))``; ``t`` solves a convex
dual. Newton steps, safeguarded by a bracket, run for all sources at once: each is one aggregation over the counts
of documents by source and size. Rates become whole copies by systematic rounding in the order of size, so a
source's words miss their target by two documents at most, however many it has.

Defined cases: a null text has size 0; null is a source of its own and comes last; sources without words have
target 0 and take nothing; null or repeated identifiers are rows like any other; an empty table gives an empty
result; other columns are carried along, one that has the name of a new one under its name and ``_input``; a very long
text is only counted. One row per source reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm import prefix
from rollcall.llm.storage import clear_of, numbered, settle, spare

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
# Rates are rounded to this many parts, so that running totals are exact.
PARTS = 1_000_000
NEWTON_STEPS = 60
ROWS_PER_RANGE = 100_000


def word_count(text: Column) -> Column:
    # Each word with the white space after it becomes one letter: no array of all words is built.
    started = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.length(F.regexp_replace(started, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict:
    """Words wanted of each source: shares by weight, none above ``cap`` times its size, the excess reshared."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > cap * sizes[s]}
        if not full:
            return out | {s: weight[s] * unit for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


DUALS = "_source long, dual double, scale double"


def _rate(cap: float) -> Column:
    """A document's rate by its size and its source's dual value."""
    return F.least(F.lit(cap), F.exp(F.least(F.lit(700.0), F.col("dual") * F.col("size") / F.col("scale"))))


def balance(cells: DataFrame, sizes: dict, wanted: dict, cap: float = CAP) -> dict:
    """The dual variable of each source. ``cells``: _source, size, n."""
    spark = cells.sparkSession
    mean = {r["_source"]: r["m"] for r in cells.where("size > 0").groupBy("_source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("m")).collect()}
    scale = {s: mean.get(s, 1.0) for s in sizes}
    low, high, t = ({s: v for s in sizes} for v in (-math.inf, math.inf, 0.0))
    open_ = {s for s in sizes if 0 < wanted[s] < cap * sizes[s] * (1 - 1e-12)}
    done = {s: (math.inf if wanted[s] > 0 else -math.inf) for s in sizes if s not in open_}
    for _ in range(NEWTON_STEPS):
        if not open_:
            break
        duals = spark.createDataFrame([(s, float(t[s]), float(scale[s])) for s in sorted(open_)], DUALS)
        rate, mass = _rate(cap), F.col("size") * F.col("n") * _rate(cap)
        x = F.col("size") / F.col("scale")
        steps = cells.join(duals, "_source").groupBy("_source").agg(F.sum(mass).alias("g"), F.sum(F.when(rate < cap, mass * x).otherwise(0.0)).alias("h"))
        for r in steps.collect():
            s, gap = r["_source"], r["g"] - wanted[r["_source"]]
            if abs(gap) <= 1e-7 * wanted[s] or (math.isfinite(low[s]) and math.isfinite(high[s]) and high[s] - low[s] < 1e-13):
                open_.discard(s)
                continue
            (high if gap > 0 else low)[s] = t[s]
            step = t[s] - gap / r["h"] if r["h"] > 0 else math.nan
            if not low[s] < step < high[s]:
                if math.isinf(low[s]) or math.isinf(high[s]):
                    step = 2 * t[s] + (1 if gap < 0 else -1)
                else:
                    step = (low[s] + high[s]) / 2
            t[s] = step
    return {s: (done.get(s, t[s]), scale[s]) for s in sizes}


def mix(df: DataFrame, source: str, size: str, id_col: str, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``df`` with ``source_size``, ``target`` and ``copies`` (0, 1 or 2 with the usual cap). ``df`` is read several
    times, so pass a stored table. Spark joins the sources' values as a relation, however many there are."""
    df = clear_of(df, "source_size", "target", "copies")
    spark, own = df.sparkSession, spare(df.columns, "_row")
    whole = numbered(df, own)
    # Sizes are taken in one pass; all that follows reads these few columns, and rows meet their copies by number.
    rows = settle(
        whole.select(
            F.col(source).cast("string").alias("name"),
            F.col(size).cast("long").alias("size"),
            F.col(id_col).cast("long").alias("id"),
            F.col(own).alias("row"),
        )
    )
    totals = {r[0]: r[1] or 0 for r in rows.groupBy("name").agg(F.sum("size")).collect()}
    if not totals:
        return df.select("*", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("copies"))
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    wanted = targets(totals, weights, share, cap)
    table = [(s, i, totals[s], float(wanted[s])) for i, s in enumerate(names)]
    numbers = spark.createDataFrame([r[:2] for r in table], "_name string, _source long")
    cells = rows.groupBy("name", "size").agg(F.count("*").alias("n"))
    cells = settle(cells.join(numbers, F.col("name").eqNullSafe(F.col("_name"))).select("_source", "size", "n"))
    solved = balance(cells, {i: t for _, i, t, _ in table}, {i: w for _, i, _, w in table}, cap)
    finite = [(s, i, t, w, max(-1e300, min(1e300, float(solved[i][0]))), float(solved[i][1])) for s, i, t, w in table]
    sources = spark.createDataFrame(finite, "_name string, _source long, source_size long, target double, dual double, scale double")
    valued = rows.join(sources, F.col("name").eqNullSafe(F.col("_name")))
    keyed = valued.select(
        "source_size",
        "target",
        "_source",
        "size",
        F.xxhash64("id", "size").alias("hash"),
        "id",
        "row",
        F.lit(1).alias("one"),
        F.when(F.col("size") > 0, F.round(_rate(cap) * PARTS).cast("long")).otherwise(F.lit(0).cast("long")).alias("parts"),
    ).withColumn("rest", F.col("parts") % PARTS)
    keys, count = ["_source", "size", "hash", "id", "row"], rows.count()
    ranges = min(prefix.MAX_RANGES, max(16, count // ROWS_PER_RANGE))
    bounds = prefix.boundaries_of(keyed, keys, "one", "row", count, ranges)
    run = prefix.running(keyed, keys, ["rest"], bounds)
    half = PARTS // 2
    extra = F.floor((F.col("rest_before") + F.col("rest") + half) / PARTS) - F.floor((F.col("rest_before") + half) / PARTS)
    found = run.select(F.col("row").alias(own), "source_size", "target", (F.floor(F.col("parts") / PARTS) + extra).cast("long").alias("copies"))
    return whole.join(found, own).select(*[F.col(f"`{c}`") for c in df.columns], "source_size", "target", "copies")


def take_mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed documents themselves: each as often as the mix takes it, columns as they are."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(source).alias("source"), F.col(id_col).alias("id"), word_count(F.col(text)).alias("words"))
    mixed = mix(whole, "source", "words", "id").where("copies > 0")
    return mixed.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole.*")
