"""Embedding near-dedup by p-stable hashing for Euclidean distance.

Vectors are normalised; each table quantises ``K`` Gaussian projections with random offsets, and the ``K`` numbers
together are a bucket. Vectors of a bucket are compared exactly, by cosine in double precision. A pair that meets in
several tables counts in the first one only, so link counts need no pair list; what a bucket emits is one count per
member and a spanning forest of its links. Equal vectors are one node with a weight, so a vector that fills a third
of the table is compared once.

Defined cases: vectors that are null, zero, or hold null or non-finite components (or have another length than most:
only equal lengths are compared) link with nothing; null identifiers are kept and named by themselves; repeated rows
link with each other; an empty table gives an empty result; labels and other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.buckets import block_pairs
from rollcall.llm.components import components
from rollcall.llm.storage import numbered, settle
from rollcall.llm.streams import sorted_groups, tidy

COSINE = 0.9
# Chance for a pair of cosine 0.9 to meet: 1 - (1 - 0.82^8)^24, over 99 %; unrelated pairs meet in a bucket at 0.3 %.
TABLES = 24
PROJECTIONS = 8
WIDTH = 2.0
SEED = 7
BLOCK = 4096


def usable(vector: str):
    """Whether a vector takes part."""
    x = F.col(vector)
    plain = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & plain & F.exists(x, lambda v: v != 0), F.lit(False))


def hash_codes(vectors: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """One 32-bit bucket number per vector and table. Different cells may share a number: they are compared together."""
    rng = np.random.default_rng([SEED, vectors.shape[1]])
    axes = rng.standard_normal((vectors.shape[1], tables * projections))
    offsets = rng.uniform(0, width, tables * projections)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    cells = np.floor((unit @ axes + offsets) / width).astype(np.int64).reshape(len(vectors), tables, projections)
    odd = rng.integers(1, 1 << 62, projections, dtype=np.int64) | 1
    return ((cells * odd).sum(2) >> 32).astype(np.int32)


def _with_codes(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            lists = batch.column("vector").to_pylist()
            codes: list = [None] * len(lists)
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(lists):
                by_length.setdefault(len(v), []).append(i)
            for at in by_length.values():
                for i, row in zip(at, hash_codes(_scaled(np.array([lists[i] for i in at], float))).tolist(), strict=True):
                    codes[i] = row
            columns = [*batch.columns, pa.array(codes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "codes"])

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.mapInArrow(tidy(run), f"node long, n long, vector {kind}, codes array<int>")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: cosines stay, squares cannot overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def bucket_links(batch: pa.RecordBatch, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For one group: how many vectors each member newly links with, and a spanning forest (positions, two rows)."""
    flat = batch.column("vector").flatten().to_numpy().astype(np.float64)
    n = batch.num_rows
    x = _scaled(flat.reshape(n, -1))
    norm = np.sqrt((x * x).sum(1))
    earlier = batch.column("earlier").flatten().to_numpy().reshape(n, batch.column("t")[0].as_py())
    weight, own = batch.column("n").to_numpy(), batch.column("_own").to_numpy()
    cross = batch.column("_lo")[0].as_py() != batch.column("_hi")[0].as_py()
    counts, parent = np.zeros(n, np.int64), np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step, forest = 256, []
    for at in range(0, n, step):
        near = (x[at : at + step] @ x.T) / (norm[at : at + step, None] * norm) >= cosine
        if cross:
            near &= own[at : at + step, None] != own
        i, j = np.nonzero(near)
        i += at
        new = (i != j) & ~(earlier[i] == earlier[j]).any(1)
        i, j = i[new], j[new]
        np.add.at(counts, i, weight[j])
        for a, b in zip(i[i < j].tolist(), j[i < j].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                forest.append((a, b))
    return counts, np.array(forest, np.int64).reshape(-1, 2).T


def links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``nodes`` (node, n, vector, codes), stored. Rows (a, null, count) add to a node's links; (a, b, null) connect."""
    rows = nodes.select("*", F.posexplode("codes").alias("t", "code"), F.size("vector").alias("dim"))
    # A row carries its numbers in the tables before its own, which tell whether a pair was met already.
    rows = rows.withColumn("earlier", F.slice("codes", F.lit(1), F.col("t"))).drop("codes")
    keys = ["dim", "t", "code"]
    groups = [*keys, "_lo", "_hi"]
    met = block_pairs(rows, keys, "node", BLOCK)

    def run(batches):
        for group in sorted_groups(batches, groups):
            counts, (a, b) = bucket_links(group, cosine)
            node, some = group.column("node").to_numpy(), np.flatnonzero(counts)
            if len(some):
                ends = pa.array([*[None] * len(some), *node[b].tolist()], pa.int64())
                added = pa.array([*counts[some].tolist(), *[None] * len(a)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node[some], node[a]))), ends, added], names=["a", "b", "added"])

    return met.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(tidy(run), "a long, b long, added long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept. ``df`` should be a stored table."""
    # Single-precision components travel as such, at half the bytes; cosines are taken in double precision.
    kind = "float" if df.select(vector).schema[0].dataType.simpleString() == "array<float>" else "double"
    rows = numbered(df.select(F.col(id_col).alias("id"), F.col(vector).cast(f"array<{kind}>").alias("vector")))
    rows = settle(rows.select("_row", "id", F.when(usable("vector"), F.col("vector")).alias("vector")))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("_row").alias("row"))).alias("best")
    # -0.0 and 0.0 are one value; the vector itself is the key, so equal hashes cannot mix vectors up.
    plain = F.transform("vector", lambda v: v + F.lit(0.0).cast(kind))
    distinct = rows.where("vector is not null").select(plain.alias("vector"), "id", "_row").groupBy("vector").agg(F.count("*").alias("n"), best)
    distinct = settle(distinct.select(F.col("best.row").alias("node"), "n", "vector", "best"))
    coded = settle(_with_codes(distinct.select("node", "n", "vector")))
    found = settle(links(coded, cosine))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("added").alias("added"))
    roots = components(found.where("b is not null").select("a", "b"))
    known = distinct.select("node", "n", "best", "vector").join(counts, "node", "left").join(roots, "node", "left")
    known = settle(known.select("node", "n", "best", "vector", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("root", "node").alias("root")))
    whole = known.groupBy("root").agg(F.min("best").alias("first"))
    named = known.join(whole, "root").select(F.col("vector").alias("key"), (F.col("added") + F.col("n") - 1).alias("links"), F.col("first.id").alias("component"), F.col("first.row").alias("first_row"))
    out = rows.withColumn("key", plain).join(settle(named), "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
        F.when(F.col("links").isNull(), F.lit(True)).otherwise(F.col("first_row") == F.col("_row")).alias("kept"),
    )
