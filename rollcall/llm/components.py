"""Connected components of a graph held as tables.

Each round lets every node, and the node it points at, take the smallest pointer among its neighbours, then halves
the pointer paths. Every round is a few joins and one grouped minimum over narrow rows read from stored tables, so
adaptive execution can split a frequent key on either side; nothing of the graph reaches the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.storage import settle


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b longs, either direction once or more) to (node, root): root is the smallest node reachable.

    Nodes without an edge are not in the result. Null ends and loops are ignored.
    """
    plain = edges.where("a is not null and b is not null and a <> b")
    both = settle(plain.select("a", "b").unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        left = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        ends = both.join(left, "a").join(right, "b").where("ra < rb")
        said = ends.select(F.explode(F.array("b", "rb")).alias("node"), F.col("ra").alias("heard"))
        heard = said.groupBy("node").agg(F.min("heard").alias("heard"))
        hooked = settle(labels.join(heard, "node", "left").select("node", F.least("root", F.coalesce("heard", "root")).alias("root"), F.col("heard").isNotNull().alias("moved")))
        if not hooked.where("moved").limit(1).count():
            return labels
        labels = _shortened(hooked.select("node", "root"))


def _shortened(labels: DataFrame) -> DataFrame:
    up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return settle(labels.join(up, "root").select("node", F.col("above").alias("root")))
