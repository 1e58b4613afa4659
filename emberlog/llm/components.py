"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; long); root is the component's least node.

    Every round hangs a node's neighbours on its least neighbour; in the end each node hangs on its
    root. A round takes minima by partial aggregation, writes them to the shared folder and joins them back; the
    adaptive skew join can split the links of a hub, as both sides are shuffled for the join alone. Links stay distributed; only
    two numbers a round reach the driver.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = stored(edges, "links")
    state = _sum(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).withColumnsRenamed({"hi": "node", "lo": "other"})
        least = stored(both.groupBy("node").agg(F.min("other").alias("least")).select(F.col("node").alias("k"), F.least("node", "least").alias("least")), "least")
        far = both.where("other > node").join(least, F.col("node") == F.col("k")).select(F.col("other").alias("hi"), F.col("least").alias("lo"))
        large = stored(far.where("hi <> lo").distinct(), "links")
        below = stored(large.groupBy("hi").agg(F.min("lo").alias("least")).withColumnRenamed("hi", "k"), "least")
        near = large.join(below, F.col("hi") == F.col("k"))
        small = near.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).unionByName(below.select(F.col("k").alias("hi"), F.col("least").alias("lo")))
        edges = stored(small.where("hi <> lo").distinct(), "links")
        now = _sum(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _sum(edges: DataFrame) -> tuple:
    """A fingerprint of the link set: rows, and a wrapping sum of hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.col("lo").cast("decimal(38,0)"))).first())
