"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, small

#: Far beyond the logarithmic number of rounds that any graph needs.
ROUNDS = 60


def _neighbours_to_least(pairs: DataFrame, both: bool) -> DataFrame:
    """Points the greater neighbours of each node (large star), or the smaller ones and the node (small star), to the least."""
    if both:
        pairs = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        return pairs.join(small(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = materialize(pairs.groupBy("a").agg(F.min("b").alias("m")), "least")
    return pairs.join(small(least), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the least node reached) of every node of edges (a, b) but the components' least ones.

    Alternates large-star and small-star steps until the edges are stars. Every step is an
    aggregation with partial sums and a join whose small side is broadcast only if its count
    is within a bound; what is written goes to the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e = materialize(e, "edges")
    state = None
    for _ in range(ROUNDS):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
        e = materialize(_neighbours_to_least(e, True).distinct(), "edges")
        e = materialize(_neighbours_to_least(e, False).distinct(), "edges")
    raise RuntimeError("the components did not settle")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of an undirected edge table (a, b)."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def degree_census(edges: DataFrame) -> DataFrame:
    """How many nodes have one, two, or three and more edges."""
    return degrees(edges).groupBy(F.least("degree", F.lit(3)).cast("int").alias("degree")).agg(F.count("*").alias("n"))


def neighbour_smooth(edges: DataFrame, values: DataFrame, strength: float) -> DataFrame:
    """Moves each node's value towards the mean of its neighbours; nodes without one stay. values: (node, value)."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mean = both.join(values.select(F.col("node").alias("b"), "value"), "b").groupBy(F.col("a").alias("node")).agg(F.avg("value").alias("mean"))
    return values.join(mean, "node", "left").select("node", F.coalesce(F.col("value") * (1 - strength) + F.col("mean") * strength, F.col("value")).alias("value"))
