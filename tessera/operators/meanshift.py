"""Mean-shift modes and clusters: on a line by kernel sums without pairs, else every round moves the points that still travel by one range join against the data; modes closer than the merge range are one cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import density, graph, sums
from tessera.session import materialize


def shift(points: DataFrame, data: DataFrame, dims: list[str], kernel: str) -> DataFrame:
    """Each point (id, dims...) at the kernel-weighted mean of the data around it; a point without neighbours stays. All columns are scaled; data may have a weight column."""
    other = data.select(*[F.col(c).alias(f"_{c}") for c in dims], F.col("weight") if "weight" in data.columns else F.lit(1.0).alias("weight"))
    pairs = density.range_join(points, other, [(c, f"_{c}") for c in dims], kernels.RANGE[kernel])
    w = kernels.density(kernel, F.col("d")) * F.col("weight")
    pairs = pairs.withColumn("_w", w)
    means = pairs.groupBy("id").agg(F.sum("_w").alias("_t"), *[F.sum(F.col("_w") * F.col(f"_{c}")).alias(f"_s{c}") for c in dims])
    moved = points.join(means, "id", "left")
    return moved.select("id", *[F.when(F.col("_t") > 0, F.col(f"_s{c}") / F.col("_t")).otherwise(F.col(c)).alias(c) for c in dims])


def modes(points: DataFrame, data: DataFrame, dims: list[str], kernel: str = "gaussian", epsilon: float = 1e-3, rounds: int = 1000) -> DataFrame:
    """(id, dims...): where each point comes to rest; points that still move after so many rounds raise."""
    if len(dims) == 1:
        return _line_modes(points, data, dims[0], kernel, epsilon, rounds)
    rest, moving = None, materialize(points.select("id", *[F.col(c).cast("double").alias(c) for c in dims]), "points")
    for _ in range(rounds):
        old = moving.select("id", *[F.col(c).alias(f"_o{c}") for c in dims])
        step = sum(((F.col(c) - F.col(f"_o{c}")) ** 2 for c in dims[1:]), (F.col(dims[0]) - F.col(f"_o{dims[0]}")) ** 2)
        now = materialize(shift(moving, data, dims, kernel).join(old, "id").withColumn("still", step < epsilon**2), "points")
        done = now.where("still").select("id", *dims)
        rest = done if rest is None else rest.unionByName(done)
        moving = now.where("not still").select("id", *dims)
        if not moving.take(1):
            return rest
    raise RuntimeError(f"some points are not at rest after {rounds} rounds")


def _line_modes(points: DataFrame, data: DataFrame, dim: str, kernel: str, epsilon: float, rounds: int) -> DataFrame:
    """`modes` of one dimension by kernel sums: distinct values travel once, and as far as a task's block of cells reaches in one job."""
    source = materialize(sums.sources(sums.values(data, dim, F.col("weight") if "weight" in data.columns else None), kernel), "sources")
    x = F.col(dim).cast("double")
    rest, moving = None, points.where(x.isNotNull()).select(x.alias("start")).distinct().select("start", F.col("start").alias("q"), F.lit(0).cast("long").alias("steps"))
    while True:
        now = materialize(sums.walk(moving, source, kernel, epsilon, rounds), "points")
        done = now.where("still").select("start", "q")
        rest = done if rest is None else rest.unionByName(done)
        moving = now.where("not still").select("start", "q", "steps")
        if moving.where(F.col("steps") >= rounds).take(1):
            raise RuntimeError(f"some points are not at rest after {rounds} rounds")
        if not moving.take(1):
            return points.select("id", x.alias("start")).join(rest, "start").select("id", F.col("q").alias(dim))


def cluster(data: DataFrame, dims: list[str], kernel: str = "gaussian", merge_range: float = 0.5, epsilon: float = 1e-3, rounds: int = 1000) -> DataFrame:
    """(id, dims... of the mode, cluster: least id of the modes linked within the merge range). Modes are merged by grid cells first, so a cluster's points are not joined with each other."""
    at = materialize(modes(data, data, dims, kernel, epsilon, rounds), "modes")
    cells = [F.floor(F.col(c) / (merge_range / 4)).alias(f"_g{c}") for c in dims]
    names = [f"_g{c}" for c in dims]
    reps = materialize(at.withColumns(dict(zip(names, cells))).groupBy(*names).agg(F.min("id").alias("a"), *[F.avg(c).alias(c) for c in dims]), "cells")
    other = reps.select(F.col("a").alias("b"), *[F.col(c).alias(f"_r{c}") for c in dims])
    links = density.range_join(reps.select("a", *dims), other, [(c, f"_r{c}") for c in dims], merge_range).where("a < b").select("a", "b")
    of = graph.components(links)
    named = reps.join(of, reps["a"] == of["node"], "left").select(*names, F.coalesce("component", "a").alias("cluster"))
    return at.withColumns(dict(zip(names, cells))).join(named, names).select("id", *dims, "cluster")
