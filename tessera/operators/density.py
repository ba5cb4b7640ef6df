"""Range joins and kernel density over scaled features.

A range join deals both sides to grid cells as wide as the radius and joins each row to the
neighbouring cells by equality, so it shuffles and spills like any equi-join. One-dimensional
densities make no pairs, see `sums`.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import sums
from tessera.session import width

#: Rounds of a fit that runs until it rests; one that needs more raises.
MOST_ROUNDS = 10_000
#: Bytes of a model that is sent to every task.
MODEL_BYTES = 32 << 20


def range_join(left: DataFrame, right: DataFrame, dims: list[tuple[str, str]], radius: float) -> DataFrame:
    """Pairs whose scaled features lie within the radius (Euclidean, < radius), with column `d`. dims: (left column, right column) pairs, already scaled."""
    cell = lambda c: F.floor(F.col(c) / radius)
    l, r = left, right
    for i, (a, b) in enumerate(dims):
        l = l.withColumn(f"_c{i}", F.explode(F.array(*[cell(a) + o for o in (-1, 0, 1)])))
        r = r.withColumn(f"_c{i}", cell(b))
    names = [f"_c{i}" for i in range(len(dims))]
    d2 = reduce(lambda x, y: x + y, [(F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in dims])
    return l.join(r, names).withColumn("d", F.sqrt(d2)).where(F.col("d") < radius).drop(*names)


def _under(queries: DataFrame, data: DataFrame, kernel: str, after: float) -> DataFrame:
    """(q, s, same): kernel sums of each distinct query (q) over distinct values (x, n); differences are scaled by `after`."""
    return sums.sums(queries, sums.sources(data, kernel, after), kernel, after)


def kde(queries: DataFrame, data: DataFrame, q: str, x: str, kernel: str, scale: float) -> DataFrame:
    """Density at each query (id, q) under data (x) with one-dimensional kernel and inverse bandwidth; queries without neighbours have 0."""
    a = queries.select("id", (F.col(q) * scale).alias("q"))
    b = sums.values(data.select((F.col(x) * scale).alias("x")), "x")  # a null is no row of the density
    n = b.agg(F.sum("n").alias("n")).where("n > 0")
    total = F.coalesce(F.col("s") + F.col("same"), F.lit(0.0))
    return a.join(_under(a, b, kernel, 1.0), "q", "left").crossJoin(F.broadcast(n)).select("id", (total * (scale / kernels.normaliser(kernel)) / F.col("n")).alias("density"))


def self_values(data: DataFrame, x: str, kernel: str, scale: float, leave_out: bool) -> DataFrame:
    """(x, n, density) of each distinct value under all rows, n its own rows; with leave_out, the row itself does not count."""
    v = sums.values(data, x)
    n = v.agg((F.sum("n") - int(leave_out)).alias("_n")).where("_n > 0")
    got = _under(v.select(F.col("x").alias("q")), v, kernel, scale).withColumnRenamed("q", "x")
    same = F.greatest(F.col("same") - sums.peak(kernel), F.lit(0.0)) if leave_out else F.col("same")
    return v.join(got, "x").crossJoin(F.broadcast(n)).select("x", "n", ((F.col("s") + same) * (scale / kernels.normaliser(kernel)) / F.col("_n")).alias("density"))


def self_density(data: DataFrame, x: str, kernel: str, scale: float, leave_out: bool) -> DataFrame:
    """Density at each row (id, x) under all rows; with leave_out, the row itself does not count."""
    rows = data.select("id", F.col(x).cast("double").alias("x"))
    return rows.join(self_values(data, x, kernel, scale, leave_out), "x").select("id", "density")


def loo_nll(data: DataFrame, x: str, kernel: str, scale: float, limit: float = 1e-16) -> DataFrame:
    """Negative log likelihood of each row under the others, densities floored, summed."""
    p = self_values(data, x, kernel, scale, True)
    return p.agg(F.sum(-F.log(F.greatest("density", F.lit(limit))) * F.col("n")).alias("nll"))


def density_entropy(data: DataFrame, x: str, kernel: str, scale: float) -> DataFrame:
    p = self_values(data, x, kernel, scale, False)
    return p.agg((-F.sum(F.log("density") * F.col("n")) / F.sum(F.when(F.col("density") > 0, F.col("n")))).alias("entropy"))


def model_row(model: DataFrame, columns: list[str]) -> DataFrame:
    """A model as one row with one array of its parts (column `_model`), for joining to every row; a model beyond MODEL_BYTES is refused."""
    n, held = model.agg(F.count("*"), F.sum(width(model.select(*columns)))).first()
    if (held or 0) > MODEL_BYTES:
        raise ValueError(f"a model of {n} parts and {held} bytes; the limit is {MODEL_BYTES}")
    return model.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_model"))


def nearest_center(rows: DataFrame, centers: DataFrame, id_col: str, vector: str, keep: list[str] | None = None) -> DataFrame:
    """Each row's nearest centre (center, v), ties to the lower one; every row gives one, repeated ones too, by a projection alone. Rows without a vector or centres give none."""
    near = F.array_min(F.transform("_model", lambda c: F.struct(kernels.squared_distance(F.col(vector), c["v"]).alias("d"), c["center"].alias("center"))))
    got = rows.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(model_row(centers, ["center", "v"]))).where(F.size("_model") > 0)
    return got.select(id_col, *(keep or []), near.alias("best")).select(id_col, *(keep or []), F.col("best.center").alias("center"), F.col("best.d").alias("d2"))


def nearest_rows(centers: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """The k nearest rows of each centre, by partial top-k before the shuffle."""
    from pyspark.sql import Window

    d = kernels.squared_distance(F.col(vector), F.col("v"))
    parts = rows.crossJoin(F.broadcast(model_row(centers, ["center", "v"]))).select(id_col, vector, F.explode("_model").alias("c")).select(id_col, vector, "c.*")
    pairs = parts.select("center", id_col, d.alias("d2"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("center").orderBy("d2", id_col))).where(F.col("rank") <= k)


def mean_vectors(rows: DataFrame, by: Column, vector: str) -> DataFrame:
    """(center, v): component means by group, summed per component so that partial sums merge."""
    parts = rows.select(by.alias("center"), F.posexplode(vector).alias("i", "x")).groupBy("center", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("center").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))


def kmeans(rows: DataFrame, k: int, id_col: str, vector: str, rounds: int | None = None, seed: int = 0) -> DataFrame:
    """(center, v) of Lloyd's algorithm from k rows spread by a hash of the id, until no row changes its centre; a bound of MOST_ROUNDS raises. A number of rounds given is done without that test. A centre without rows is dropped."""
    spark = rows.sparkSession
    data = rows.where(F.col(vector).isNotNull())
    spread = F.xxhash64(id_col, F.lit(seed)) if seed else F.xxhash64(id_col)
    start = data.orderBy(spread, id_col).limit(k).select(F.xxhash64(id_col).alias("center"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    got = start.collect()  # k rows
    ids, v, before = np.array([r["center"] for r in got], np.int64), np.array([r["v"] for r in got], float), None
    for done in range(MOST_ROUNDS if rounds is None else rounds):
        if not len(ids):
            break
        n, sums, moved = _lloyd(data.select(vector), ids, v, before)
        if rounds is None and done and not moved:
            break
        before, kept = (ids, v), n > 0
        ids, v = ids[kept], sums[kept] / n[kept, None]
    else:
        if rounds is None:
            raise RuntimeError(f"k-means is not at rest after {MOST_ROUNDS} rounds")
    return spark.createDataFrame([(int(c), x.tolist()) for c, x in zip(ids, v)], start.schema)


def _lloyd(data: DataFrame, ids: np.ndarray, v: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, sums) by centre, and how many rows had another one under the centres before; each task sends one row, and these add up in the order of the tasks."""
    sent = data.sparkSession.sparkContext.broadcast((ids, v, before))

    def step(batches):
        ids, v, before = sent.value
        near = lambda x, c: np.stack([((x - m) ** 2).sum(1) for m in c], 1).argmin(1)
        n, sums, moved = np.zeros(len(v)), np.zeros(v.shape), 0
        for b in batches:
            if len(b):
                x = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(len(b), -1)
                at = near(x, v)
                moved += len(b) if before is None else int((ids[at] != before[0][near(x, before[1])]).sum())
                n += np.bincount(at, minlength=len(v))
                for c in np.unique(at):
                    sums[c] += x[at == c].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n.tolist()], pa.list_(pa.float64())), pa.array([sums.ravel().tolist()], pa.list_(pa.float64())), pa.array([moved], pa.int64())], names=["part", "n", "s", "moved"])

    got = sorted(data.mapInArrow(step, "part int, n array<double>, s array<double>, moved long").collect())  # a row for each task
    sent.destroy()
    return np.sum([r["n"] for r in got], axis=0), np.sum([r["s"] for r in got], axis=0).reshape(v.shape), sum(r["moved"] for r in got)


def best_scale(data: DataFrame, x: str, kernel: str, scales: list[float], limit: float = 1e-16) -> DataFrame:
    """(scale, nll) of each inverse bandwidth: the negative log likelihood of every row under the others."""
    each = [loo_nll(data, x, kernel, s, limit).select(F.lit(float(s)).alias("scale"), "nll") for s in scales]
    return reduce(DataFrame.unionAll, each)


def kl_divergence(p: DataFrame, q: DataFrame, x: str, kernel: str, p_scale: float, q_scale: float, limit: float = 1e-16) -> DataFrame:
    """Divergence of the density of q from that of p, taken over the rows of p; densities are floored."""
    own = self_values(p, x, kernel, p_scale, False).withColumnRenamed("density", "a")
    data = sums.values(q, x)
    n = data.agg(F.sum("n").alias("_n")).where("_n > 0")
    under = _under(sums.values(p, x).select(F.col("x").alias("q")), data, kernel, q_scale).withColumnRenamed("q", "x")
    other = under.crossJoin(F.broadcast(n)).select("x", ((F.col("s") + F.col("same")) * (q_scale / kernels.normaliser(kernel)) / F.col("_n")).alias("b"))
    log = lambda c: F.log(F.greatest(c, F.lit(limit)))
    return own.join(other, "x").agg((F.sum((log("a") - log("b")) * F.col("n")) / F.sum("n")).alias("kl"))


def kmeans_nll(rows: DataFrame, centers: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(nll, var, n, k): rows under isotropic Gaussians of one variance at their nearest centres, that variance being all squared distances over rows less centres."""
    at = nearest_center(rows, centers, id_col, vector, [vector])
    d = F.first(F.size(vector)).cast("double")
    per = at.groupBy("center").agg(F.count("*").cast("double").alias("c"), F.sum("d2").alias("s"), d.alias("d"))
    s = per.agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.max("d").alias("d"), F.sum(F.col("c") * F.log("c")).alias("clc"))
    var = F.greatest(F.col("s") / F.greatest(F.col("n") - F.col("k"), F.lit(1.0)), F.lit(1e-12))
    nll = F.col("s") / (2 * var) + F.col("n") / 2 * F.col("d") * F.log(2 * math.pi * var) - (F.col("clc") - F.col("n") * F.log("n"))
    return s.select(nll.alias("nll"), var.alias("var"), F.col("n").cast("long").alias("n"), "k")


def kmeans_restarts(rows: DataFrame, k: int, id_col: str, vector: str, restarts: int = 8) -> DataFrame:
    """(center, v) of the best of several k-means fits, each from k rows spread by another hash, by its likelihood."""
    best = None
    for r in range(restarts):
        centers = kmeans(rows, k, id_col, vector, seed=r)
        nll = kmeans_nll(rows, centers, id_col, vector).first()["nll"]
        if nll is not None and (best is None or nll < best[0]):
            best = nll, centers
    return best[1] if best else kmeans(rows, k, id_col, vector)
