"""Mixture models fitted by driver loops over one aggregation a round; only the components travel."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators.density import MOST_ROUNDS, kmeans, mean_vectors, model_row, nearest_center

FLOOR = 1e-6


def fit_isotropic(rows: DataFrame, centers: DataFrame, id_col: str, vector: str, rounds: int | None = None, epsilon: float = 1e-4):
    """Expectation maximisation of isotropic Gaussians from start centres (center, v), until no row's share of a component changes by epsilon (the likelihood may stand still on the way); a bound of MOST_ROUNDS raises. A number of rounds given is done without that test. (components (center, v, var, weight), log likelihood by round)."""
    spark = rows.sparkSession
    start = centers.collect()
    ids = np.array([r["center"] for r in start], np.int64)
    v = np.array([r["v"] for r in start], float)
    model, before = (ids, v, np.ones(len(ids)), np.full(len(ids), 1 / len(ids))), None
    data, trace = rows.where(F.col(vector).isNotNull()).select(vector), []
    for done in range(MOST_ROUNDS if rounds is None else rounds):
        n, s, sums, likelihood, change = _em(data, model, before)
        trace.append(likelihood)
        if rounds is None and done and change < epsilon:
            break
        before, kept = model, n > 0
        n, s, v = n[kept], s[kept], sums[kept] / n[kept, None]
        var = np.maximum((s / n - ((v - model[1][kept]) ** 2).sum(1)) / v.shape[1], FLOOR)
        model = model[0][kept], v, var, n / n.sum()
    else:
        if rounds is None:
            raise RuntimeError(f"the mixture is not at rest after {MOST_ROUNDS} rounds")
    return spark.createDataFrame([(int(c), m.tolist(), float(a), float(w)) for c, m, a, w in zip(*model)], "center long, v array<double>, var double, weight double"), trace


def _em(data: DataFrame, model: tuple, before: tuple | None):
    """(weight, weighted squared distances, weighted sums) by component, the log likelihood, and the largest change of a row's share since the model before; each task sends one row."""
    sent = data.sparkSession.sparkContext.broadcast((model, before))

    def shares(x, ids, v, var, weight):
        d2 = np.stack([((x - m) ** 2).sum(1) for m in v], 1)
        p = np.log(weight) - x.shape[1] / 2 * np.log(2 * np.pi * var) - d2 / (2 * var)
        top = p.max(1, keepdims=True)
        e = np.exp(p - top)
        return d2, e / e.sum(1, keepdims=True), top[:, 0] + np.log(e.sum(1))

    def step(batches):
        model, before = sent.value
        k, d = model[1].shape
        n, s, sums, likelihood, change = np.zeros(k), np.zeros(k), np.zeros((k, d)), 0.0, 0.0
        for b in batches:
            if len(b):
                x = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(len(b), -1)
                d2, r, norm = shares(x, *model)
                if before is not None:
                    old = shares(x, *before)[1]
                    change = max(change, float(np.abs(r - old[:, np.isin(before[0], model[0])]).max()))
                n, s, sums, likelihood = n + r.sum(0), s + (r * d2).sum(0), sums + r.T @ x, likelihood + float(norm.sum())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate([n, s, sums.ravel()]).tolist()], pa.list_(pa.float64())), pa.array([likelihood]), pa.array([change])], names=["part", "s", "likelihood", "change"])

    got = sorted(data.mapInArrow(step, "part int, s array<double>, likelihood double, change double").collect())  # a row for each task
    sent.destroy()
    k, total = len(model[0]), np.sum([r["s"] for r in got], axis=0)
    return total[:k], total[k : 2 * k], total[2 * k :].reshape(k, -1), sum(r["likelihood"] for r in got), max(r["change"] for r in got)


def responsibilities(rows: DataFrame, model: DataFrame, id_col: str, vector: str, d: int) -> DataFrame:
    """(id, vector, center, d2, r, norm): each row's share of each component, and its log likelihood. Every row gives its own shares, repeated ones too, without a shuffle."""
    parts = F.transform("_model", lambda c: F.struct(c["center"].alias("center"), c["var"].alias("var"), c["weight"].alias("weight"), kernels.squared_distance(F.col(vector), c["v"]).alias("d2")))
    scored = rows.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(model_row(model, ["center", "v", "var", "weight"]))).select(id_col, vector, parts.alias("parts"))
    log_p = lambda c: F.log(c["weight"]) - d / 2 * (F.log(c["var"]) + math.log(2 * math.pi)) - c["d2"] / (2 * c["var"])
    scored = scored.select(id_col, vector, F.transform("parts", lambda c: F.struct(c["center"].alias("center"), c["d2"].alias("d2"), log_p(c).alias("p"))).alias("parts"))
    top = F.array_max(F.transform("parts", lambda c: c["p"]))
    scored = scored.withColumn("m", top).withColumn("norm", F.col("m") + F.log(F.aggregate("parts", F.lit(0.0), lambda s, x: s + F.exp(x["p"] - F.col("m")))))
    return scored.select(id_col, vector, "norm", F.explode("parts").alias("c")).select(id_col, vector, "c.center", "c.d2", F.exp(F.col("c.p") - F.col("norm")).alias("r"), "norm")


def bic(log_likelihood: float, parameters: int, n: int) -> float:
    return parameters * math.log(n) - 2 * log_likelihood


def best_count(rows: DataFrame, id_col: str, vector: str, counts: list[int]):
    """(components, count, [(count, criterion)]): the isotropic mixture, started from k-means, with the least Bayesian information criterion."""
    n, d = rows.where(F.col(vector).isNotNull()).agg(F.count("*"), F.max(F.size(vector))).first()
    best, trace = None, []
    for k in counts:
        model, likelihood = fit_isotropic(rows, kmeans(rows, k, id_col, vector), id_col, vector)
        trace.append((k, bic(likelihood[-1], k * (d + 2) - 1, n)))
        if best is None or trace[-1][1] < best[1]:
            best = model, trace[-1][1], k
    return best[0], best[2], trace


__all__ = ["best_count", "bic", "fit_isotropic", "mean_vectors", "nearest_center", "responsibilities"]
