"""Fits run until they rest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import density, mixture
from tessera.plans import catalog


def test_kmeans_rests(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    at = {r.vec_id: r.center for r in catalog.QUERIES["kmeans"](spark, sf).collect()}
    assert set(at) == set(x)
    names = sorted(set(at.values()))
    means = np.stack([np.mean([x[i] for i in x if at[i] == c], axis=0) for c in names])
    assert all(names[((x[i] - means) ** 2).sum(1).argmin()] == at[i] for i in x)


def test_kmeans_bound(spark, sf, monkeypatch):
    monkeypatch.setattr(density, "MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError):
        catalog.QUERIES["kmeans"](spark, sf)


def test_mixture_rests(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = np.stack([np.array(r.embedding, float) for r in rows.collect()])
    centers = density.mean_vectors(rows, F.col("label").cast("long"), "embedding")
    model, trace = mixture.fit_isotropic(rows, centers, "vec_id", "embedding")
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    got = model.collect()
    v, var, w = (np.array([r[c] for r in got]) for c in ("v", "var", "weight"))

    def shares(v, var, w):
        p = np.log(w) - 32 * np.log(2 * np.pi * var) - ((x[:, None] - v) ** 2).sum(2) / (2 * var)
        e = np.exp(p - p.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    r = shares(v, var, w)
    n = r.sum(0)
    mean = r.T @ x / n[:, None]
    spread = (r * ((x[:, None] - mean) ** 2).sum(2)).sum(0) / n / 64
    assert np.abs(shares(mean, np.maximum(spread, mixture.FLOOR), n / n.sum()) - r).max() < 2e-4
