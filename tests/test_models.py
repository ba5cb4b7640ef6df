"""Solvers against brute force and dense algebra."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import density, inference, mixture


def test_chains(spark):
    rng = np.random.default_rng(0)
    costs = rng.random((5, 6, 3))
    rows = [(c, v, s, float(costs[c, v, s])) for c, v, s in itertools.product(range(5), range(6), range(3))]
    got = inference.chain_labels(spark.createDataFrame(rows, "chain long, var long, state long, cost double"), 0.5).collect()
    for c in range(5):
        cost = lambda z: sum(costs[c, v, s] for v, s in enumerate(z)) + 0.5 * sum(a != b for a, b in zip(z, z[1:]))  # noqa: B023, E731
        best = min(itertools.product(range(3), repeat=6), key=cost)
        mine = sorted((r for r in got if r.chain == c), key=lambda r: r["var"])
        assert tuple(r.state for r in mine) == best and mine[0].total == pytest.approx(cost(best))


def test_gaussian_graphs(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g, edges in enumerate([[(i, i + 1) for i in range(7)], [(0, 1), (0, 2), (2, 3), (2, 4)], [(0, 1), (1, 2), (0, 2)], []]):
        n = max([2, *(max(e) + 1 for e in edges)])
        m, h = np.diag(rng.random(n) + 4), rng.standard_normal(n)
        for a, b in edges:
            m[a, b] = m[b, a] = w = rng.standard_normal() * 0.8
            rows.append((g, a, b, w, None))
        rows += [(g, i, i, float(m[i, i]), float(h[i])) for i in range(n)]
        cov = np.linalg.inv(m)
        want |= {(g, i): ((cov @ h)[i], cov[i, i]) for i in range(n)}
    got = {(r.graph, r.node): (r.mean, r["var"]) for r in inference.gaussian_marginals(spark.createDataFrame(rows, "graph long, a long, b long, precision double, potential double")).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_binary_cut(spark):
    rng = np.random.default_rng(2)
    rows, best = [], {}
    for g in range(4):
        unary = rng.random((9, 2))
        edges = [(i, i + 1) for i in range(9) if i % 3 < 2] + [(i, i + 3) for i in range(6)]
        pair = rng.random(len(edges)) * 0.6
        rows += [(g, i, i, float(unary[i, 0]), float(unary[i, 1])) for i in range(9)] + [(g, a, b, float(c), None) for (a, b), c in zip(edges, pair)]
        cost = lambda z: sum(unary[i, s] for i, s in enumerate(z)) + sum(c for (a, b), c in zip(edges, pair) if z[a] != z[b])  # noqa: B023, E731
        z = min(itertools.product((0, 1), repeat=9), key=cost)
        best[g] = z, cost(z)
    got = inference.binary_cut(spark.createDataFrame(rows, "graph long, a long, b long, cost0 double, cost1 double")).collect()
    for g, (z, c) in best.items():
        mine = sorted((r for r in got if r.graph == g), key=lambda r: r.node)
        assert tuple(r.label for r in mine) == z and mine[0].total == pytest.approx(c)


def test_size_limit(spark, monkeypatch):
    with pytest.raises(ValueError):
        inference._sized(inference.LIMIT + 1)


def test_mixture_improves(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").limit(200)
    centers = density.mean_vectors(rows, F.col("label").cast("long") % 3, "embedding")
    model, trace = mixture.fit_isotropic(rows, centers, "vec_id", "embedding", 4)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:])) and abs(sum(r.weight for r in model.collect()) - 1) < 1e-9


def test_model_queries(spark, sf):
    from tessera.plans import catalog

    assert catalog.QUERIES["chain_labels"](spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber").distinct().count()
    assert catalog.QUERIES["gmm_isotropic"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
