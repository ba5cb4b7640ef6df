"""Distributions against numeric integrals and each other, Dirichlet-process mixtures on planted clusters, geometry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions as di
from tessera.functions import geometry
from tessera.operators import dirichlet


def test_densities_integrate_to_one():
    x = np.linspace(-40, 40, 200_001)[:, None]
    for log_p in (di.gaussian_log_pdf(x, np.array([1.0]), np.array([[2.0]])), di.student_log_pdf(x, 5.0, np.array([1.0]), np.array([[2.0]]))):
        assert np.trapezoid(np.exp(log_p), x[:, 0]) == pytest.approx(1, abs=1e-4)
    v = np.linspace(1e-6, 80, 200_001)
    p = [np.exp(di.wishart_log_pdf(np.array([[a]]), 4.0, np.array([[1.5]]))) for a in v[::100]]
    assert np.trapezoid(p, v[::100]) == pytest.approx(1, abs=1e-3)


def test_conjugate_updates_agree():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((30, 2))
    p = di.Prior(np.zeros(2), 1.0, np.eye(2), 4.0)
    whole = p.update(30, x.sum(0), x.T @ x)
    one = p
    evidence = 0.0
    for r in x:
        evidence += float(di.student_log_pdf(r, *one.predictive())[0])
        one = one.update(1, r, np.outer(r, r))
    assert np.allclose(one.mean, whole.mean) and np.allclose(one.scatter, whole.scatter) and one.dof == whole.dof
    back = p
    for r in x[::-1]:
        evidence -= float(di.student_log_pdf(r, *back.predictive())[0])
        back = back.update(1, r, np.outer(r, r))
    assert evidence == pytest.approx(0, abs=1e-8)  # exchangeable


def test_draws():
    rng = np.random.default_rng(0)
    s = np.array([[2.0, 0.5], [0.5, 1.0]])
    assert np.allclose(np.mean([di.wishart_draw(rng, 5.0, s) for _ in range(4000)], 0), 5 * s, atol=0.5)
    assert np.allclose(np.cov(di.gaussian_draw(rng, np.zeros(2), s, 20000).T), s, atol=0.08)


def test_mixture_finds_the_clusters(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(3, size=400)
    x = np.array([[0, 0], [6, 0], [0, 6]])[y] + rng.standard_normal((400, 2)) * 0.4
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    model = dirichlet.fit(df, "id", "v", components=6, rounds=40)
    got = {r.id: r for r in dirichlet.density(df, model, "id", "v").collect()}
    assert len(got) == 400 and all(abs(sum(r.shares) - 1) < 1e-9 for r in got.values())
    assert {len({got[i].component for i in np.flatnonzero(y == c)}) for c in range(3)} == {1} and len({r.component for r in got.values()}) == 3
    assert dirichlet.nll(df, model, "id", "v") < dirichlet.nll(df, dirichlet.fit(df, "id", "v", components=1), "id", "v")
    far = dirichlet.density(spark.createDataFrame([(0, [40.0, -40.0])], "id long, v array<double>"), model, "id", "v").first()
    assert far.component >= 3 and sum(far.shares[3:]) > 0.999  # components without rows equal the prior, so they share what is new
    assert dirichlet.sample(model, rng, 50).shape == (50, 2)


def test_geometry():
    hg = geometry.translate(2, 3) @ geometry.rotate(0.3) @ geometry.scale(1.5) + np.array([[0, 0, 0], [0, 0, 0], [0.01, 0.02, 0]])
    src = np.array([[0, 0], [4, 0], [0, 5], [6, 7.0]])
    assert np.allclose(geometry.match(src, geometry.apply(hg, src)), hg / hg[2, 2])
    moved, (h, w) = geometry.fit(geometry.rotate(np.pi / 2), 4, 9)
    low, high = geometry.bounds(moved, (0, 0), (8, 3))
    assert np.allclose(low, 0, atol=1e-9) and (w, h) == (4, 9) and np.allclose(high, [3, 8])
    rng = np.random.default_rng(0)
    x = rng.random((20, 2))
    tps = geometry.ThinPlate(x, np.sin(x[:, 0] * 3))
    assert np.allclose(tps(x), np.sin(x[:, 0] * 3), atol=1e-8)
    flat = geometry.ThinPlate(x, 2 + x @ [1.0, -3.0])
    assert np.allclose(flat.affine, [2, 1, -3], atol=1e-6)


def test_empty(spark):
    with pytest.raises(ValueError):
        dirichlet.fit(spark.createDataFrame([], "id long, v array<double>").withColumn("v", F.col("v")), "id", "v")
