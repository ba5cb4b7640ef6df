"""Kernel sums without pairs: exact against brute force, and done in time where pairs would not be."""

import threading

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators import density, meanshift, sums

MANY, LONGEST = 60_000, 120


def within(spark, seconds, f):
    """f(), whose jobs are cancelled after so many seconds."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return f()
    finally:
        timer.cancel()


def frame(spark, x):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(x)], "id long, x double")


def crowded(shift=0.0):
    """Values to four places that all lie in range of each other."""
    return np.round(np.random.default_rng(0).normal(shift, 0.4, MANY).clip(-1.7, 1.7), 4)


def crowded_sums(q, x):
    """Gaussian sums over all of such values, which are places of one grid, by a Fourier transform."""
    at = lambda v: np.rint((v + 1.7) * 1e4).astype(int)
    n, size = 34_001, 1 << 17
    f = np.exp(-0.5 * (np.arange(1 - n, n) * 1e-4) ** 2)
    return np.fft.irfft(np.fft.rfft(np.bincount(at(x), minlength=n), size) * np.fft.rfft(f, size), size)[n - 1 + at(q)]


def brute(q, x, kernel, scale):
    out = []
    for v in q:
        d = np.abs(v - x) * scale
        out.append(np.where(d < sums.reach(kernel), sums._CURVES[kernel](d), 0).sum())
    return np.array(out)


@pytest.mark.parametrize("kernel", sorted(kernels.RANGE))
def test_sums_are_those_of_all_pairs(spark, kernel):
    rng = np.random.default_rng(1)
    x = np.round(np.concatenate([rng.normal(0, 1, 200), rng.uniform(-30, 30, 60), np.arange(-20, 20) * 0.5, [2.0] * 40]), 3)
    q = np.unique(np.round(np.concatenate([rng.uniform(-35, 35, 60), np.arange(-10, 10) * 0.5, x[:40]]), 3))
    source = sums.sources(sums.values(frame(spark, [*x, None, np.nan, np.inf]), "x"), kernel, 0.7)
    rows = sums.sums(frame(spark, [*q, np.nan, -np.inf]).withColumnRenamed("x", "q"), source, kernel, 0.7, True).collect()
    got = {r.q: r for r in rows if np.isfinite(r.q)}
    assert sorted(got) == sorted(q) and len(rows) == len(q) + 2 and all(r.s == r.same == r.t == 0 for r in rows if not np.isfinite(r.q))
    assert np.allclose([got[v].s + got[v].same for v in q], brute(q, x, kernel, 0.7), rtol=1e-12, atol=1e-13)
    ways = [np.where(np.abs(v - x) * 0.7 < sums.reach(kernel), sums._CURVES[kernel](np.abs(v - x) * 0.7) * (x - v), 0).sum() for v in q]
    assert np.allclose([got[v].t for v in q], ways, rtol=1e-11, atol=1e-11)


def test_divergence_makes_no_pairs(spark):
    p, q = crowded(), crowded(shift=0.2)
    got = within(spark, LONGEST, lambda: density.kl_divergence(frame(spark, p), frame(spark, q), "x", "gaussian", 1.0, 1.0).first().kl)
    assert got == pytest.approx(np.mean(np.log(crowded_sums(p, p)) - np.log(crowded_sums(p, q))), abs=1e-9)


def test_loo_nll_makes_no_pairs(spark):
    x = crowded()
    got = within(spark, LONGEST, lambda: density.loo_nll(frame(spark, x), "x", "gaussian", 1.0).first().nll)
    assert got == pytest.approx(-np.log((crowded_sums(x, x) - 1) / kernels.normaliser("gaussian") / (MANY - 1)).sum(), abs=1e-4)


def crowded_kde(spark, kernel):
    x = crowded()
    rows = frame(spark, x)
    got = within(spark, LONGEST, lambda: {r.id: r.density for r in density.kde(rows, rows, "x", "x", kernel, 1.0).collect()})
    some = range(0, MANY, 3000)
    assert len(got) == MANY and np.allclose([got[i] for i in some], brute(x[::3000], x, kernel, 1.0) / kernels.normaliser(kernel) / MANY, rtol=1e-12)


def test_gaussian_kde_makes_no_pairs(spark):
    crowded_kde(spark, "gaussian")


def test_cauchy_kde_makes_no_pairs(spark):
    crowded_kde(spark, "cauchy")


def test_logistic_kde_makes_no_pairs(spark):
    crowded_kde(spark, "logistic")


def test_entropy_makes_no_pairs(spark):
    x = crowded()
    got = within(spark, LONGEST, lambda: density.density_entropy(frame(spark, x), "x", "gaussian", 1.0).first().entropy)
    assert got == pytest.approx(-np.log(crowded_sums(x, x) / kernels.normaliser("gaussian") / MANY).mean(), abs=1e-9)


def test_scale_grid_makes_no_pairs(spark):
    x = crowded()
    got = within(spark, LONGEST, lambda: {r.scale: r.nll for r in density.best_scale(frame(spark, x), "x", "gaussian", [0.5, 1.0]).collect()})
    assert got[1.0] == pytest.approx(-np.log((crowded_sums(x, x) - 1) / kernels.normaliser("gaussian") / (MANY - 1)).sum(), abs=1e-4) and got[0.5] > got[1.0]


def test_mean_shift_makes_no_pairs(spark):
    x = np.concatenate([crowded()[: MANY // 2] - 2, crowded()[MANY // 2 :] + 6])
    got = within(spark, LONGEST, lambda: {r.id: r for r in meanshift.cluster(frame(spark, x), ["x"]).collect()})
    assert len(got) == MANY and all(got[i].cluster == (0 if i < MANY // 2 else MANY // 2) for i in range(MANY))
    for i in (0, 1, MANY - 1):
        y = x[i]
        for _ in range(100):
            d = np.abs(y - x)
            w = np.where(d < 3.5, np.exp(-0.5 * d * d), 0)
            y, step = (w * x).sum() / w.sum(), y
            if abs(y - step) < 1e-3:
                break
        assert got[i].x == pytest.approx(y, abs=1e-9)
