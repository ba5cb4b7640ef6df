"""Incremental densities and the background model, batch against stream."""

import numpy as np
import pytest

from tessera.functions.distributions import gaussian_log_pdf
from tessera.operators import inckde
from tessera.streaming import background


def test_kde_keeps_moments_and_is_exact_under_its_cap():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 2))
    exact = inckde.IncrementalKDE(np.eye(2) * 0.1, 500)
    capped = inckde.IncrementalKDE(np.eye(2) * 0.1, 8)
    for r in x:
        exact.add(r)
        capped.add(r)
    q = rng.standard_normal((5, 2))
    brute = np.log(np.mean([np.exp(gaussian_log_pdf(q, r, np.eye(2) * 0.1)) for r in x], 0))
    assert np.allclose(exact.log_density(q), brute)
    assert len(capped.w) == 8 and capped.w.sum() == pytest.approx(200)
    assert np.allclose(capped.w @ capped.mean / 200, x.mean(0))
    second = sum(w * (c + np.outer(m, m)) for w, m, c in zip(capped.w, capped.mean, capped.cov)) / 200
    assert np.allclose(second, x.T @ x / 200 + np.eye(2) * 0.1)
    assert np.allclose(exact.marginal([1]).log_density(q[:, 1:]), np.log(np.mean([np.exp(gaussian_log_pdf(q[:, 1:], r[1:], np.eye(1) * 0.1)) for r in x], 0)))


def test_kde_classes(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(3, size=300)
    x = np.array([[0, 0], [3, 0], [0, 3]])[y] + rng.standard_normal((300, 2)) * 0.5
    df = spark.createDataFrame([(i, int(c), [float(a) for a in v]) for i, (c, v) in enumerate(zip(y, x))] + [(900, None, [0.0, 0.0]), (901, 1, None)], "id long, label int, v array<double>")
    model = inckde.fit(df, "label", "v", np.eye(2) * 0.1, 6)
    assert model.groupBy("label").count().where("count <= 6").count() == 3 and model.agg({"w": "sum"}).first()[0] == pytest.approx(300)
    got = {r.id: r.best for r in inckde.classify(df, model, "id", "v").collect()}
    assert len(got) == 301 and np.mean([got[i] == y[i] for i in range(300)]) > 0.95


def test_background(spark, tmp_path):
    rng = np.random.default_rng(0)
    video = np.broadcast_to(rng.random((20, 20)), (30, 20, 20)) + rng.standard_normal((30, 20, 20)) * 0.02
    video[25:, 3:6, 3:6] += 2
    rows = [(f, y, x, float(video[f, y, x])) for f in range(30) for y in range(20) for x in range(20)]
    df = spark.createDataFrame(rows, "frame long, y int, x int, v double")
    got = np.zeros((30, 20, 20))
    for r in background.foreground_batch(df).collect():
        got[r.frame, r.y, r.x] = r.foreground
    assert got[25, 3:6, 3:6].min() > 0.9 and np.delete(got[25].ravel(), [y * 20 + x for y in range(3, 6) for x in range(3, 6)]).max() < 0.5
    folder = f"{tmp_path}/in"
    for lo, hi in ((0, 12), (12, 30)):
        df.where(f"frame >= {lo} and frame < {hi}").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder)
        q = background.foreground(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    same = np.zeros((30, 20, 20))
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        same[r.frame, r.y, r.x] = r.foreground
    assert np.allclose(got, same)
