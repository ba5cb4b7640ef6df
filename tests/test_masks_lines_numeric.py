"""Operators without a query of their own, and edge cases, against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions, numeric
from tessera.operators import classify, density, inference, masks, meanshift, mixture, stats, text


def test_numeric():
    words = numeric.philox(np.zeros((1, 4)), np.zeros((1, 2)))[0]
    assert [hex(x) for x in words] == ["0x6627e8d5", "0xe169c58d", "0xbc57ac4c", "0x9b00dbd8"]  # the published answer
    u = numeric.uniform(numeric.philox(np.arange(4000).reshape(-1, 4), np.ones((1000, 2))))
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    t = 0.3
    assert np.allclose(numeric.spline_weights(t, 3), [(1 - t) ** 3 / 6, (4 - 6 * t**2 + 3 * t**3) / 6, (1 + 3 * t + 3 * t**2 - 3 * t**3) / 6, t**3 / 6])
    assert all(abs(numeric.spline_weights(t, d).sum() - 1) < 1e-12 for d in range(6))
    assert abs(numeric.log_bessel(0, 1.0) - np.log(1.2660658777520084)) < 1e-9
    assert abs(numeric.log_bessel(0.5, 3.0) - np.log(np.sqrt(2 / (np.pi * 3)) * np.sinh(3))) < 1e-9
    assert abs(numeric.log_bessel(1, 199.0) - numeric.log_bessel(1, 201.0) + 2) < 0.02
    value, vector = numeric.sorted_eigen(np.array([[2.0, 3.0], [3.0, -7.0]]), True)
    assert abs(value[0]) <= abs(value[1]) and np.allclose(np.array([[2.0, 3.0], [3.0, -7.0]]) @ vector, vector * value)
    angles = np.random.default_rng(0).uniform(-1.4, 1.4, (50, 3))
    q = numeric.euler_to_versor(angles)
    assert np.allclose((q**2).sum(1), 1) and np.allclose(numeric.versor_to_euler(q), angles)
    assert numeric.topological_order([("c", "a"), ("b", "c")], ["a", "b", "c"]) == ["a", "c", "b"]
    with pytest.raises(ValueError):
        numeric.topological_order([("a", "b"), ("b", "a")], ["a", "b"])


def test_prior():
    rng = np.random.default_rng(1)
    x, far = rng.standard_normal((30, 2)), 1e8
    base = distributions.Prior(np.zeros(2), 1.0, np.eye(2), 4.0)
    both = base.absorb(30, x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0)))
    one = base
    for r in x:
        one = one.absorb(1, r, np.zeros((2, 2)))
    assert np.allclose(one.scatter, both.scatter) and np.allclose(one.mean, both.mean)
    half = [base.absorb(15, p.mean(0), (p - p.mean(0)).T @ (p - p.mean(0))) for p in (x[:15], x[15:])]
    merged = half[0].merge(half[1], base)
    assert np.allclose(merged.scatter, both.scatter) and np.allclose(merged.mean, both.mean) and merged.k == both.k
    back = both.remove(x[-1])
    assert np.allclose(back.absorb(1, x[-1], np.zeros((2, 2))).scatter, both.scatter)
    assert np.allclose(both.reweight(10, 12).scatter / 12, both.scatter / both.dof)
    assert np.linalg.eigvalsh(distributions.Prior(np.zeros(2), 1, np.array([[1.0, 2.0], [2.0, 1.0]]), 3).safe().scatter).min() > 0
    y = x + far
    away = distributions.Prior(np.full(2, far), 1.0, np.eye(2), 4.0).absorb(30, y.mean(0), (y - y.mean(0)).T @ (y - y.mean(0)))
    assert np.allclose(away.scatter, both.scatter, rtol=1e-5)


def test_far_values_and_nulls(spark):
    d = spark.createDataFrame([(None, 1e8, 0.0), (None, 1e8 + 1, 1.0), (1, 2.0, None), (1, 5.0, 1.0)], "g int, x double, y double")
    got = {r.g: r for r in stats.gaussian(d, ["g"], F.col("x"), F.col("y"), F.lit(1.0)).collect()}
    assert got[None].var_x == 0.25 and got[None].cov == 0.25 and got[1].w == 1 and got[1].var_x == 0
    data = spark.createDataFrame([(1, 0.0), (2, None), (3, 0.5), (4, None)], "id int, x double")
    q = spark.createDataFrame([(9, 0.1)], "id int, q double")
    whole = density.kde(q, data, "q", "x", "gaussian", 1.0).first().density
    assert abs(whole - density.kde(q, data.where("x is not null"), "q", "x", "gaussian", 1.0).first().density) < 1e-15
    assert density.self_density(data, "x", "gaussian", 1.0, True).count() == 2


def test_repeated_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (1, [9.0, 9.0]), (2, [1.0, 0.0]), (3, None)], "id int, v array<double>")
    centers = spark.createDataFrame([(7, [0.0, 0.0]), (8, [9.0, 9.0])], "center int, v array<double>")
    got = sorted((r.id, r.center, r.d2) for r in density.nearest_center(rows.withColumnRenamed("v", "e"), centers, "id", "e").collect())
    assert got == [(1, 7, 0.0), (1, 7, 0.0), (1, 8, 0.0), (2, 7, 1.0)]
    model = centers.selectExpr("center", "v", "1.0D var", "0.5D weight")
    r = mixture.responsibilities(rows.withColumnRenamed("v", "e"), model, "id", "e", 2).collect()
    assert len(r) == 8 and abs(sum(x.r for x in r) - 4) < 1e-9


def test_many_labels(spark):
    """More labels than any list would hold: gains as by a plain count."""
    rng = random.Random(0)
    rows = [(rng.randrange(6), rng.randrange(300)) for _ in range(2000)]
    d = spark.createDataFrame([*rows, (None, 1), (1, None)], "v int, c int")

    def entropy(part):
        n = np.bincount([c for _, c in part], minlength=300) / max(len(part), 1)
        return -(n[n > 0] * np.log(n[n > 0])).sum() * len(part)

    want = {t: (entropy(rows) - entropy([r for r in rows if r[0] < t]) - entropy([r for r in rows if r[0] >= t])) / len(rows) for t in range(1, 6)}
    got = {r.threshold: r.gain for r in stats.sweep_split(d, "v", "c").collect()}
    assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    want = {t: (entropy(rows) - entropy([r for r in rows if r[0] == t]) - entropy([r for r in rows if r[0] != t])) / len(rows) for t in range(6)}
    assert all(abs(r.gain - want[r.category]) < 1e-9 for r in stats.category_split(d, "v", "c").collect())


def test_modes_that_move_raise(spark):
    d = spark.createDataFrame([(i, float(i % 10)) for i in range(30)], "id int, x double")
    with pytest.raises(RuntimeError):
        meanshift.modes(d, d, ["x"], epsilon=1e-12, rounds=2)


def angled(lines):
    out, inside = [], False
    for x in lines:
        if inside:
            inside = not x.endswith(">>")
        elif x.startswith("<<"):
            inside = True
        else:
            out.append(x)
    return out


def test_lines(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice(["a", "<<", ">>", "<< x >>", "b >>", "<< c", "d"]) for _ in range(rng.randrange(1, 14)))) for i in range(300)] + [(900, None), (901, "")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    got: dict = {}
    for r in text.skip_angled(text.lines(d)).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.line))
    for i, t in docs:
        assert [x for _, x in sorted(got.get(i, []))] == (angled(t.split("\n")) if t is not None else []), t
    d = spark.createDataFrame([(1, "1\nAb c\nd\n\n2\nMore\n3\ntext\n\nCHAP ONE\n\nbody text\n\nLOUD\n\nend")], "doc_id int, text string")
    assert [(r.number, r.body) for r in text.numbered_paragraphs(d).orderBy("block").collect()][:2] == [("1", "Ab c d"), ("3", "More text")]
    assert [(r.title, r.body) for r in text.prefixed_blocks(d, "CHAP").orderBy("block").collect()][-3:] == [("ONE", "body text"), ("ONE", "LOUD"), ("ONE", "end")]
    d = spark.createDataFrame([(1, "Title A\n\n some text\n more\n\nTitle B\n\n x")], "doc_id int, text string")
    assert [(r.title, r.body) for r in text.indented_blocks(d).orderBy("block").collect()] == [("Title A", " some text  more"), ("Title B", " x")]


def test_chain_costs():
    rng = np.random.default_rng(3)
    unary = rng.random((5, 3))
    for pair in (inference.pair_different(3, 0.5), inference.pair_linear(3, 0.3, 0.5, 1.0, 0.4), inference.pair_ordered(3, [0.0, 0.2]), rng.random((3, 3))):
        best = np.full((5, 3), np.inf)
        for s in itertools.product(range(3), repeat=5):
            cost = sum(unary[i, a] for i, a in enumerate(s)) + sum(pair[a, b] for a, b in zip(s, s[1:]))
            for i, a in enumerate(s):
                best[i, a] = min(best[i, a], cost)
        assert np.allclose(inference.min_marginals(unary, pair), best)
        assert abs(inference.viterbi(unary, pair)[1] - best.min()) < 1e-12


def test_masks(spark):
    assert masks.tight_total([1, 0, 5, 5, 0, 1], 10) == (2, 4) and masks.tight_total([3, 3], 3) == (0, 1)
    with pytest.raises(ValueError):
        masks.tight_total([1], 2)
    p = spark.createDataFrame([(0, 0, x, v, 5) for x, v in enumerate([10, 10, 11, 200, None])], "frame int, y int, x int, r int, g int")
    cuboid = masks.background_cuboid(p, ["r", "g"], 75.0)
    assert cuboid == {"r": (10, 12), "g": (5, 6)}
    assert [r.mask for r in masks.foreground(p, cuboid).orderBy("x").collect()] == [0, 0, 0, 1, 0]
    both = masks.remap({"a": p, "b": p}, [("one", "a", "g"), ("two", "b", "r")])
    assert both.columns == ["frame", "y", "x", "one", "two"] and both.count() == 5
    m = spark.createDataFrame([(0, 0, x, int(x == 1)) for x in range(4)], "frame int, y int, x int, mask int")
    assert [r.mask for r in masks.erode(masks.dilate(m, 1), 1).orderBy("x").collect()] == [1, 1, 0, 0]
    assert [r.v for r in masks.median_filter(m.withColumn("v", F.col("x") * 1.0), "v", m).orderBy("x").collect()] == [0.0, 1.0, 2.0, 3.0]


def test_model_selection(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ([0, 0], [5, 0], [0, 5])])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").withColumnRenamed("v", "e")
    _, k, trace = mixture.best_count(rows, "id", "e", [1, 2, 3, 4])
    assert k in (3, 4) and trace[2][1] < trace[0][1]
    one, many = (density.kmeans_nll(rows, c, "id", "e").first().nll for c in (density.kmeans(rows, 3, "id", "e"), density.kmeans_restarts(rows, 3, "id", "e", 4)))
    assert many <= one + 1e-9
    assert classify.subsample(rows, "id", 0.5).count() == classify.subsample(rows.repartition(3), "id", 0.5).count() > 0
