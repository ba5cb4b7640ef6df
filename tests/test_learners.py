"""Forests, support vector machines, topic models and mean shift against planted structure and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forest, meanshift, svm, topics


def clusters(spark, n, k=3, d=4, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(k, size=n)
    x = rng.standard_normal((n, d)) * 0.5 + np.eye(k, d)[y] * 4
    return spark.createDataFrame([(i, int(c), [float(e) for e in v]) for i, (c, v) in enumerate(zip(y, x))], "id long, label int, v array<double>")


def test_forest(spark):
    rows = clusters(spark, 600).unionAll(spark.createDataFrame([(900, None, [0.0] * 4), (901, 1, None)], "id long, label int, v array<double>"))
    nodes, leaves = forest.train(rows, "id", "label", "v", trees=5, depth=4)
    fresh = clusters(spark, 200, seed=1)
    got = forest.predict(fresh, nodes, leaves, "id", "v").select("id", "best").distinct().join(fresh, "id")
    assert got.count() == 200 and got.where("best = label").count() > 190
    p = forest.predict(fresh, nodes, leaves, "id", "v").groupBy("id").agg(F.sum("p").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert p[0] == pytest.approx(1) and p[1] == pytest.approx(1)
    bagged = forest.predict(rows, nodes, leaves, "id", "v", bag=True).select("id", "best").distinct().join(rows, "id")
    assert 300 < bagged.count() <= 601 and bagged.where("best = label").count() > 0.9 * bagged.count()


def test_forest_split_is_the_best(spark):
    rng = np.random.default_rng(3)
    rows = [(0, 1, f, b, y, float(rng.integers(1, 9))) for f in range(2) for b in range(4) for y in range(2)]
    # both features see the same rows, so their label totals agree
    w = {(f, b, y): v for _, _, f, b, y, v in rows}
    for y in range(2):
        w[1, 3, y] += sum(w[0, b, y] for b in range(4)) - sum(w[1, b, y] for b in range(4)) + 40
        w[0, 3, y] += 40
    counts = spark.createDataFrame([(0, 1, f, b, y, v) for (f, b, y), v in w.items()], "tree int, node long, feature int, bin int, label int, w double")

    def h(a):
        a = np.array(a) / sum(a)
        return -(a * np.log(a)).sum()

    def gain(f, b):
        l, r = ([sum(w[f, i, y] for i in part) for y in range(2)] for part in (range(b + 1), range(b + 1, 4)))
        t = sum(l) + sum(r)
        return h([a + c for a, c in zip(l, r)]) - sum(l) / t * h(l) - sum(r) / t * h(r)

    best = max(((f, b) for f in range(2) for b in range(3)), key=lambda q: gain(*q))
    got = forest._splits(counts, 1, 0.0).first()
    assert (got.feature, got.bin) == best


def test_forest_empty(spark):
    rows = spark.createDataFrame([], "id long, label int, v array<double>")
    nodes, leaves = forest.train(rows, "id", "label", "v")
    assert nodes.count() == leaves.count() == 0


def test_svm_dual_is_optimal():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 2))
    y = np.where(x[:, 0] + 0.5 * rng.standard_normal(60) > 0, 1.0, -1.0)
    k = svm.gram("rbf", x, x)
    alpha, b = svm.solve(k, y, 2.0, balanced=False, tol=1e-6)
    assert abs(alpha @ y) < 1e-9 and alpha.min() >= 0 and alpha.max() <= 2 + 1e-9
    margin = y * (k @ (alpha * y) + b)
    assert (margin[alpha < 1e-9] > 1 - 1e-3).all() and (margin[alpha > 2 - 1e-9] < 1 + 1e-3).all()
    assert np.allclose(margin[(alpha > 1e-3) & (alpha < 2 - 1e-3)], 1, atol=1e-3)


def test_svm_loo_skips_nothing():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((24, 2))
    y = np.where(x[:, 0] * x[:, 1] > 0, 1.0, -1.0)
    k = svm.gram("rbf", x, x)
    right = 0
    for i in range(24):
        keep = np.arange(24) != i
        a, b = svm.solve(k[np.ix_(keep, keep)], y[keep], 5.0, balanced=False)
        right += np.sign(k[i, keep] @ (a * y[keep]) + b) == y[i]
    assert svm.leave_one_out(x, y, "rbf", 1.0, 1.0, 5.0) == pytest.approx(right / 24, abs=1 / 24)


def test_svm_one_against_one(spark):
    model = svm.train_pairs(clusters(spark, 150), "label", "v", "rbf", 0.5)
    fresh = clusters(spark, 100, seed=1)
    got = svm.vote(svm.decisions(fresh, model, "id", "v", "rbf", 0.5)).join(fresh, "id")
    assert got.count() == 100 and got.where("best = label").count() > 95


def corpus(spark):
    rng = np.random.default_rng(0)
    p = np.array([[4, 2, 1, 0], [0, 1, 2, 4]]) / 7
    rows = [(d, f"w{w}", int(n)) for d in range(50) for w, n in enumerate(rng.multinomial(80, p[int(d >= 40)])) if n]
    return spark.createDataFrame(rows, "doc long, word string, n int"), p


@pytest.mark.parametrize("how", ["variational", "gibbs"])
def test_topics(spark, how):
    bow, p = corpus(spark)
    if how == "variational":
        index, lb = topics.fit(bow, 2)
        got = np.exp(lb)[:, [index[f"w{i}"] for i in range(4)]]
        shares = topics.fold_in(bow, index, lb).collect()
        assert len(shares) == 50 and len({int(np.argmax(r.topics)) for r in shares if r.doc < 40}) == 1
    else:
        rows = topics.gibbs(bow, 2, burn=30, samples=4).collect()
        got = np.array([[next(r.p for r in rows if r.topic == t and r.word == f"w{i}") for i in range(4)] for t in range(2)])
    got = got[np.argsort(-got[:, 0])]
    assert np.abs(got - p).max() < 0.06


def test_mean_shift(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.3, 60), rng.normal(6, 0.3, 30)])
    data = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    got = {r.id: r for r in meanshift.cluster(data, ["x"], merge_range=0.5).collect()}
    assert len(got) == 90 and {r.cluster for r in got.values()} == {0, 60}
    assert all((got[i].cluster == 0) == (i < 60) for i in got)
    y = x.copy()
    for _ in range(200):
        d = np.abs(y[:, None] - x)
        w = np.where(d < 3.5, np.exp(-0.5 * d * d), 0)
        y = (w * x).sum(1) / w.sum(1)
    assert np.allclose([got[i].x for i in range(90)], y, atol=1e-2)


def test_topics_need_no_vocabulary_limit(spark, monkeypatch):
    monkeypatch.setattr(topics, "VOCABULARY", 2)
    monkeypatch.setattr(topics, "BLOCK_PAIRS", 40)
    bow, p = corpus(spark)
    model = topics.fit_words(bow, 2)
    rows = {r.word: r.p for r in model.collect()}
    got = np.array([rows[f"w{i}"] for i in range(4)]).T
    assert np.abs(got[np.argsort(-got[:, 0])] - p).max() < 0.06
    more = bow.unionAll(spark.createDataFrame([(99, "unseen", 3)], bow.schema))
    shares = {r.doc: r for r in topics.fold_words(more, model, 2).collect()}
    assert len(shares) == 51 and list(shares[99].topics) == [0.5, 0.5] and shares[99].nll == 0
    with pytest.raises(ValueError):
        topics.fit(bow, 2, rounds=1)


def test_svm_of_any_size(spark, monkeypatch):
    rows = clusters(spark, 150)
    fresh = clusters(spark, 100, seed=1)
    value = lambda model: {(r.id, r.neg, r.pos): r.value for r in svm.decisions(fresh, model, "id", "v", "rbf", 0.5).collect()}
    want = value(svm.train_pairs(rows, "label", "v", "rbf", 0.5).localCheckpoint())
    monkeypatch.setattr(svm, "MODEL_BYTES", 2_000)  # several blocks of support vectors
    got = value(svm.train_pairs(rows, "label", "v", "rbf", 0.5).localCheckpoint())
    assert len(want) == 300 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    x = np.array([r.v for r in rows.collect()])
    y = np.where(np.arange(150) % 3 > 0, 1.0, -1.0)
    whole, b = svm.solve(svm.gram("rbf", x, x), y, 5.0)
    monkeypatch.setattr(svm, "KEPT_BYTES", 8 * 150 * 10)  # ten rows of the kernel matrix
    part, c = svm.solve(svm.Rows("rbf", x, 1.0, 1.0), y, 5.0)
    assert np.allclose(whole, part, atol=1e-6) and abs(b - c) < 1e-6


def test_svm_pairs_begin_near_the_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.where(rng.random(700) < 0.4, 1.0, -1.0)

    class Counted(svm.Rows):
        asked = 0

        def __getitem__(self, i):
            self.asked += 1
            return super().__getitem__(i)

    rows = Counted("rbf", x, 1.0, 1.0)
    alpha, b = svm.solve(rows, y, 10.0, near=True)
    assert rows.asked < 100
    k, bound = svm.gram("rbf", x, x), 10 * np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2
    f = y - k @ (alpha * y)
    up, low = np.where(y > 0, alpha < bound - 1e-12, alpha > 1e-12), np.where(y > 0, alpha > 1e-12, alpha < bound - 1e-12)
    assert f[up].max() - f[low].min() < 1.1e-4 and abs(alpha @ y) < 1e-9 and alpha.min() >= 0 and (alpha <= bound).all()
    want, c = svm.solve(k, y, 10.0)
    assert abs(alpha @ y - want @ y) < 1e-9 and abs(b - c) < 1e-3 and np.abs(k @ ((alpha - want) * y)).max() < 1e-3
    # Kernels without an inverse, single classes and rows of equal vectors end as well.
    for name, p in (("linear", 1.0), ("poly", 3.0)):
        few = svm.solve(svm.Rows(name, np.repeat(x[:60, :3], 2, 0), p, 1.0), np.repeat(np.where(x[:60, 0] + x[:60, 3] > 0, 1.0, -1.0), 2), 0.5, near=True)
        assert np.isfinite(few[0]).all() and np.isfinite(few[1])
    assert svm.solve(svm.Rows("rbf", x, 1.0, 1.0), np.ones(700), 10.0, near=True)[0].max() == 0
    # A pair of classes is a task of its own.
    model = svm.train_pairs(clusters(spark, 300, k=5, d=6), "label", "v", "rbf", 0.5)
    pairs = model.select("neg", "pos", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(pairs) == 10 and len({r.p for r in pairs}) == 10


def test_topics_go_on_from_the_round_before(spark, monkeypatch):
    from tessera.functions import special

    monkeypatch.setattr(topics, "BLOCK_PAIRS", 20)
    monkeypatch.setattr(topics, "CHUNK_ROWS", 50)
    bow, _ = corpus(spark)
    bow = bow.unionAll(spark.createDataFrame([(3, None, 2), (4, "w9", 0), (70, "alone", 5)], bow.schema))
    got = {r.word: np.array(r.p) for r in topics.fit_words(bow, 2, rounds=4).collect()}
    rows = [r for r in bow.collect() if r.word is not None and r.n > 0]
    docs, names = sorted({r.doc for r in rows}), sorted({r.word for r in rows})
    n = np.zeros((len(docs), len(names)))
    for r in rows:
        n[docs.index(r.doc), names.index(r.word)] = r.n
    u = [F.pmod(F.xxhash64("word", F.lit(k), F.lit(0)), F.lit(1 << 40)) / float(1 << 40) for k in range(2)]
    start = {r.word: [r.a, r.b] for r in bow.select("word", u[0].alias("a"), u[1].alias("b")).where("word is not null").distinct().collect()}
    b = np.array([[1 + 0.1 * 3**0.5 * (2 * x - 1) for x in start[w]] for w in names])
    gamma = 0.1 + n.sum(1, keepdims=True) / 2 * np.ones(2)
    for _ in range(4):
        weights = np.exp(special.digamma(b + 0.01) - special.digamma(b.sum(0) + len(names) * 0.01))
        b = np.zeros_like(b)
        for i, counts in enumerate(n):
            for _ in range(50):
                e = np.exp(special.digamma(gamma[i]))
                z = weights * e
                z *= (counts / z.sum(1))[:, None]
                before, gamma[i] = gamma[i].copy(), 0.1 + z.sum(0)
                if np.abs(gamma[i] - before).max() < 1e-4:
                    break
            b += z
    want = (b + 0.01) / (b.sum(0) + len(names) * 0.01)
    assert sorted(got) == names and max(np.abs(got[w] - want[i]).max() for i, w in enumerate(names)) < 1e-9
