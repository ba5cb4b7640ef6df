import numpy as np

from tessera.operators import forest, inckde, svm


def test_regression(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (1500, 3))
    y = 1e6 + 3 * (x[:, 0] > 0.2) - 2 * (x[:, 1] < -0.3) + 0.05 * rng.standard_normal(1500)
    rows = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))] + [(9000, None, 1.0), (9001, [0.0, 0.0, 0.0], None)], "id long, v array<double>, y double")
    nodes, leaves = forest.train_regression(rows, "id", "y", "v", trees=6)
    n, error = forest.bag_error(rows, nodes, leaves, "id", "y", "v").first()
    assert n > 1000 and error < 0.2 * y.var()
    share = {r.feature: r.importance for r in forest.importance(nodes).collect()}
    assert abs(sum(share.values()) - 1) < 1e-9 and share.get(2, 0) < min(share[0], share[1])
    forest.save(nodes, leaves, f"file://{tmp_path}/model")
    again = forest.load(spark, f"file://{tmp_path}/model")
    one = {r.id: (r.mean, r.var) for r in forest.predict_regression(rows, nodes, leaves, "id", "v").collect()}
    two = {r.id: (r.mean, r.var) for r in forest.predict_regression(rows, *again, "id", "v").collect()}
    both = {r.id: r.mean for r in forest.predict_regression(rows, *forest.merge([again, again]), "id", "v").collect()}
    assert len(one) == 1501 and all(np.allclose(one[i], two[i]) and abs(both[i] - one[i][0]) < 1e-6 for i in one)


def test_bag_error_of_classes(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((800, 4))
    rows = spark.createDataFrame([(i, v.tolist(), int(v[2] > 0)) for i, v in enumerate(x)], "id long, v array<double>, label int")
    nodes, leaves = forest.train(rows, "id", "label", "v")
    n, error = forest.bag_error(rows, nodes, leaves, "id", "label", "v").first()
    assert n > 600 and error < 0.2
    best = max(forest.importance(nodes).collect(), key=lambda r: r.importance)
    assert best.feature == 2


def test_order_does_not_matter(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 2)))], "label long, v array<double>")
    models = [sorted(map(repr, inckde.fit(d, "label", "v", 0.1 * np.eye(2), 8).collect())) for d in (rows, rows.repartition(7).orderBy("v"))]
    assert models[0] == models[1]


def test_bias_in_the_middle():
    """Both support vectors at their bound: the bias is the middle of what is allowed."""
    x = np.array([[0.0], [0.1], [-3.0], [3.0]])
    y = np.array([1.0, -1.0, -1.0, 1.0])
    alpha, b = svm.solve(svm.gram("linear", x, x, 1, 1), y, 0.01, balanced=False)
    assert np.allclose(alpha, 0.01) or alpha.max() <= 0.01 + 1e-9
    grad = svm.gram("linear", x, x, 1, 1) @ (alpha * y)
    f = y - grad
    up = ((y > 0) & (alpha < 0.01 - 1e-12)) | ((y < 0) & (alpha > 1e-12))
    low = ((y < 0) & (alpha < 0.01 - 1e-12)) | ((y > 0) & (alpha > 1e-12))
    assert f[up].max() - 1e-3 <= b <= f[low].min() + 1e-3 or abs(b - f[(alpha > 1e-6) & (alpha < 0.01 - 1e-6)].mean()) < 1e-6
