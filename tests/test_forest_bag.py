"""Out-of-bag answers leave no row out."""

from tessera.operators import forest
from tests.test_learners import clusters


def test_every_row_is_answered(spark):
    rows = clusters(spark, 300)
    nodes, leaves = forest.train(rows, "id", "label", "v", trees=3, depth=3)
    got = forest.predict(rows, nodes, leaves, "id", "v", bag=True).select("id", "best", "out_of_bag").distinct().collect()
    every = forest.predict(rows, nodes, leaves, "id", "v").select("id", "best").distinct().collect()
    whole = {r.id: r.best for r in every}
    inside = {r.id for r in got if not r.out_of_bag}
    assert sorted(r.id for r in got) == list(range(300)) and 0 < len(inside) < 300
    weights = rows.select("id", *[forest.poisson(rows.id, forest.F.lit(t)).alias(f"w{t}") for t in range(3)]).collect()
    assert inside == {r.id for r in weights if r.w0 and r.w1 and r.w2}
    assert all(r.best == whole[r.id] for r in got if r.id in inside)
