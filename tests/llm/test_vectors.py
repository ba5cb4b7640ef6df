import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vectors
from tessera.llm.graph import components

NAN, INF = float("nan"), float("inf")


def brute_components(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_links(rows, limit=0.98):
    ok = [r for r in rows if r[2] is not None and r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, pairs = {r[0]: 0 for r in rows}, []
    for key in {(r[2], len(r[1])) for r in ok}:
        part = [r for r in ok if (r[2], len(r[1])) == key]
        v = np.array([r[1] for r in part], float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(v @ v.T >= limit, 1))
        for i, j in zip(a, b):
            pairs.append((part[i][0], part[j][0]))
            links[part[i][0]] += 1
            links[part[j][0]] += 1
    return links, brute_components(list(links), pairs)


@pytest.mark.parametrize("size", ["sf0.01", "check_s"])
def test_near_duplicates(spark, sf, size):
    sf = sf.replace("sf0.001", size)
    if not os.path.exists(sf):
        pytest.skip("no such table")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    links, comp = brute_links(rows)
    got = {r.vec_id: r for r in vectors.op5_embedding_dedup(spark, sf).collect()}
    assert set(got) == set(links)
    print("found", sum(r.n_links for r in got.values()), "of", sum(links.values()))
    assert all(got[i].n_links == links[i] and got[i].component_id == comp[i] and got[i].kept == (comp[i] == i) for i in links)


def odd_rows():
    rng = np.random.default_rng(0)
    hot = rng.standard_normal(16)
    rows = [(i, (hot + 0.01 * rng.standard_normal(16)).tolist(), 1) for i in range(1200)]  # more than a block
    rows += [(2000 + i, hot.tolist(), 1) for i in range(300)] + [(3000, hot.tolist(), 2), (3001, (2 * hot).tolist(), 2), (3002, (-hot).tolist(), 2), (3003, hot.tolist(), None)]
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * 16, 1), (4003, [NAN] + [1.0] * 15, 1), (4004, [INF] * 16, 1), (4005, [None] + [1.0] * 15, 1), (4006, hot.tolist()[:8], 1), (4007, hot.tolist()[:8], 1), (4008, [1.0], 1), (4009, [3.0], 1)]
    return rows


def test_near_duplicate_edges(spark):
    rows = odd_rows()
    links, comp = brute_links(rows)
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n int, cell string")
    got = {r.vec_id: r for r in vectors.near_duplicates(d).collect()}
    assert set(got) == set(links)
    assert all((got[i].n_links, got[i].component_id) == (links[i], comp[i]) for i in links)
    assert vectors.near_duplicates(d.limit(0)).count() == 0


def brute_nearest(rows, queries, k=20):
    ok = [r for r in rows if r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    out = {}
    for q in ok:
        if q[0] in queries:
            same = [r for r in ok if len(r[1]) == len(q[1]) and r[0] != q[0]]
            s = np.array([r[1] for r in same], float).reshape(len(same), -1) @ np.array(q[1], float)
            order = sorted(range(len(same)), key=lambda i: (-s[i], same[i][0]))[:k]
            out[q[0]] = [(same[i][0], s[i]) for i in order]
    return out


def recall(got, want):
    hit = total = 0
    for q, ns in want.items():
        found = got.get(q, [])
        assert [r.rank for r in found] == list(range(1, len(ns) + 1))
        assert all((-x.score, x.vec_id) < (-y.score, y.vec_id) for x, y in zip(found, found[1:]))
        hit += len({v for v, _ in ns} & {r.vec_id for r in found})
        total += len(ns)
    return hit / total


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r)
    return out


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_nearest(spark, sf, size):
    sf = sf.replace("0.001", size)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_nearest(rows, {r[0] for r in rows if r[0] % 20 == 0})
    got = by_query(vectors.op9_nearest(spark, sf).collect())
    assert set(got) == set(want)
    print("recall", recall(got, want))
    assert recall(got, want) >= 0.9
    vec = {r[0]: np.array(r[1], float) for r in rows}
    assert all(abs(r.score - vec[q] @ vec[r.vec_id]) < 1e-12 for q, rs in got.items() for r in rs)


def test_nearest_edges(spark):
    rows = [r[:2] for r in odd_rows()]
    want = brute_nearest(rows, {r[0] for r in rows if r[0] % 100 == 0 or r[0] > 3999})
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, list int, v string")
    got = by_query(vectors.nearest(d, (F.col("vec_id") % 100 == 0) | (F.col("vec_id") > 3999)).collect())
    assert recall(got, want) >= 0.9 and [r.vec_id for r in got[2000]] == [v for v, _ in want[2000]]
    assert vectors.nearest(d.limit(0), F.col("vec_id") > 0).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(100, 200)] + [(7, i) for i in range(300, 400)] + [tuple(map(int, rng.integers(1000, 1400, 2))) for _ in range(200)] + [(5, 5), (100, 99)]
    want = brute_components({x for p in pairs for x in p}, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in want} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_with_one_id(spark):
    """An id on several vectors: each row is a node of its own, and a row without a partner has no links."""
    rng = np.random.default_rng(8)
    a, b, c = rng.standard_normal((3, 16))
    near = lambda v: (v + 0.005 * rng.standard_normal(16)).tolist()
    rows = [(5, a.tolist(), 1), (5, b.tolist(), 1), (7, near(b), 1), (9, near(a), 1), (9, c.tolist(), 1), (9, c.tolist(), 1), (3, near(c), 2), (2, near(c), 1), (None, a.tolist(), 1), (5, a.tolist(), 1)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, row int, rep int").repartition(3)
    links, comp = brute_links([(i, v, k if r[0] is not None else None) for i, (r, v, k) in enumerate((r, r[1], r[2]) for r in rows)])
    least: dict = {}
    for i, r in enumerate(rows):
        least.setdefault(comp[i], []).append(r[0])
    want = sorted([(r[0], links[i], min(least[comp[i]], key=lambda x: (x is None, x))) for i, r in enumerate(rows)], key=repr)
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(d).collect()], key=repr) == want
    got = by_query(vectors.nearest(d, F.col("vec_id") == 9).collect())
    assert {r.vec_id for r in got[9]} == {2, 3, 5, 7}


def test_too_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(vectors, "DIMS", 2)
    d = spark.createDataFrame([(i, [1.0] * (i + 1)) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        vectors.nearest(d, F.col("vec_id") == 0)
    assert vectors.nearest(d.limit(2), F.col("vec_id") >= 0).count() == 0


def test_blocks_of_queries(spark, sf, monkeypatch):
    """Small groups and blocks give the same rows; postings go out once for each block of a hot group's queries, not of all queries."""
    table = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/embeddings.parquet")
    want = sorted(map(tuple, vectors.nearest(table, F.col("vec_id") % 5 == 0).collect()))
    monkeypatch.setattr(vectors, "GROUP_ROWS", 300)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 40)
    got = sorted(map(tuple, vectors.nearest(table, F.col("vec_id") % 5 == 0).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_share_of_lists(spark):
    """Clustered vectors: a fifth of the lists at most is walked to and few are read, and nearly all neighbours are found."""
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((40, 24)) * 3
    rows = [(i, (centers[i % 40] + rng.standard_normal(24)).tolist()) for i in range(6000)]
    want = brute_nearest(rows, {r[0] for r in rows if r[0] % 100 == 0})
    got = by_query(vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect())
    assert recall(got, want) >= 0.95
