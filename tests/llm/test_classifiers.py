import zlib

import numpy as np

from tessera.llm import langid, quality

ODD = [None, "", " ", "123 ...", "é", "the", "x" * 50_000, "漢字", "ёлка"]


def test_language_held_out(spark, sf):
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()}
    rows = langid.op7_language_id(spark, sf.replace("0.001", "0.01")).collect()
    assert {r.doc_id for r in rows} == set(true) and len(rows) == len(true)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    accuracy = np.mean([r.lang_pred == true[r.doc_id] for r in held])
    print("language accuracy", accuracy, "rejected", sum(r.rejected for r in rows))
    assert accuracy > 0.97 and np.mean([r.rejected for r in rows]) < 0.01


def test_language_rejects_far_texts(spark, sf):
    """Texts of another language, script or of noise lie outside every radius; clean held-out texts inside."""
    import random

    rng = random.Random(4)
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = langid.train(docs)
    noise = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(n))
    far = [noise("qxzkjvw", 120), noise("\u0431\u0434\u0436\u0437\u043a\u043b\u043e\u0430", 120), noise("\u0627\u0628\u062a\u062b\u062c", 150), noise("bcdfgpqx", 90)]
    got = langid.identify(spark.createDataFrame([(7, t) for t in far], "doc_id long, text string"), model).collect()
    assert all(r.rejected for r in got)
    held = docs.where("lang is not null and n_chars > 100").where(langid.held_out(docs.doc_id))
    rows = langid.identify(held, model, ["lang"]).collect()
    assert sum(not r.rejected and r.lang_pred == r.lang for r in rows) > 0.98 * len(rows)


def test_repeated_ids(spark):
    """Every row is judged by its own text; an id with very many rows does not flood the fit."""
    rows = [(5, f"good words number {i} here") for i in range(300)] + [(6, "$$ %% && ** " * (i % 4 + 1)) for i in range(300)] + [(6, "same text")] * 200
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels, sample=20)
    got = {(r.doc_id, r.text): r.score for r in quality.score(d, model, ["text"]).collect()}
    assert len(got) == len(set(rows)) and all(0 <= x <= 1 for x in got.values())
    both = spark.createDataFrame([(1, "the and of it is in the end"), (1, "der die das und ist nicht")] * 30, "doc_id long, text string").selectExpr("*", "case when text like 'the%' then 'en' else 'de' end lang")
    assert {(r.text[:3], r.lang_pred) for r in langid.identify(both, langid.train(both), ["text"]).collect()} == {("the", "en"), ("der", "de")}


def test_plain_fit():
    """The dual coordinate descent against a plain subgradient solution of the same objective."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, rng.integers(3, 9), replace=False) + (40 if i % 2 else 0) * (rng.random() < 0.8)).astype(np.int32) for i in range(60)]
    y = np.where(np.arange(60) % 2, 1, -1)
    weight, square, bias = quality.svm(rows, y, rounds=400)
    p, q = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for r, v in zip(rows, y):
        (p if v > 0 else q)[r] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    x = np.zeros((60, quality.BUCKETS))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r]
    x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((60, 1))])
    cost = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (x @ w)).sum()
    w = np.zeros(x.shape[1])
    best = cost(w)
    for k in range(1, 20_000):
        w = w - (w - (y * (y * (x @ w) < 1)) @ x) / k
        best = min(best, cost(w))
    own = np.append(np.divide(weight, ratio, out=np.zeros_like(weight), where=ratio != 0), bias)
    assert cost(own) <= best * 1.01 and np.allclose(square, ratio**2)


def test_language_edges(spark):
    rows = [(i, t, None if i % 2 else "en", 0.5, 1) for i, t in enumerate(ODD + ["the and of"] * 3)] + [(None, "a", "en", 0.5, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, rejected int")
    got = langid.identify(d, langid.train(d)).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2, 3}
    none = langid.train(d.where("lang = 'no'"))
    assert none is None and {r.lang_pred for r in langid.identify(d, none).collect()} == {"und"}
    assert langid.identify(d.limit(0), None).count() == 0


def test_quality_held_out(spark, sf):
    sf = sf.replace("0.001", "0.1")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op8_quality(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in label]
    y, s = np.array([label[r.doc_id] for r in held]), np.array([r.score for r in held])
    accuracy, auc = np.mean((s >= 0.5) == y), np.mean(s[y == 1][:, None] > s[y == 0][None])
    print("quality accuracy", accuracy, "auc", auc, "of", len(y), "share", y.mean())
    assert auc > 0.9 and accuracy > max(y.mean(), 0.9)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_edges(spark):
    d = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ODD)] + [(None, "a", 0.5), (3, "123 ...", 0.5)], "doc_id long, text string, score double")
    for rows in ([], [(0, 1, 0)], [(i, i % 2, 0) for i in range(9)] + [(3, None, 0), (None, 1, 0), (4, 0, 1), (4, 0, 1), (77, 1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, text int")
        got = quality.score(d, quality.train(d, labels)).collect()
        assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(d.limit(0), quality.fit([], np.zeros(0))).count() == 0
