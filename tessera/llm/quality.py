"""Quality classifier: a naive Bayes support vector machine.

Indicators of hashed byte n-grams are scaled by the log-count ratio of the classes, each
text's vector is brought to length one, and a linear hinge-loss model is fitted by dual
coordinate descent; a sigmoid fitted on held-out halves turns margins into scores. The fit takes at
most ``sample`` labelled rows (whole texts) chosen by a hash of the id, in expectation; scoring reads whole texts and
nothing else. Null and empty texts score by the model's constant alone. Repeated labels
of an id are averaged; an id with several texts labels each of them, and each row is scored by its own text.
Without labels the score is 0.5, with one class that class's smoothed share. Empty tables give none; other
columns are carried only on request, under whatever name they have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ngrams import blocks, carried, carrying, gram_keys, held_out, narrow, share
from tessera.session import ship, tidy

BUCKETS, ORDERS, SAMPLE = 1 << 14, (1, 2, 3, 4), 5000


def present(texts: list[bytes]) -> np.ndarray:
    """Which n-gram buckets each text has; one more column that all have."""
    out = np.zeros(len(texts) * BUCKETS, bool)
    for key in gram_keys(texts, ORDERS, BUCKETS):
        out[key] = True
    return out.reshape(len(texts), BUCKETS)


class Model:
    """Margins are (present @ weight) / sqrt(present @ square) + bias; scores their sigmoid."""

    def __init__(self, weight: np.ndarray, square: np.ndarray, bias: float, slope: float, shift: float):
        self.weight, self.square, self.bias, self.slope, self.shift = weight.astype(np.float32), square.astype(np.float32), bias, slope, shift

    def margin(self, x: np.ndarray) -> np.ndarray:
        got = x.astype(np.float32) @ np.stack([self.weight, self.square], axis=1)
        return got[:, 0] / np.sqrt(np.maximum(got[:, 1], 1e-9)) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x).astype(np.float64) + self.shift, -500, 500)))


def svm(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights for indicators (rows: the buckets that each text has), the squares for their lengths, and the constant: hinge loss by dual coordinate descent."""
    p, q = np.ones(BUCKETS), np.ones(BUCKETS)
    for r, v in zip(rows, y):
        (p if v > 0 else q)[r] += 1
    r = np.log((p / p.sum()) / (q / q.sum()))
    values = [(r[i] / max(np.linalg.norm(r[i]), 1e-9)).astype(np.float32) for i in rows]
    w, bias, alpha, order = np.zeros(BUCKETS), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    norm = np.array([float(v @ v) + 1 for v in values])  # the constant is a feature of its own
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            g = y[i] * (values[i] @ w[rows[i]] + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w * r, r * r, bias


def fit(rows: list[np.ndarray], quality: np.ndarray) -> Model:
    y = np.where(quality > 0, 1, -1)
    zero = np.zeros(BUCKETS)
    if len(y) == 0 or abs(y.sum()) == len(y):
        good = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(zero, zero + 1, 0.0, 1.0, float(np.log(good / (1 - good))))
    margin = np.zeros(len(y))
    for half in (0, 1):
        part = np.arange(len(y)) % 2 == half
        if abs(y[part].sum()) == part.sum():
            margin = y * 1.0
            break
        w, square, bias = svm([r for r, own in zip(rows, part) if own], y[part])
        margin[~part] = [w[r].sum() / np.sqrt(max(square[r].sum(), 1e-9)) + bias for r, own in zip(rows, part) if not own]
    # A sigmoid by Newton steps; targets are smoothed so that it stays finite.
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    design, ab = np.stack([margin, np.ones(len(y))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(design @ ab, -30, 30)))
        ab = ab - np.linalg.solve(design.T @ (design * (s * (1 - s))[:, None]) + 1e-3 * np.eye(2), design.T @ (s - target))
    return Model(*svm(rows, y), *map(float, ab))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on labelled rows that are not held out, about ``sample`` at most; labels are drawn by id and broadcast, so that texts are not shuffled, and of an id with very many rows only a share by text is taken."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("q")).where(F.col("q").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.count()
    chosen = F.broadcast(known.where(share(F.col("doc_id")) < F.lit(min(1.0, sample / max(n, 1)))).groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("q")).limit(2 * sample))
    rows = narrow(docs, "text").join(chosen, "doc_id").select("doc_id", "q", "text")
    found = rows.count()
    if found > 2 * sample:
        rows = rows.withColumn("tag", F.xxhash64("text")).where(share(F.col("doc_id"), F.col("tag")) < F.lit(sample / found)).dropDuplicates(["doc_id", "tag"]).drop("tag")

    def gather(batches):
        tidy()
        for b in batches:
            ids, q, texts = (b.column(i).to_pylist() for i in range(3))
            for part, t in blocks(list(zip(ids, q)), [(x or "").encode("utf-8", "replace") for x in texts]):
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([v for _, v in part], pa.int32()), pa.array([row.tobytes() for row in np.packbits(present(t), axis=1)], pa.binary())], names=["doc_id", "q", "bits"])

    got = rows.mapInArrow(gather, "doc_id long, q int, bits binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.bits))
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), count=BUCKETS)).astype(np.int32) for r in got]
    got = np.array([r.q for r in got])
    tidy()
    model = fit(rows, got)
    del rows
    tidy()
    return model


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """doc_id, score of each whole text, and the columns to carry."""
    ship(docs.sparkSession)
    shared, carry = docs.sparkSession.sparkContext.broadcast(model), carry or []

    def run(batches):
        tidy()
        m = shared.value
        for b in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            texts = [(x or "").encode("utf-8", "replace") for x in b.column(1).to_pylist()]
            s = [m.score(present(t)) for _, t in blocks(texts, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.zeros(0), *s]), pa.float64()), *b.columns[2:]], names=["doc_id", "score", *carried(carry)])

    return carrying(docs, carry, run, "doc_id long, score double")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL: dict[str, str] = {}
