"""Language identification by nearest centroid.

Normalised TF-IDF vectors of hashed letter n-grams are compared by cosine with several
centroids of each language, found by spherical k-means. A text without a letter is `und`;
one that lies outside the radius that training texts of its size keep to, by a margin, is marked rejected.
The model is fitted on at most ``sample`` labelled rows in all (whole texts), chosen by a hash of id and text and dealt
equally to the languages; prediction reads whole texts and nothing but the text.
Null and empty texts are `und` with score 0; without training rows all are `und`; repeated
rows are predicted alike and count once in the fit, rows of one id each by their own text; ties go to the first language;
very long texts are read whole, one at a time; empty tables give none; other columns are carried only on request.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ngrams import LETTERS_ONLY, blocks, carried, carrying, gram_keys, held_out, narrow, share
from tessera.session import ship, tidy

BUCKETS, ORDERS, SAMPLE, CENTROIDS = 4096, (2, 3), 3000, 4
#: Size classes of texts; the share of a class's training texts that may lie outside its radius before the margin, and that margin.
SIZES, QUANTILE, MARGIN = 13, 0.01, 0.7
LETTER = regex.compile(r"\p{L}")


def fold(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(LETTERS_ONLY) + b" "


def counts(texts: list[bytes]) -> np.ndarray:
    out = np.zeros(len(texts) * BUCKETS, np.int64)
    for key in gram_keys(texts, ORDERS, BUCKETS):
        out += np.bincount(key, minlength=len(out))
    return out.reshape(len(texts), BUCKETS)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


class Model:
    """idf, the centroids, each centroid's language, and the least cosine that a text of each size class may have."""

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, least: np.ndarray):
        self.langs, self.idf, self.centroids, self.of, self.least = langs, idf, centroids, of, least

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and whether it is too far from all."""
        c = counts(texts)
        cos = unit(np.sqrt(c).astype(np.float32) * self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(best)), best], 0, 1)
        return self.of[best], score, score < self.least[size_class(c)]


def size_class(c: np.ndarray) -> np.ndarray:
    """The binary logarithm of a text's number of different n-grams: a text of few has a small cosine with any centroid."""
    return np.minimum(np.log2(1 + (c > 0).sum(axis=1)).astype(np.int64), SIZES - 1)


def fit(rows: list[tuple[str, np.ndarray]], k: int = CENTROIDS, margin: float = MARGIN) -> Model:
    """rows: language and bucket counts, in a fixed order."""
    langs = sorted({x for x, _ in rows})
    raw = np.stack([c for _, c in rows])
    tf, sizes = np.sqrt(raw, dtype=np.float32), size_class(raw)
    del raw
    idf = (np.log((1 + len(rows)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x, y = unit(tf * idf), np.array([langs.index(a) for a, _ in rows])
    del tf
    centroids, of, own_cos = [], [], np.zeros(len(rows))
    for i in range(len(langs)):
        own = x[y == i]
        c = unit(own.mean(axis=0, keepdims=True))
        for _ in range(min(k, len(own)) - 1):  # next seed: the row furthest from all so far
            c = np.vstack([c, own[(own @ c.T).max(axis=1).argmin()]])
        for _ in range(10):
            at = (own @ c.T).argmax(axis=1)
            c = unit(np.stack([own[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))]))
        centroids.append(c)
        of += [i] * len(c)
        own_cos[y == i] = (own @ c.T).max(axis=1)
    # A class's radius: a margin under the cosine that nearly all its training texts reach; never less than that of shorter texts.
    least = np.zeros(SIZES)
    for s in range(SIZES):
        cos = own_cos[sizes == s]
        cos = cos if len(cos) >= 20 else own_cos[sizes <= s]  # too few: shorter ones as well
        least[s] = max(least[s - 1] if s else 0.0, margin * np.quantile(cos, QUANTILE) if len(cos) >= 20 else margin * own_cos.min() / 2)
    return Model(langs, idf, np.vstack(centroids).astype(np.float32), np.array(of), least)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on rows that are not held out and have a language and a letter; the sample is bounded, its counts are gathered on the driver."""
    rows = narrow(docs, "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count")).limit(sample).collect()}
    if not n:
        return None
    each = max(1, sample // len(n))
    table = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, 1.1 * each / v + 10 / v)))])

    def gather(batches):
        tidy()
        for b in batches:
            langs, ids, texts = (b.column(i).to_pylist() for i in range(3))
            for part, t in blocks(list(zip(langs, ids)), [fold(x) for x in texts]):
                c = counts(t)
                some = [np.flatnonzero(row) for row in c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in part], pa.string()), pa.array([i for _, i in part], pa.int64()), pa.array([s.astype("<u2").tobytes() for s in some], pa.binary()), pa.array([row[s].astype("<u4").tobytes() for row, s in zip(c, some)], pa.binary())], names=["lang", "doc_id", "at", "count"]
                )

    taken: dict[str, list] = {}
    chosen = rows.withColumn("tag", F.xxhash64("text")).where(share(F.col("doc_id"), F.col("tag")) < F.element_at(table, F.col("lang"))).dropDuplicates(["lang", "doc_id", "tag"])
    for r in sorted(chosen.select("lang", "doc_id", "text").mapInArrow(gather, "lang string, doc_id long, at binary, count binary").collect(), key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0, r["at"], r["count"])):
        taken.setdefault(r.lang, []).append(r)
    full = []
    for lang, rs in taken.items():
        for r in rs[:: max(1, -(-len(rs) // each))] if len(rs) > 2 * each else rs[:each]:
            c = np.zeros(BUCKETS, np.float32)
            c[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["count"], "<u4")
            full.append((lang, c))
    model = fit(full) if full else None
    del full, taken
    tidy()
    return model


def identify(docs: DataFrame, model: Model | None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each whole text, and the columns to carry."""
    ship(docs.sparkSession)
    shared, carry = docs.sparkSession.sparkContext.broadcast(model), carry or []

    def run(batches):
        tidy()
        m = shared.value
        for b in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            texts = b.column(1).to_pylist()
            lang, score, far = [], [], []
            for raw, t in blocks(texts, [fold(x) for x in texts]):
                which, cos, away = m.predict(t) if m else ([0] * len(t), np.zeros(len(t)), np.ones(len(t), bool))
                for x, w, c, a in zip(raw, which, cos, away):
                    known = m is not None and x is not None and LETTER.search(x) is not None
                    lang.append(m.langs[w] if known else "und")
                    score.append(float(c) if known else 0.0)
                    far.append(bool(a) or not known)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_()), *b.columns[2:]], names=["doc_id", "lang_pred", "score", "rejected", *carried(carry)])

    return carrying(docs, carry, run, "doc_id long, lang_pred string, score double, rejected boolean")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_language_id": op7_language_id}
ORACLE_SQL: dict[str, str] = {}
