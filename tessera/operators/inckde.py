"""Incremental kernel density with a bounded number of kernels, and a classifier with one density for each class.

A density above its cap merges the two kernels whose moment-matched union costs the least.
Merging is defined for weighted kernels, so tasks build partial densities of their own rows
and one small group for each class merges these: no class is gathered into one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.distributions import gaussian_log_pdf


class IncrementalKDE:
    """Weighted Gaussians: every row adds a kernel with the given covariance."""

    def __init__(self, cov: np.ndarray, cap: int = 32):
        d = len(cov)
        self.kernel, self.cap = np.asarray(cov, float), cap
        self.w, self.mean, self.cov = np.zeros(0), np.zeros((0, d)), np.zeros((0, d, d))

    def add(self, x: np.ndarray, weight: float = 1.0, cov: np.ndarray | None = None) -> None:
        self.w = np.append(self.w, weight)
        self.mean = np.concatenate([self.mean, np.asarray(x, float)[None]])
        self.cov = np.concatenate([self.cov, (self.kernel if cov is None else np.asarray(cov, float))[None]])
        if len(self.w) > self.cap:
            self._merge()

    def _union(self, i, j):
        w = self.w[i] + self.w[j]
        a = (self.w[i] / w)[..., None]
        mean = a * self.mean[i] + (1 - a) * self.mean[j]
        gap = self.mean[i] - self.mean[j]
        a = a[..., None]
        return w, mean, a * self.cov[i] + (1 - a) * self.cov[j] + a * (1 - a) * gap[..., :, None] * gap[..., None, :]

    def _merge(self) -> None:
        i, j = np.triu_indices(len(self.w), 1)
        w, _, cov = self._union(i, j)
        logdet = np.linalg.slogdet(self.cov)[1]
        cost = w * np.linalg.slogdet(cov)[1] - self.w[i] * logdet[i] - self.w[j] * logdet[j]
        best = int(cost.argmin())
        a, b = i[best], j[best]
        self.w[a], self.mean[a], self.cov[a] = self._union(np.array(a), np.array(b))
        self.w, self.mean, self.cov = (np.delete(v, b, axis=0) for v in (self.w, self.mean, self.cov))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        if not len(self.w):
            return np.full(len(x), -np.inf)
        t = np.stack([np.log(w / self.w.sum()) + gaussian_log_pdf(x, m, c) for w, m, c in zip(self.w, self.mean, self.cov)])
        top = t.max(0)
        return top + np.log(np.exp(t - top).sum(0))

    def marginal(self, dims: list[int]) -> IncrementalKDE:
        out = IncrementalKDE(self.kernel[np.ix_(dims, dims)], self.cap)
        out.w, out.mean, out.cov = self.w.copy(), self.mean[:, dims], self.cov[:, dims][:, :, dims]
        return out

    def rows(self, label) -> pd.DataFrame:
        return pd.DataFrame({"label": label, "w": self.w, "mean": list(self.mean), "cov": [c.ravel() for c in self.cov]})


#: Parts that a class is fitted in before they are merged; fixed, so that the result does not depend on the cluster.
BUCKETS = 64


def fit(rows: DataFrame, label: str, vector: str, cov: np.ndarray, cap: int = 32) -> DataFrame:
    """(label, w, mean, cov): at most `cap` kernels of each class; rows without label or vector are left out."""
    data = rows.select(F.col(label).cast("long").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("label is not null and v is not null")
    schema = "label long, w double, mean array<double>, cov array<double>"
    d = len(cov)

    def partial(batches):
        """Rows come sorted by label, bucket and vector: one model at a time, the same however the table was dealt."""
        key, m = None, None
        for pdf in batches:
            for c, b, v in zip(pdf["label"], pdf["bucket"], pdf["v"]):
                if (c, b) != key:
                    if m is not None:
                        yield m.rows(int(key[0]))
                    key, m = (c, b), IncrementalKDE(cov, cap)
                m.add(np.asarray(v))
        if m is not None:
            yield m.rows(int(key[0]))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        m = IncrementalKDE(cov, cap)
        order = sorted(range(len(pdf)), key=lambda i: (tuple(pdf["mean"].iloc[i]), pdf["w"].iloc[i], tuple(pdf["cov"].iloc[i])))
        for i in order:
            m.add(pdf["mean"].iloc[i], pdf["w"].iloc[i], np.reshape(pdf["cov"].iloc[i], (d, d)))
        return m.rows(int(pdf["label"].iloc[0]))

    dealt = data.withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(BUCKETS))).repartition("label", "bucket").sortWithinPartitions("label", "bucket", "v")
    return dealt.mapInPandas(partial, schema).groupBy("label").applyInPandas(merge, schema)


def classify(rows: DataFrame, model: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, best, log_p): the class of greatest weight times density; the model has `cap` rows a class."""
    got = model.toPandas()
    total = got["w"].sum()
    parts = []
    for c, g in got.groupby("label"):
        d = len(g["mean"].iloc[0])
        m = IncrementalKDE(np.eye(d), len(g))
        m.w, m.mean, m.cov = g["w"].to_numpy(), np.stack(g["mean"]), np.stack([np.reshape(x, (d, d)) for x in g["cov"]])
        parts.append((int(c), float(np.log(g["w"].sum() / total)), m))

    def score(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.asarray(v, float) for v in pdf["v"]])
                t = np.stack([p + m.log_density(x) for _, p, m in parts])
                yield pd.DataFrame({"id": pdf["id"], "best": np.array([c for c, _, _ in parts])[t.argmax(0)], "log_p": t.max(0)})

    data = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return data.mapInPandas(score, f"id {dict(data.dtypes)['id']}, best long, log_p double")
