"""Dirichlet-process mixtures of full Gaussians by truncated variational inference.

A round is one pass: each task sends one row of sufficient statistics for each component and
batch, which merge by component; the driver holds the components only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.distributions import Prior, prior_from, student_log_pdf
from tessera.functions.special import digamma
from tessera.operators.density import MOST_ROUNDS


@dataclass
class Model:
    prior: Prior
    parts: list[Prior]
    sticks: np.ndarray  # (components, 2): Beta parameters
    concentration: float

    def log_sticks(self) -> np.ndarray:
        """Expected log weights."""
        both = digamma(self.sticks.sum(1))
        v, rest = digamma(self.sticks[:, 0]) - both, digamma(self.sticks[:, 1]) - both
        return v + np.concatenate([[0], np.cumsum(rest)[:-1]])

    def weights(self) -> np.ndarray:
        """Expected weights, the last for what no component holds."""
        v = self.sticks[:, 0] / self.sticks.sum(1)
        left = np.concatenate([[1], np.cumprod(1 - v)])
        return np.append(v * left[:-1], left[-1])

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Responsibilities (rows, components)."""
        d, out = x.shape[1], np.empty((len(x), len(self.parts)))
        for i, (p, w) in enumerate(zip(self.parts, self.log_sticks())):
            c = np.linalg.cholesky(p.scatter)
            z = np.linalg.solve(c, (x - p.mean).T)
            log_det = digamma((p.dof - np.arange(d)) / 2).sum() + d * np.log(2) - 2 * np.log(np.diag(c)).sum()
            out[:, i] = w + 0.5 * log_det - 0.5 * (d / p.k + p.dof * (z * z).sum(0))
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def log_terms(self, x: np.ndarray) -> np.ndarray:
        """Log weight times density of each component and of a new one."""
        return np.stack([np.log(max(w, 1e-300)) + student_log_pdf(x, *p.predictive()) for w, p in zip(self.weights(), [*self.parts, self.prior])], axis=1)


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in pdf["v"]])


def _vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    return rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))


def _statistics(data: DataFrame, shares, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, sums, squares) by component; shares: rows -> responsibilities."""

    def step(batches):
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf)
                r = shares(x)
                s = np.concatenate([r.sum(0)[:, None], r.T @ x, np.einsum("nk,ni,nj->kij", r, x, x, optimize=True).reshape(k, -1)], axis=1)
                yield pd.DataFrame({"k": np.arange(k), "s": list(s)})

    sent = data.mapInPandas(step, "k int, s array<double>").select("k", F.posexplode("s").alias("i", "s"))
    got = sent.groupBy("k", "i").agg(F.sum("s").alias("s")).toPandas()  # components * (1 + d + d * d) rows
    out = np.zeros((k, 1 + d + d * d))
    out[got["k"], got["i"]] = got["s"]
    return out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(k, d, d)


def _update(prior: Prior, stats, concentration: float) -> Model:
    n, sums, squares = stats
    order = np.argsort(-n, kind="stable")  # large components come first on the stick
    n, sums, squares = n[order], sums[order], squares[order]
    after = np.concatenate([np.cumsum(n[::-1])[::-1][1:], [0]])
    sticks = np.stack([1 + n, concentration + after], axis=1)
    rest = digamma(sticks[:, 1]) - digamma(sticks.sum(1))
    return Model(prior, [prior.update(a, b, c) for a, b, c in zip(n, sums, squares)], sticks, len(n) / (1 - rest.sum()))


def fit(rows: DataFrame, id_col: str, vector: str, components: int = 8, rounds: int | None = None, tol: float = 1e-3, prior: Prior | None = None) -> Model:
    """A mixture of at most this many components; those that the data do not need end with hardly any weight. Rounds go on until no component's size changes by tol of all rows; a bound of MOST_ROUNDS raises, a number of rounds given does not. Rows without a vector are left out; at least one row is needed."""
    data = _vectors(rows, id_col, vector)
    start = [np.array(r["v"]) for r in data.orderBy(F.xxhash64("id"), "id").limit(components).collect()]
    if not start:
        raise ValueError("a mixture needs a row")
    d = len(start[0])
    if prior is None:
        n, s, q = _statistics(data, lambda x: np.ones((len(x), 1)), 1, d)
        prior = prior_from(n[0], s[0], q[0])
    seeds = np.stack(start)
    scale = np.sqrt(np.diag(prior.scatter) / prior.dof)

    def nearest(x):
        z = (((x[:, None] - seeds) / scale) ** 2).sum(2)
        return (z.argmin(1)[:, None] == np.arange(len(seeds))).astype(float)

    model = _update(prior, _statistics(data, nearest, len(seeds), d), 1.0)
    before = None
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        model = _update(prior, _statistics(data, model.shares, len(model.parts), d), model.concentration)
        n = model.sticks[:, 0] - 1
        if before is not None and np.abs(n - before).max() < tol * max(n.sum(), 1):
            break
        before = n
    else:
        if rounds is None:
            raise RuntimeError(f"the mixture is not at rest after {MOST_ROUNDS} rounds")
    return model


def density(rows: DataFrame, model: Model, id_col: str, vector: str) -> DataFrame:
    """(id, log_p, shares, component): log density, posterior of each component and last of a new one, and the likeliest."""

    def score(batches):
        for pdf in batches:
            if len(pdf):
                t = model.log_terms(_matrix(pdf))
                top = t.max(1, keepdims=True)
                e = np.exp(t - top)
                yield pd.DataFrame({"id": pdf["id"], "log_p": np.log(e.sum(1)) + top[:, 0], "shares": list(e / e.sum(1, keepdims=True)), "component": t.argmax(1)})

    data = _vectors(rows, id_col, vector)
    return data.mapInPandas(score, f"id {dict(data.dtypes)['id']}, log_p double, shares array<double>, component int")


def nll(rows: DataFrame, model: Model, id_col: str, vector: str) -> float:
    return -(density(rows, model, id_col, vector).agg(F.sum("log_p")).first()[0] or 0.0)


def fit_growing(rows: DataFrame, id_col: str, vector: str, most: int = 32, rounds: int | None = None) -> Model:
    """Adds components until the likelihood no longer improves."""
    best, least = None, np.inf
    for k in range(1, most + 1):
        model = fit(rows, id_col, vector, k, rounds)
        cost = nll(rows, model, id_col, vector)
        if cost >= least:
            break
        best, least = model, cost
    return best


def sample(model: Model, rng: np.random.Generator, n: int) -> np.ndarray:
    """Draws from the expected mixture."""
    which = rng.choice(len(model.parts) + 1, size=n, p=model.weights() / model.weights().sum())
    out = np.empty((n, len(model.prior.mean)))
    for i, p in enumerate([*model.parts, model.prior]):
        dof, loc, scale = p.predictive()
        at = np.flatnonzero(which == i)
        z = rng.standard_normal((len(at), len(loc))) @ np.linalg.cholesky(scale).T
        out[at] = loc + z / np.sqrt(rng.chisquare(dof, len(at)) / dof)[:, None]
    return out
