"""Multivariate Gaussians, Student's t and Wishart matrices, with the conjugate prior that joins them (numpy)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tessera.functions.special import log_gamma


def _half_log_det(m: np.ndarray) -> tuple[np.ndarray, float]:
    c = np.linalg.cholesky(m)
    return c, float(np.log(np.diag(c)).sum())


def gaussian_log_pdf(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Rows of x."""
    c, half = _half_log_det(cov)
    z = np.linalg.solve(c, (np.atleast_2d(x) - mean).T)
    return -0.5 * (z * z).sum(0) - half - len(mean) / 2 * np.log(2 * np.pi)


def gaussian_draw(rng: np.random.Generator, mean: np.ndarray, cov: np.ndarray, n: int) -> np.ndarray:
    return mean + rng.standard_normal((n, len(mean))) @ np.linalg.cholesky(cov).T


def student_log_pdf(x: np.ndarray, dof: float, loc: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows of x under a multivariate t with the given scale matrix."""
    d = len(loc)
    c, half = _half_log_det(scale)
    z = np.linalg.solve(c, (np.atleast_2d(x) - loc).T)
    norm = log_gamma((dof + d) / 2) - log_gamma(dof / 2) - d / 2 * np.log(dof * np.pi) - half
    return norm - (dof + d) / 2 * np.log1p((z * z).sum(0) / dof)


def wishart_log_pdf(m: np.ndarray, dof: float, scale: np.ndarray) -> float:
    d = len(scale)
    _, half_m = _half_log_det(m)
    _, half_s = _half_log_det(scale)
    gammas = d * (d - 1) / 4 * np.log(np.pi) + float(log_gamma((dof - np.arange(d)) / 2).sum())
    return float((dof - d - 1) * half_m - np.trace(np.linalg.solve(scale, m)) / 2 - dof * d / 2 * np.log(2) - dof * half_s - gammas)


def wishart_draw(rng: np.random.Generator, dof: float, scale: np.ndarray) -> np.ndarray:
    d = len(scale)
    a = np.tril(rng.standard_normal((d, d)), -1)
    a[np.diag_indices(d)] = np.sqrt(rng.chisquare(dof - np.arange(d)))
    b = np.linalg.cholesky(scale) @ a
    return b @ b.T


@dataclass
class Prior:
    """Normal and inverse Wishart: mean with `k` pseudo-rows, scatter matrix with `dof`."""

    mean: np.ndarray
    k: float
    scatter: np.ndarray
    dof: float

    def update(self, n: float, sums: np.ndarray, squares: np.ndarray) -> Prior:
        """After rows with count n, sum and sum of outer products: statistics that merge in any order."""
        if n <= 0:
            return self
        mean = sums / n
        return self.absorb(n, mean, squares - n * np.outer(mean, mean))

    def absorb(self, n: float, mean: np.ndarray, scatter: np.ndarray) -> Prior:
        """After rows with count n, mean and scatter around that mean: no raw moments are subtracted, so values far from zero lose no digits."""
        if n <= 0:
            return self
        k, away = self.k + n, mean - self.mean
        s = self.scatter + scatter + self.k * n / k * np.outer(away, away)
        return Prior(self.mean + n / k * away, k, (s + s.T) / 2, self.dof + n)

    def remove(self, row: np.ndarray) -> Prior:
        """Before a row was absorbed."""
        k = self.k - 1
        mean = (self.k * self.mean - row) / k
        away = row - mean
        s = self.scatter - k / self.k * np.outer(away, away)
        return Prior(mean, k, (s + s.T) / 2, self.dof - 1)

    def merge(self, other: Prior, base: Prior) -> Prior:
        """All rows of two that grew from one base, which counts once."""
        n = other.k - base.k
        if n <= 0:
            return self
        mean = (other.k * other.mean - base.k * base.mean) / n
        away = mean - base.mean
        return self.absorb(n, mean, other.scatter - base.scatter - base.k * n / other.k * np.outer(away, away))

    def reweight(self, k: float, dof: float | None = None) -> Prior:
        """The same mean and expected covariance with the weight of so many rows."""
        dof = k if dof is None else dof
        return Prior(self.mean.copy(), k, self.scatter * dof / self.dof, dof)

    def safe(self, floor: float = 1e-12) -> Prior:
        """A scatter matrix made positive definite by raising its eigenvalues."""
        value, vector = np.linalg.eigh((self.scatter + self.scatter.T) / 2)
        return Prior(self.mean, self.k, (vector * np.maximum(value, floor)) @ vector.T, max(self.dof, len(self.mean)))

    def predictive(self) -> tuple[float, np.ndarray, np.ndarray]:
        """(dof, location, scale) of the t of a new row."""
        dof = self.dof - len(self.mean) + 1
        return dof, self.mean, self.scatter * (self.k + 1) / (self.k * dof)


def prior_from(n: float, sums: np.ndarray, squares: np.ndarray, weight: float = 1.0, floor: float = 1e-6) -> Prior:
    """Weak prior with the data's mean and covariance; variances are floored so that it stays proper."""
    d = len(sums)
    mean = sums / max(n, 1)
    cov = squares / max(n, 1) - np.outer(mean, mean) + floor * np.eye(d)
    return Prior(mean, weight, cov * (d + 1 + weight), d + 1 + weight)
