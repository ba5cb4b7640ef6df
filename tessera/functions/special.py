"""Special functions in numpy, for solvers inside grouped UDFs."""

from __future__ import annotations

import numpy as np


def _shift(z, terms: int = 8):
    z = np.asarray(z, float)
    return z, z + terms, np.arange(terms)


def digamma(z):
    """Recurrence up to z + 8, then the asymptotic series; z > 0."""
    z, y, k = _shift(z)
    i = 1 / (y * y)
    return np.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132)))) - (1 / (z[..., None] + k)).sum(-1)


def trigamma(z):
    z, y, k = _shift(z)
    i = 1 / (y * y)
    return 1 / y + i / 2 + i / y * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30))) + (1 / (z[..., None] + k) ** 2).sum(-1)


def log_gamma(z):
    z, y, k = _shift(z)
    i = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / y - np.log(z[..., None] + k).sum(-1)
