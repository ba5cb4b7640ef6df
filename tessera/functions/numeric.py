"""Numeric helpers for the workers: Bessel functions, ordered eigenvectors, spline weights, counter-based random numbers, rotations."""

from __future__ import annotations

import math

import numpy as np

from tessera.functions.special import log_gamma


def log_bessel(order: float, x: float, terms: int = 500) -> float:
    """log I_order(x) of the modified Bessel function of the first kind: its power series summed in logarithms, or for large x its asymptotic expansion."""
    if x <= 0:
        return 0.0 if order == 0 else -math.inf
    if x > 200 and x > 4 * order * order:
        mu, term, total = 4 * order * order, 1.0, 1.0
        for k in range(1, 30):
            step = -(mu - (2 * k - 1) ** 2) / (k * 8 * x)
            if abs(step) >= 1:
                break
            term *= step
            total += term
        return x - 0.5 * math.log(2 * math.pi * x) + math.log(total)
    k = np.arange(max(terms, int(2 * x)))
    t = (2 * k + order) * math.log(x / 2) - log_gamma(k + 1.0) - log_gamma(k + order + 1.0)
    return float(t.max() + np.log(np.exp(t - t.max()).sum()))


def sorted_eigen(m: np.ndarray, by_size: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a symmetric matrix, ascending, or by absolute value."""
    value, vector = np.linalg.eigh(m)
    order = np.argsort(np.abs(value), kind="stable") if by_size else np.arange(len(value))
    return value[order], vector[:, order]


def spline_weights(t: float, degree: int) -> np.ndarray:
    """Weights of the degree + 1 knots around a point with fraction t from 0 to 1, by the recursion of uniform B-splines."""
    w = np.ones(1)
    for d in range(1, degree + 1):
        new = np.zeros(d + 1)
        for i in range(d):
            new[i] += w[i] * (1 + i - t) / d
            new[i + 1] += w[i] * (t + d - 1 - i) / d
        w = new
    return w


def philox(counter: np.ndarray, key: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Four random 32-bit words for each counter (n, 4) and key (n, 2): the same for the same input on any machine."""
    c, k = np.array(counter, np.uint64).reshape(-1, 4).copy(), np.array(key, np.uint64).reshape(-1, 2).copy()
    low = np.uint64(0xFFFFFFFF)
    for _ in range(rounds):
        # Fixed values of the published generator.
        p, q = c[:, 0] * np.uint64(0xD2511F53), c[:, 2] * np.uint64(0xCD9E8D57)
        c = np.stack([(q >> np.uint64(32)) ^ c[:, 1] ^ k[:, 0], q & low, (p >> np.uint64(32)) ^ c[:, 3] ^ k[:, 1], p & low], axis=1)
        k = (k + np.array([0x9E3779B9, 0xBB67AE85], np.uint64)) & low
    return c.astype(np.uint32)


def uniform(words: np.ndarray) -> np.ndarray:
    """Random words as numbers from 0 to 1, 1 left out."""
    return words.astype(np.float64) / 4294967296.0


def euler_to_versor(angles: np.ndarray) -> np.ndarray:
    """Rotations about x, then z, then y by the angles (x, z, y) as unit quaternions (x, y, z, w)."""
    a = np.asarray(angles, float) / 2
    (sx, sz, sy), (cx, cz, cy) = np.moveaxis(np.sin(a), -1, 0), np.moveaxis(np.cos(a), -1, 0)
    return np.stack([sy * sz * cx + cy * cz * sx, sy * cz * cx + cy * sz * sx, cy * sz * cx - sy * cz * sx, cy * cz * cx - sy * sz * sx], axis=-1)


def versor_to_euler(q: np.ndarray) -> np.ndarray:
    """The angles (x, z, y) of unit quaternions (x, y, z, w)."""
    x, y, z, w = np.moveaxis(np.asarray(q, float), -1, 0)
    bank = np.arctan2(2 * (x * w - y * z), 1 - 2 * (x * x + z * z))
    return np.stack([bank, np.arcsin(np.clip(2 * (x * y + z * w), -1, 1)), np.arctan2(2 * (y * w - x * z), 1 - 2 * (y * y + z * z))], axis=-1)


def topological_order(edges: list[tuple[str, str]], nodes: list[str]) -> list[str]:
    """Nodes so that each comes after those it depends on; edges: (node, what it depends on). A cycle raises."""
    needs = {n: {b for a, b in edges if a == n} for n in nodes}
    out: list[str] = []
    while needs:
        ready = sorted(n for n, s in needs.items() if not s - set(out))
        if not ready:
            raise ValueError("the graph has a cycle")
        out += ready
        for n in ready:
            del needs[n]
    return out
