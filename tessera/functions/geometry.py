"""Homographies on (x, y, 1) and thin-plate splines (numpy; fits are small, evaluation is by rows)."""

from __future__ import annotations

import math

import numpy as np


def translate(dx: float, dy: float) -> np.ndarray:
    return np.array([[1.0, 0, dx], [0, 1, dy], [0, 0, 1]])


def rotate(angle: float) -> np.ndarray:
    c, s = math.cos(angle), math.sin(angle)
    return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])


def scale(amount: float) -> np.ndarray:
    return np.diag([amount, amount, 1.0])


def apply(hg: np.ndarray, points: np.ndarray) -> np.ndarray:
    h = np.c_[points, np.ones(len(points))] @ np.asarray(hg).T
    return h[:, :2] / h[:, 2:]


def match(source: np.ndarray, dest: np.ndarray) -> np.ndarray:
    """The homography that takes four or more points to their partners (least squares beyond four)."""
    rows = []
    for (x, y), (u, v) in zip(source, dest, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows, float))[2][-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def bounds(hg: np.ndarray, lower, upper) -> tuple[np.ndarray, np.ndarray]:
    """The box around a rectangle's projected corners."""
    corners = apply(hg, np.array([(x, y) for x in (lower[0], upper[0]) for y in (lower[1], upper[1])], float))
    return corners.min(0), corners.max(0)


def fit(hg: np.ndarray, height: int, width: int) -> tuple[np.ndarray, tuple[int, int]]:
    """The homography moved so that an image's projection starts at the origin, and the size (height, width) that holds it."""
    low, high = bounds(hg, (0, 0), (width - 1, height - 1))
    size = np.ceil(high - low - 1e-9).astype(int) + 1
    return translate(-low[0], -low[1]) @ hg, (int(size[1]), int(size[0]))


class ThinPlate:
    """Smoothing thin-plate spline of points with two or three coordinates."""

    def __init__(self, x: np.ndarray, y: np.ndarray, smooth: float = 0.0):
        self.x = np.atleast_2d(np.asarray(x, float))
        n, d = self.x.shape
        a = self._green(self.x) + smooth * np.eye(n)
        b = np.c_[np.ones(n), self.x]
        system = np.block([[a, b], [b.T, np.zeros((d + 1, d + 1))]])
        out = np.linalg.lstsq(system, np.concatenate([np.asarray(y, float), np.zeros(d + 1)]), rcond=None)[0]
        self.bend, self.affine = out[:n], out[n:]

    def _green(self, q: np.ndarray) -> np.ndarray:
        r2 = ((q[:, None] - self.x) ** 2).sum(2)
        if self.x.shape[1] == 2:
            return np.where(r2 > 0, r2 * np.log(np.maximum(r2, 1e-300)) / 2, 0.0)
        return -np.sqrt(r2)

    def __call__(self, q: np.ndarray) -> np.ndarray:
        q = np.atleast_2d(np.asarray(q, float))
        return self._green(q) @ self.bend + np.c_[np.ones(len(q)), q] @ self.affine
