"""Sums of a one-dimensional kernel over all data in range, with work in proportion to the rows and not to their pairs.

Data are collapsed to distinct values with weights and dealt to cells of an eighth of a scaled unit.
A cell that lies in range as a whole acts through its Chebyshev moments, which stand for its rows to
rounding (interpolation at twelve nodes); in the cells at the ends of the range, running moments of
the sorted values stop where the comparison with the range itself, made in floating point, stops.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.session import ship

#: Width of a cell in scaled units, a power of two that divides every kernel's range; cells that a task takes together; nodes of a cell.
CELL, BLOCK, NODES = 0.125, 8, 12
#: Scaled values from here on are refused: their cells could not be told apart.
FARTHEST = 2.0**40
#: Queries that meet a cell's nodes at a time.
CHUNK = 20_000

HALF = CELL / 2
_U = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
#: From moments of Chebyshev polynomials to weights at the nodes.
_TO_NODES = chebvander(_U, NODES - 1) * np.where(np.arange(NODES), 2, 1) / NODES

_CURVES = {
    "discrete": np.ones_like,
    "uniform": np.ones_like,
    "triangular": lambda d: 1 - d,
    "epanechnikov": lambda d: 1 - d * d,
    "cosine": lambda d: np.cos(d * (np.pi / 2)),
    "gaussian": lambda d: np.exp(d * d * -0.5),
    "cauchy": lambda d: 1 / (1 + d * d),
    "logistic": lambda d: np.exp(-d) / (1 + np.exp(-d)) ** 2,
}


def reach(kernel: str) -> float:
    """Scaled distance from which the kernel is zero."""
    return 0.5 if kernel == "discrete" else kernels.RANGE[kernel]


def peak(kernel: str) -> float:
    """The kernel's weight at distance zero."""
    return float(_CURVES[kernel](np.zeros(1))[0])


def values(data: DataFrame, x: str, weight: Column | None = None) -> DataFrame:
    """(x, n) distinct values that are not null with their rows, or with the sum of their weights."""
    x_ = F.col(x).cast("double")
    return data.where(x_.isNotNull()).groupBy(x_.alias("x")).agg((F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0.0))).cast("double").alias("n"))


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def _cell(c: Column, after: float) -> Column:
    y = c * after
    return F.floor(F.when(F.abs(y) < FARTHEST, y).otherwise(F.raise_error(F.lit(f"a scaled value beyond {FARTHEST:g}"))) / CELL)


def sources(data: DataFrame, kernel: str, after: float = 1.0) -> DataFrame:
    """The rows (block, cell, x, n, m) of distinct values (x, n) by the blocks of queries that need them: values singly where a range may end in their cell, else the moments of the cell."""
    wide = round(reach(kernel) / CELL)
    ends = sorted({0, *(s * (wide + o) for s in (-1, 1) for o in (-1, 0, 1))})
    rows = data.where(_finite(F.col("x"))).select("x", "n", _cell(F.col("x"), after).alias("cell"))
    block = lambda o: F.floor((F.col("cell") + o) / BLOCK)
    single = rows.select(F.explode(F.array_distinct(F.array(*[block(o) for o in ends]))).alias("block"), "cell", "x", "n", F.lit(None).cast("array<double>").alias("m"))
    at = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("x") * after - (F.col("cell") + 0.5) * CELL) / HALF)))
    moments = rows.withColumn("_a", at).groupBy("cell").agg(F.array(*[F.sum(F.col("n") * F.cos(F.col("_a") * k)) for k in range(NODES)]).alias("m"))
    far = moments.select(F.explode(F.sequence(block(2 - wide), block(wide - 2))).alias("block"), "cell", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("n"), "m")
    return single.unionByName(far)


class _Block:
    """What the queries of one block need of the sources."""

    def __init__(self, src: pd.DataFrame, kernel: str, after: float):
        self.curve, self.limit, self.top, self.after = _CURVES[kernel], reach(kernel), peak(kernel), after
        self.wide = round(self.limit / CELL)
        many = src["m"].notna().to_numpy()
        self.cells, self.m = src["cell"].to_numpy(np.int64)[many], np.array(list(src["m"][many]), float).reshape(-1, NODES)
        c, x, n = (src[k].to_numpy(t)[~many] for k, t in (("cell", np.int64), ("x", float), ("n", float)))
        order = np.lexsort((x, c))
        c, x, n, self.held = c[order], x[order], n[order], {}
        for k, a, b in _runs(c):
            u = (x[a:b] * after - (k + 0.5) * CELL) / HALF
            each = (chebvander(u, NODES - 1) @ _TO_NODES.T) * n[a:b, None]
            # The running sums keep more digits than the sums that their differences give.
            self.held[k] = x[a:b], n[a:b], np.concatenate([np.zeros((1, NODES), np.longdouble), np.cumsum(each, 0, np.longdouble)])

    def at(self, q: np.ndarray) -> np.ndarray:
        """Columns s, same and t of sorted queries."""
        out = np.zeros((len(q), 3))
        for k, a, b in _runs(np.floor(q * self.after / CELL).astype(np.int64)):
            for i in range(a, b, CHUNK):
                j = min(b, i + CHUNK)
                out[i:j] = self._one(q[i:j], int(k))
        out[:, 2] /= self.after
        return out

    def _one(self, q: np.ndarray, cell: int) -> np.ndarray:
        after, curve, wide = self.after, self.curve, self.wide
        out, local = np.zeros((len(q), 3)), q * after - (cell + 0.5) * CELL
        off = self.cells - cell
        use = (np.abs(off) >= 1) & (np.abs(off) <= wide - 2)
        if use.any():
            place = (off[use, None] * CELL + HALF * _U).ravel()
            weight, side = (self.m[use] @ _TO_NODES.T).ravel(), np.repeat(np.sign(off[use]), NODES)
            way = place - (HALF * _U)[:, None]
            f = curve(way * side) * weight
            at = chebvander(local / HALF, NODES - 1) @ _TO_NODES.T
            out[:, 0] += at @ f.sum(1)
            out[:, 2] += at @ (f * way).sum(1)
        for o in sorted({0, *(s * (wide + e) for s in (-1, 1) for e in (-1, 0, 1))}):
            if cell + o not in self.held:
                continue
            x, n, run = self.held[cell + o]
            if o:
                end, up = self._end(q, x, o > 0), o > 0
                parts = [(np.sign(o), run[end] if up else run[-1] - run[end])]
            else:
                left, right = np.searchsorted(x, q), np.searchsorted(x, q, "right")
                out[:, 1] = np.where(right > left, n[np.minimum(left, len(x) - 1)], 0) * self.top
                parts = [(-1, run[left]), (1, run[-1] - run[right])]
            way = o * CELL + HALF * _U - local[:, None]
            for side, weight in parts:
                f = curve(way * side) * weight.astype(float)
                out[:, 0] += f.sum(1)
                out[:, 2] += (f * way).sum(1)
        return out

    def _end(self, q: np.ndarray, x: np.ndarray, up: bool) -> np.ndarray:
        """Where each query's range ends in sorted values above it, or begins in those below: a first guess, moved to where the comparison itself changes."""
        near = lambda i: np.abs(q - x[np.clip(i, 0, len(x) - 1)]) * self.after < self.limit
        one = 1 if up else -1
        end = np.searchsorted(x, q + one * self.limit / self.after)
        while True:
            more = (end < len(x)) & near(end) if up else (end > 0) & near(end - 1)
            less = ((end > 0) & ~near(end - 1) if up else (end < len(x)) & ~near(end)) & ~more
            if not more.any() and not less.any():
                return end
            end = end + np.where(more, one, 0) - np.where(less, one, 0)


def _runs(sorted_: np.ndarray):
    """(value, first, end) of each run of equal values."""
    u, first = np.unique(sorted_, return_index=True)
    return zip(u, first, [*first[1:], len(sorted_)])


def _finite_blocks(queries: DataFrame, after: float) -> DataFrame:
    return queries.where(_finite(F.col("q"))).withColumn("block", F.floor(_cell(F.col("q"), after) / BLOCK))


def sums(queries: DataFrame, source: DataFrame, kernel: str, after: float = 1.0, shifts: bool = False) -> DataFrame:
    """(q, s, same[, t]) of each query (q): s adds the kernel's weights of all data in range at other values, same those at q itself, t the weights times the way there. A pair is in range if abs(q - x) * after is below the kernel's; a query that is not finite has no data in range."""
    ship(queries.sparkSession)
    names = ["s", "same", "t"] if shifts else ["s", "same"]

    def block(qs: pd.DataFrame, src: pd.DataFrame) -> pd.DataFrame:
        q = np.sort(qs["q"].to_numpy(float))
        out = _Block(src, kernel, after).at(q) if len(q) else np.zeros((0, 3))
        return pd.DataFrame({"q": q} | {c: out[:, i] for i, c in enumerate(names)})

    wanted = queries.select(F.col("q").cast("double").alias("q")).where(F.col("q").isNotNull()).distinct()
    got = _finite_blocks(wanted, after).groupBy("block").cogroup(source.groupBy("block")).applyInPandas(block, ", ".join(f"{c} double" for c in ("q", *names)))
    return got.unionByName(wanted.where(~_finite(F.col("q"))).select("q", *[F.lit(0.0).alias(c) for c in names]))


def walk(points: DataFrame, source: DataFrame, kernel: str, epsilon: float, rounds: int) -> DataFrame:
    """(start, q, steps, still) of points (start, q, steps): each goes to the weighted mean of the data in range until a step is below epsilon, or it leaves the block, or it has gone so many rounds. A point without data in range stays."""
    ship(points.sparkSession)

    def block(ps: pd.DataFrame, src: pd.DataFrame) -> pd.DataFrame:
        start, q, steps = (ps[c].to_numpy(t) for c, t in (("start", float), ("q", float), ("steps", np.int64)))
        still, q, steps = np.zeros(len(q), bool), q.copy(), steps.copy()
        if len(q):
            near, home = _Block(src, kernel, 1.0), int(ps["block"].iloc[0])
        left = np.arange(len(q))
        while len(left):
            left = left[np.argsort(q[left], kind="stable")]
            s = near.at(q[left])
            total = s[:, 0] + s[:, 1]
            step = np.where(total > 0, s[:, 2] / np.where(total > 0, total, 1), 0.0)
            q[left] += step
            steps[left] += 1
            still[left] = np.abs(step) < epsilon
            left = left[~still[left] & (np.floor(q[left] / (CELL * BLOCK)) == home) & (steps[left] < rounds)]
        return pd.DataFrame({"start": start, "q": q, "steps": steps, "still": still})

    got = _finite_blocks(points, 1.0).groupBy("block").cogroup(source.groupBy("block")).applyInPandas(block, "start double, q double, steps long, still boolean")
    return got.unionByName(points.where(~_finite(F.col("q"))).select("start", "q", "steps", F.lit(True).alias("still")))
