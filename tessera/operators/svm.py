"""Support vector machines. Pairs of classes are independent, so each is one group of a grouped Arrow UDF; a kernel matrix that is too large to hold is computed by rows as they are needed. Decisions are taken over blocks of the distinct support vectors, so a model of any size serves."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.density import MODEL_BYTES
from tessera.session import materialize, ship, width

#: Rows of one pair of classes whose whole kernel matrix is held; beyond, its rows are computed as they are needed.
HELD = 4_000
#: Bytes of such rows that are kept.
KEPT_BYTES = 256 << 20
#: Rows and columns of a tile of a kernel matrix in single precision, and bytes of such tiles that are kept; the others are computed again in each product.
TILE, TILE_BYTES = 1_024, 512 << 20
#: Rows whose kernel values precondition the steps of `approach`; its rounds in all, and in a row without fewer rows on a wrong side.
LANDMARKS, MOST_STEPS, MOST_IDLE = 512, 200, 30
#: Kernel values that a decision computes at a time.
AT_ONCE = 1 << 22
#: Multipliers under this count as zero.
LEAST_ALPHA = 1e-3


def gram(name: str, a: np.ndarray, b: np.ndarray, p1: float = 1.0, p2: float = 1.0, a2: np.ndarray | None = None, b2: np.ndarray | None = None) -> np.ndarray:
    """Kernel values of all rows of a and b; a2 and b2 are their squared lengths, if known."""
    dots = a @ b.T
    if name in ("rbf", "gbf"):
        d2 = np.maximum(((a * a).sum(1) if a2 is None else a2)[:, None] + ((b * b).sum(1) if b2 is None else b2) - 2 * dots, 0)
        return np.exp(-d2 * (p1 if name == "rbf" else 0.5 / p1**2))
    return {"linear": lambda: dots, "homo_poly": lambda: dots**p1, "poly": lambda: (dots + 1) ** p1, "sigmoid": lambda: np.tanh(dots * p1 + p2)}[name]()


class Rows:
    """Rows of a kernel matrix, computed when asked for; the latest ones are kept."""

    def __init__(self, name: str, x: np.ndarray, p1: float, p2: float):
        self.x, self.args, self.kept, self.squares = x, (name, p1, p2), OrderedDict(), (x * x).sum(1)
        self.most = max(2, KEPT_BYTES // (8 * len(x)))

    def __getitem__(self, i: int) -> np.ndarray:
        if i in self.kept:
            self.kept.move_to_end(i)
            return self.kept[i]
        if len(self.kept) >= self.most:
            self.kept.popitem(last=False)
        name, p1, p2 = self.args
        got = self.kept[i] = gram(name, self.x[i : i + 1], self.x, p1, p2, self.squares[i : i + 1], self.squares)[0]
        return got


class Tiles:
    """Products with a symmetric kernel matrix: in single precision over tiles of its upper half, or in double precision, computed anew."""

    def __init__(self, name: str, x: np.ndarray, p1: float, p2: float):
        self.x, self.args, self.squares = x, (name, p1, p2), (x * x).sum(1)
        self.single, self.kept, self.room = (x.astype(np.float32), self.squares.astype(np.float32)), {}, TILE_BYTES

    def values(self, a, b) -> np.ndarray:
        (x, squares), (name, p1, p2) = self.single, self.args
        return gram(name, x[a], x[b], p1, p2, squares[a], squares[b])

    def tile(self, i: int, j: int) -> np.ndarray:
        if (i, j) in self.kept:
            return self.kept[i, j]
        got = self.values(slice(i, i + TILE), slice(j, j + TILE))
        if got.nbytes <= self.room:
            self.room -= got.nbytes
            self.kept[i, j] = got
        return got

    def dot(self, v: np.ndarray) -> np.ndarray:
        v, out = v.astype(np.float32), np.zeros(len(v))
        for i in range(0, len(v), TILE):
            for j in range(i, len(v), TILE):
                t = self.tile(i, j)
                out[i : i + TILE] += t @ v[j : j + TILE]
                if j > i:
                    out[j : j + TILE] += v[i : i + TILE] @ t
        return out

    def exact(self, v: np.ndarray) -> np.ndarray:
        (name, p1, p2), at, out = self.args, np.flatnonzero(v), np.zeros(len(v))
        size = max(1, AT_ONCE // max(1, len(at)))
        for i in range(0, len(v), size):
            a = slice(i, i + size)
            out[a] = gram(name, self.x[a], self.x[at], p1, p2, self.squares[a], self.squares[at]) @ v[at]
        return out


def balance(w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """w moved by one amount and held within lo and hi, such that it adds up to zero."""
    a, b = -np.abs(w).max() - np.abs(lo).max() - np.abs(hi).max(), np.abs(w).max() + np.abs(lo).max() + np.abs(hi).max()
    for _ in range(200):
        mid = (a + b) / 2
        a, b = (a, mid) if np.clip(w + mid, lo, hi).sum() > 0 else (mid, b)
    w = np.clip(w + (a + b) / 2, lo, hi)
    inner = (w > lo) & (w < hi)
    return w - np.where(inner, w.sum() / max(1, inner.sum()), 0.0)


def approach(k: Tiles, y: np.ndarray, bound: np.ndarray, tol: float) -> np.ndarray | None:
    """alpha * y near the optimum of the dual, from which `solve` goes on to its own end: conjugate gradients for all rows within their bounds at once, then rows beyond a bound are held there and rows that would leave theirs are let go, until no row is on a wrong side. None where the kernel has no such optimum in sight."""
    n, open_ = len(y), bound > 1e-12
    lo, hi = np.where(y > 0, 0.0, -bound), np.where(y > 0, bound, 0.0)
    marks = np.sort(np.random.default_rng(0).permutation(n)[:LANDMARKS])
    diagonal = np.concatenate([np.diag(k.values(slice(i, i + 64), slice(i, i + 64))) for i in range(0, n, 64)]).astype(float)
    try:
        root = np.linalg.cholesky(k.values(marks, marks).astype(float) + np.eye(len(marks)) * 1e-4 * diagonal.mean())
    except np.linalg.LinAlgError:
        return None
    # The kernel matrix is about basis @ basis.T + rest * identity.
    basis = (k.values(slice(None), marks) @ np.linalg.inv(root).T.astype(np.float32)).astype(np.float32)
    rest = max(float((diagonal - (basis * basis).sum(1)).mean()), 1e-3 * diagonal.mean())
    w, f, free = np.zeros(n), y.astype(float), open_.copy()
    least, idle, sharp = n + 1, 0, False
    for _ in range(MOST_STEPS):
        if not free.any():
            break
        part = basis[free]
        inner = np.linalg.inv(part.T @ part + np.eye(part.shape[1]) * rest)
        ease = lambda r: (r - part @ (inner @ (r @ part)).astype(np.float32)) / rest  # noqa: B023, E731
        ones = ease(np.ones(len(part), np.float32)).astype(float)

        def steer(r):
            # A direction of descent that leaves the sum as it is.
            z = ease(r.astype(np.float32)).astype(float)  # noqa: B023
            return z - ones * (z.sum() / ones.sum())  # noqa: B023

        r = f[free] - f[free].mean()
        first = r @ r
        goal = len(r) * (tol / 40) ** 2 if sharp else max(first / 100, len(r) * (tol / 10) ** 2)
        p = z = steer(r)
        full, step, moved = np.zeros(n), np.zeros(n), np.zeros(n)
        rz, done = r @ z, 0
        while r @ r > goal and done < MOST_STEPS and rz > 0:
            full[free] = p
            q = k.dot(full)
            curve = p @ q[free]
            if not curve > 1e-9 * (p @ p):
                break
            a = rz / curve
            step[free] += a * p
            moved += a * q
            r = r - a * (q[free] - q[free].mean())
            z = steer(r)
            p, rz, done = z + p * ((r @ z) / rz), r @ z, done + 1
        w, f = w + step, f - moved
        if not np.isfinite(w).all():
            return None
        g = f - f[free].mean()
        out = free & ((w < lo) | (w > hi))
        back = ~free & open_ & (((w <= lo) & (g > tol / 4)) | ((w >= hi) & (g < -tol / 4)))
        bad = int(out.sum() + back.sum())
        if not bad and (not done or np.abs(g[free]).max() < tol / 4):
            if sharp:
                break
            # What single precision has left is seen in double precision, and taken away in one more step or a few.
            f, sharp = y - k.exact(w), True
            least, idle = n + 1, 0
            continue
        least, idle = (bad, 0) if bad < least else (least, idle + 1)
        if idle > MOST_IDLE:
            break
        move = np.where(out, np.clip(w, lo, hi) - w, 0.0)
        free = (free & ~out) | back
        if out.any():
            move[free] -= move.sum() / max(1, free.sum())
            w, f = w + move, f - k.dot(move)
    return balance(np.clip(w, lo, hi), lo, hi)


def limits(y: np.ndarray, c: float, balanced: bool) -> np.ndarray:
    """Each row's greatest multiplier; with `balanced`, scaled by the other class's share."""
    return c * (np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2 if balanced else np.ones(len(y)))


def solve(k: np.ndarray | Rows, y: np.ndarray, c: float, balanced: bool = True, tol: float = 1e-4, near: bool = False) -> tuple[np.ndarray, float]:
    """(alpha, b) of the soft-margin dual by working pairs of greatest violation, until none violates by tol; with `balanced`, each class's bound is scaled by the other's share. k: the symmetric kernel matrix, or its rows; with `near`, rows' pairs begin near the optimum (`approach`), not at zero."""
    n = len(y)
    bound, alpha, f = limits(y, c, balanced), np.zeros(n), y.astype(float)
    tiles = Tiles(k.args[0], k.x, *k.args[1:]) if near and isinstance(k, Rows) else None
    if tiles and (w := approach(tiles, y, bound, tol)) is not None:
        alpha, f = np.clip(y * w, 0, bound), y - tiles.exact(w)
    del tiles
    # The rows whose alpha * y may rise, and fall.
    less, more = (alpha < bound - 1e-12) & (bound > 1e-12), alpha > 1e-12
    up, low = np.where(y > 0, less, more), np.where(y > 0, more, less)
    while up.any() and low.any():
        i, j = int(np.where(up, f, -np.inf).argmax()), int(np.where(low, f, np.inf).argmin())
        if f[i] - f[j] < tol:
            break
        ki, kj = k[i], k[j]
        curve = max(ki[i] + kj[j] - 2 * ki[j], 1e-12)
        room_i = bound[i] - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else bound[j] - alpha[j]
        t = min((f[i] - f[j]) / curve, room_i, room_j)
        alpha[i] += y[i] * t
        alpha[j] -= y[j] * t
        for e in (i, j):
            less, more = alpha[e] < bound[e] - 1e-12, alpha[e] > 1e-12
            up[e], low[e] = (less, more) if y[e] > 0 else (more, less)
        f -= (ki - kj) * t
    free = (alpha > LEAST_ALPHA) & (alpha < bound - 1e-6)
    if free.any():
        return alpha, float(f[free].mean())
    # Without a free support vector any bias between these is right; the middle is taken.
    ends = ([f[up].max()] if up.any() else []) + ([f[low].min()] if low.any() else [])
    return alpha, float(np.mean(ends)) if ends else 0.0


def train_pairs(rows: DataFrame, label: str, vector: str, kernel: str = "rbf", p1: float = 1.0, p2: float = 1.0, c: float = 10.0) -> DataFrame:
    """One-against-one model (neg, pos, v, ay, b): a row for each support vector of each pair of classes; the greater label is the positive one. Rows without label or vector are left out."""
    data = rows.select(F.col(label).cast("long").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("label is not null and v is not null")
    found = sorted(r["label"] for r in data.select("label").distinct().collect())
    partners = F.filter(F.array(*[F.lit(x).cast("long") for x in found]), lambda o: o != F.col("label"))
    pairs = data.withColumn("o", F.explode(partners)).select(F.least("label", "o").alias("neg"), F.greatest("label", "o").alias("pos"), "label", "v")
    ship(rows.sparkSession)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        order = np.lexsort((*x.T[::-1], pdf["label"]))  # whatever the order of arrival
        pdf, x = pdf.iloc[order], x[order]
        y = np.where(pdf["label"] == pdf["pos"], 1.0, -1.0)
        alpha, b = solve(gram(kernel, x, x, p1, p2) if len(x) <= HELD else Rows(kernel, x, p1, p2), y, c, near=True)
        at = np.flatnonzero(alpha >= LEAST_ALPHA)
        return pd.DataFrame({"neg": pdf["neg"].iloc[0], "pos": pdf["pos"].iloc[0], "v": list(x[at]), "ay": (alpha * y)[at], "b": b})

    def fit_all(batches):
        got = list(batches)
        if got:
            for _, pdf in pd.concat(got, ignore_index=True).groupby(["neg", "pos"]):
                yield fit(pdf)

    # A task a pair: by hash, some tasks would get several pairs and others none.
    known = F.array(*[F.lit(x).cast("long") for x in found])
    i, j = F.array_position(known, F.col("neg")), F.array_position(known, F.col("pos"))
    number = (i - 1) * len(found) - F.shiftright(i * (i - 1), 1) + j - i - 1
    tasks = max(1, len(found) * (len(found) - 1) // 2)
    return pairs.repartitionById(tasks, number.cast("int")).mapInPandas(fit_all, "neg long, pos long, v array<double>, ay double, b double")


def decisions(rows: DataFrame, model: DataFrame, id_col: str, vector: str, kernel: str = "rbf", p1: float = 1.0, p2: float = 1.0) -> DataFrame:
    """(id, neg, pos, value): each pair's decision value. A support vector of several pairs is compared with a row once; its pairs and multipliers go along. Blocks of support vectors are sent one after another, none beyond MODEL_BYTES."""
    spark = rows.sparkSession
    ship(spark)
    model = materialize(model, "support")
    biases = sorted((r["neg"], r["pos"], r["b"]) for r in model.groupBy("neg", "pos").agg(F.first("b").alias("b")).collect())  # a row a pair
    number = {(neg, pos): i for i, (neg, pos, _) in enumerate(biases)}
    schema = f"id {dict(rows.dtypes)[id_col]}, part int, decided array<double>"
    near = rows.select(F.col(id_col).alias("id"), F.transform(vector, lambda e: e.cast("double")).alias("x")).where("x is not null")
    if not biases:
        return spark.createDataFrame([], schema.split(",")[0] + ", neg long, pos long, value double")
    distinct = model.groupBy("v").agg(F.collect_list("neg").alias("neg"), F.collect_list("pos").alias("pos"), F.collect_list("ay").alias("ay"))
    held = distinct.agg(F.sum(width(distinct))).first()[0]
    blocks = -(-2 * held // MODEL_BYTES)  # twice, for blocks by hash differ in size
    support = materialize(distinct.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")), "support")

    def decide(part: int) -> DataFrame:
        got = support.where(F.col("block") == part).collect()
        at = np.repeat(np.arange(len(got)), [len(r["ay"]) for r in got])
        pair = np.array([number[p] for r in got for p in zip(r["neg"], r["pos"])], int)
        sent = spark.sparkContext.broadcast((np.array([r["v"] for r in got], float), at, pair, np.array([a for r in got for a in r["ay"]], float)))

        def step(batches):
            s, at, pair, ay = sent.value
            weights = np.zeros((len(s), len(biases)))
            np.add.at(weights, (at, pair), ay)  # a vector may be several rows of a pair
            size = max(1, AT_ONCE // len(s))
            for b in batches:
                for i in range(0, len(b), size):
                    rows = b.slice(i, size)
                    x = np.array(rows.column(1).to_pylist(), float)
                    values = gram(kernel, x, s, p1, p2) @ weights
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(rows), part), pa.int32()), pa.array(values.tolist(), pa.list_(pa.float64()))], names=["id", "part", "decided"])

        return materialize(near.mapInArrow(step, schema), "decided") if blocks > 1 and len(got) else near.mapInArrow(step, schema) if len(got) else near.limit(0).select("id", F.lit(part).alias("part"), F.array(F.lit(0.0)).alias("decided"))

    all_parts = decide(0)
    for part in range(1, blocks):
        all_parts = all_parts.unionByName(decide(part))
    if blocks > 1:
        # Added in the order of the blocks, so that a sum does not hang on the order of arrival.
        add = lambda s, r: F.zip_with(s, r["decided"], lambda a, b: a + b)
        parts = all_parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "decided"))).alias("parts"))
        all_parts = parts.select("id", F.aggregate("parts", F.array_repeat(F.lit(0.0), len(biases)), add).alias("decided"))
    named = F.array(*[F.struct(F.lit(neg).cast("long").alias("neg"), F.lit(pos).cast("long").alias("pos"), (F.element_at("decided", i + 1) + b).alias("value")) for i, (neg, pos, b) in enumerate(biases)])
    return all_parts.select("id", F.explode(named).alias("r")).select("id", "r.*")


def vote(decided: DataFrame) -> DataFrame:
    """(id, best): the class that wins most pairs; ties go to the smaller label."""
    won = decided.select("id", F.when(F.col("value") > 0, F.col("pos")).otherwise(F.col("neg")).alias("label"))
    n = won.groupBy("id", "label").agg(F.count("*").alias("n"))
    return n.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("best"))


def leave_one_out(x: np.ndarray, y: np.ndarray, kernel: str, p1: float, p2: float, c: float) -> float:
    """Share of rows that a model fitted without them gets right; a row that is no support vector cannot change the fit, so only the others are refitted."""
    k = gram(kernel, x, x, p1, p2)
    alpha, b = solve(k, y, c, balanced=False)
    right = np.sign(k @ (alpha * y) + b) == y
    for i in np.flatnonzero(alpha > 1e-9):
        keep = np.arange(len(y)) != i
        a, bi = solve(k[np.ix_(keep, keep)], y[keep], c, balanced=False)
        right[i] = np.sign(k[i, keep] @ (a * y[keep]) + bi) == y[i]
    return float(right.mean())
