"""Background subtraction: each pixel keeps a capped mixture of the colours it has had, with counts that fade, and a share for what it has not seen.

The state of a tile of pixels is one group of a stateful stream; frames arrive in order
within a tile. `step` is the whole model, so a batch can replay it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Components that a pixel keeps.
CAP = 6
TILE = 16
STATE = "pixels array<long>, counts array<double>, means array<double>, squares array<double>"
OUT = "frame long, y long, x long, foreground double"


def step(counts: np.ndarray, means: np.ndarray, squares: np.ndarray, v: np.ndarray, fade: float = 0.99, fresh: float = 0.01, sd: float = 0.05) -> np.ndarray:
    """Updates (pixels, CAP) state in place with one value for each pixel; returns the probability that the value is foreground, judged before the update."""
    var = (squares + sd * sd) / (counts + 1)
    p = np.exp(-0.5 * (v[:, None] - means) ** 2 / var) / np.sqrt(2 * np.pi * var)
    seen, total = counts * p, counts.sum(1)
    known = seen.sum(1)
    probability = np.where(total > 0, fresh / (fresh + known / np.maximum(total, 1e-300)), 0.0)
    counts *= fade
    squares *= fade
    at = seen.argmax(1)
    rows = np.arange(len(v))
    new = seen[rows, at] < fresh
    at = np.where(new, counts.argmin(1), at)
    counts[rows[new], at[new]] = 0.0
    squares[rows[new], at[new]] = 0.0
    counts[rows, at] += 1
    gap = np.where(new, 0.0, v - means[rows, at])
    means[rows, at] = np.where(new, v, means[rows, at] + gap / counts[rows, at])
    squares[rows, at] += gap * (v - means[rows, at])
    return probability


def _frames(pdf: pd.DataFrame, pixels: np.ndarray, state: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    for frame, f in pdf.sort_values(["frame", "pixel"]).groupby("frame", sort=True):
        at = np.searchsorted(pixels, f["pixel"].to_numpy())
        part = [s[at] for s in state]
        p = step(*part, f["v"].to_numpy(float))
        for s, q in zip(state, part):
            s[at] = q
        yield pd.DataFrame({"frame": frame, "y": f["y"].to_numpy(), "x": f["x"].to_numpy(), "foreground": p})


def _grown(pixels: np.ndarray, state: list[np.ndarray], new: np.ndarray):
    both = np.union1d(pixels, new)
    out = [np.zeros((len(both), CAP)) for _ in state]
    at = np.searchsorted(both, pixels)
    for o, s in zip(out, state):
        o[at] = s
    return both, out


def foreground(pixels: DataFrame, channel: str = "v") -> DataFrame:
    """(frame, y, x, foreground) of a stream of pixel rows (frame, y, x, channel). Null values are left out; a frame must not arrive in a later batch than the one after it."""

    def update(key, batches, state: GroupState):
        pdf = pd.concat(list(batches))
        known, parts = np.zeros(0, np.int64), [np.zeros((0, CAP)) for _ in range(3)]
        if state.exists:
            old = state.get
            known, parts = np.array(old[0], np.int64), [np.array(o, float).reshape(-1, CAP) for o in old[1:]]
        known, parts = _grown(known, parts, pdf["pixel"].unique())
        yield from _frames(pdf, known, parts)
        state.update((known.tolist(), *[p.ravel().tolist() for p in parts]))

    return _tiled(pixels, channel).groupBy("ty", "tx").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def foreground_batch(pixels: DataFrame, channel: str = "v") -> DataFrame:
    """The same over a table: a tile's frames are one group, of at most TILE * TILE rows a frame."""

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        known, parts = _grown(np.zeros(0, np.int64), [np.zeros((0, CAP)) for _ in range(3)], pdf["pixel"].unique())
        return pd.concat(list(_frames(pdf, known, parts)))

    return _tiled(pixels, channel).groupBy("ty", "tx").applyInPandas(replay, OUT)


def _tiled(pixels: DataFrame, channel: str) -> DataFrame:
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    return pixels.where(F.col(channel).isNotNull()).select(F.col("frame").cast("long").alias("frame"), y.alias("y"), x.alias("x"), F.col(channel).cast("double").alias("v"), F.floor(y / TILE).alias("ty"), F.floor(x / TILE).alias("tx"), (F.pmod(y, F.lit(TILE)) * TILE + F.pmod(x, F.lit(TILE))).alias("pixel"))
