"""Image and video operators over pixel tables: one row for each (frame, y, x), with a column for each channel.

Filters emit each pixel's weighted contributions and sum them, so partial sums merge before
the shuffle and no task holds a frame. Null channels count as missing pixels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import stats

AT = ["frame", "y", "x"]


def half(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """Mean of each 2 x 2 block; an odd last row or column is dropped."""
    block = pixels.groupBy("frame", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"))
    return block.agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in channels]).where("_n = 4").drop("_n")


def step_scale(pixels: DataFrame, k: int) -> DataFrame:
    """Repeats each pixel k x k times."""
    steps = F.array(*[F.lit(i) for i in range(k)])
    out = pixels.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    return out.withColumn("y", F.col("y") * k + F.col("_dy")).withColumn("x", F.col("x") * k + F.col("_dx")).drop("_dy", "_dx")


def reflect(pixels: DataFrame, height: int, width: int, rx: bool = True, ry: bool = False) -> DataFrame:
    return pixels.withColumn("y", height - 1 - F.col("y") if ry else F.col("y")).withColumn("x", width - 1 - F.col("x") if rx else F.col("x"))


def crop(pixels: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """The window's pixels, counted from its corner; the filter reaches the scan."""
    inside = pixels.where(F.col("y").between(top, top + height - 1) & F.col("x").between(left, left + width - 1))
    return inside.withColumn("y", F.col("y") - top).withColumn("x", F.col("x") - left)


def difference(a: DataFrame, b: DataFrame, channels: list[str], mult: float = 100.0) -> DataFrame:
    """Absolute difference of two streams, frame by frame."""
    other = b.select(*AT, *[F.col(c).alias(f"_{c}") for c in channels])
    return a.join(other, AT).select(*AT, *[(F.abs(F.col(c) - F.col(f"_{c}")) * mult).alias(c) for c in channels])


def lag_difference(pixels: DataFrame, channel: str) -> DataFrame:
    """Change since the frame before, by a join on the frame number: no window sorts a pixel's whole history."""
    before = pixels.select((F.col("frame") + 1).alias("frame"), "y", "x", F.col(channel).alias("_before"))
    return pixels.join(before, AT).select(*AT, (F.col(channel) - F.col("_before")).alias("change"))


def gaussian_taps(sd: float, quality: float = 3.0) -> list[tuple[int, float]]:
    r = max(1, math.ceil(sd * quality))
    return [(o, math.exp(-0.5 * (o / sd) ** 2)) for o in range(-r, r + 1)]


def blur(pixels: DataFrame, channel: str, sd: float, quality: float = 3.0) -> DataFrame:
    """Separable Gaussian blur; weights are renormalised where taps fall off the image or on missing pixels."""
    taps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in gaussian_taps(sd, quality)])
    out = pixels.where(F.col(channel).isNotNull()).select(*AT, F.col(channel).cast("double").alias("v"))
    for axis in ("y", "x"):
        spread = out.withColumn("t", F.explode(taps)).withColumn(axis, F.col(axis) + F.col("t.o"))
        sums = spread.groupBy(*AT).agg((F.sum(F.col("v") * F.col("t.w")) / F.sum("t.w")).alias("v"))
        out = sums.join(pixels.select(*AT), AT, "left_semi")
    return out.select(*AT, F.col("v").alias(channel))


def sample_bilinear(pixels: DataFrame, points: DataFrame, channel: str) -> DataFrame:
    """Values at real locations: points (id, frame, py, px); four equality joins folded into one, weights renormalised at edges; points beyond the image give null."""
    fy, fx = F.floor("py"), F.floor("px")
    corners = F.array(*[F.struct((fy + i).cast("int").alias("y"), (fx + j).cast("int").alias("x"), (F.abs(1 - i - (F.col("py") - fy)) * F.abs(1 - j - (F.col("px") - fx))).alias("w")) for i in (0, 1) for j in (0, 1)])
    near = points.select("id", "frame", F.explode(corners).alias("c")).select("id", "frame", "c.y", "c.x", "c.w").where("w > 0")
    got = near.join(pixels.select(*AT, F.col(channel).alias("_v")), AT).groupBy("id").agg((F.sum(F.col("_v") * F.col("w")) / F.sum("w")).alias(channel))
    return points.select("id").join(got, "id", "left")


def project(hg: list[list[float]], y: Column, x: Column) -> tuple[Column, Column]:
    """(y, x) through a homography that acts on (x, y, 1)."""
    row = lambda i: x * hg[i][0] + y * hg[i][1] + hg[i][2]
    return row(1) / row(2), row(0) / row(2)


def warp(pixels: DataFrame, inverse: list[list[float]], channel: str) -> DataFrame:
    """Resamples every output pixel through the inverse homography (output to input), bilinear; the output has the input's raster."""
    py, px = project(inverse, F.col("y").cast("double"), F.col("x").cast("double"))
    points = pixels.select(F.struct(*AT).alias("id"), "frame", py.alias("py"), px.alias("px"))
    return sample_bilinear(pixels, points, channel).select("id.*", channel)


def render_mask(pixels: DataFrame, mask: str, fg=(1.0, 1.0, 1.0), bg=(0.0, 0.0, 0.0)) -> DataFrame:
    return pixels.select(*AT, *[F.when(F.col(mask) != 0, F.lit(f)).otherwise(F.lit(b)).alias(c) for c, f, b in zip("rgb", fg, bg)])


def frame_average(pixels: DataFrame, channels: list[str], mult: float = 1.0) -> DataFrame:
    return pixels.groupBy("frame").agg(*[(F.avg(c) * mult).alias(c) for c in channels])


def mask_stats(pixels: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts of the four outcomes of a mask against the truth, by frame."""
    count = lambda t, g: F.count_if((F.col(truth) == t) & (F.col(guess) == g))
    return pixels.groupBy("frame").agg(*[count(t, g).alias(f"t{t}g{g}") for t in (0, 1) for g in (0, 1)])


def flow_render(pixels: DataFrame, scale: float, asymptotic: bool = False) -> DataFrame:
    """(hue in [0, 1), value in [0, 1]) of flow columns dy, dx: direction and speed."""
    speed = F.hypot("dy", "dx") * scale
    hue = F.atan2(F.col("dy"), F.col("dx")) / (2 * math.pi)
    return pixels.select(*AT, F.when(hue < 0, hue + 1).otherwise(hue).alias("hue"), (1 - F.exp(-speed) if asymptotic else F.least(speed, F.lit(1.0))).alias("value"))


def background(pixels: DataFrame, channel: str, threshold: float) -> DataFrame:
    """Foreground mask of each pixel against the running mean of its earlier frames, kept by running sums over ranges of frames; the first frame is background. A null value is background and not part of the mean."""
    rows = pixels.select(*AT, F.col(channel).cast("double").alias("_v"), F.coalesce(F.col(channel).cast("double"), F.lit(0.0)).alias("v"), F.when(F.col(channel).isNotNull(), 1.0).otherwise(0.0).alias("n"))
    run = stats.running(rows, ["y", "x"], "frame", ["v", "n"])
    n, total = F.col("run_n") - F.col("n"), F.col("run_v") - F.col("v")
    return run.select(*AT, F.coalesce(F.round(F.abs(F.col("_v") - F.when(n > 0, total / n)), 9) > threshold, F.lit(False)).cast("int").alias("mask"))


def concat(streams: list[DataFrame], lengths: list[int]) -> DataFrame:
    """One stream after another, frames renumbered by the lengths before."""
    out, start = None, 0
    for s, n in zip(streams, lengths, strict=True):
        s = s.withColumn("frame", F.col("frame") + start)
        out, start = s if out is None else out.unionByName(s), start + n
    return out
