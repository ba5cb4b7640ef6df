"""Masks, colours and flow over pixel tables: one row for each (frame, y, x).

Neighbourhoods are made by rows that each pixel sends to the places around it, summed with partial
aggregates, so no task holds a frame; places outside the image have no pixel of their own and drop out.
Null masks count as 0. Repeated pixels are taken together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.images import AT

CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
SQUARE = [(0, 0), *[(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]]


def around(pixels: DataFrame, offsets: list[tuple[int, int]], columns: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates over each pixel's neighbourhood, of which (0, 0) is the pixel itself; `own` tells that pixel's row."""
    at = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    sent = pixels.select(*AT, *columns, F.explode(at).alias("o"))
    sent = sent.select("frame", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), *columns, ((F.col("o.dy") == 0) & (F.col("o.dx") == 0)).alias("own"))
    return sent.groupBy(*AT).agg(F.max("own").alias("_in"), *aggregates).where("_in").drop("_in")


def dilate(mask: DataFrame, repeat: int = 1) -> DataFrame:
    """Set where the pixel or one of its four neighbours is set, so many times."""
    for _ in range(repeat):
        mask = around(mask, CROSS, ["mask"], F.max(F.coalesce("mask", F.lit(0))).alias("mask"))
    return mask


def erode(mask: DataFrame, repeat: int = 1) -> DataFrame:
    """Set where the pixel and its four neighbours in the image are set, so many times."""
    for _ in range(repeat):
        mask = around(mask, CROSS, ["mask"], F.min(F.coalesce("mask", F.lit(0))).alias("mask"))
    return mask


def smooth(mask: DataFrame, repeat: int = 1) -> DataFrame:
    return erode(dilate(mask, repeat), repeat)


def cull_lonely(mask: DataFrame) -> DataFrame:
    """Clears set pixels without a set pixel among their eight neighbours."""
    own, near = F.max(F.when(F.col("own"), F.col("mask"))), F.max(F.when(~F.col("own"), F.col("mask")))
    return around(mask, SQUARE, ["mask"], own.alias("o"), near.alias("n")).select(*AT, F.when((F.col("o") > 0) & (F.col("n") > 0), 1).otherwise(0).alias("mask"))


def median_filter(pixels: DataFrame, channel: str, mask: DataFrame | None = None) -> DataFrame:
    """The median over each pixel's 3 x 3 neighbourhood, of an even number the mean of the middle two; with a mask, set pixels only, others staying as they are."""
    if mask is None:
        return around(pixels, SQUARE, [channel], F.median(channel).alias(channel))
    both = pixels.select(*AT, channel).join(mask.select(*AT, "mask"), AT, "left").withColumn("_v", F.when(F.col("mask") > 0, F.col(channel)))
    got = around(both, SQUARE, [channel, "mask", "_v"], F.median("_v").alias("m"), F.max(F.when(F.col("own"), F.col(channel))).alias("v"), F.max(F.when(F.col("own"), F.col("mask"))).alias("k"))
    return got.select(*AT, F.when(F.col("k") > 0, F.col("m")).otherwise(F.col("v")).alias(channel))


def clip(mask: DataFrame, height: int, width: int, top: int = 0, bottom: int = 0, left: int = 0, right: int = 0) -> DataFrame:
    """Clears a border of so many pixels."""
    inside = F.col("y").between(top, height - bottom - 1) & F.col("x").between(left, width - right - 1)
    return mask.select(*AT, F.when(inside, F.col("mask")).otherwise(0).alias("mask"))


def mask_flow(flow: DataFrame, mask: DataFrame, columns: tuple[str, str] = ("dy", "dx")) -> DataFrame:
    """Flow vectors, zero where the mask is not set."""
    got = flow.select(*AT, *columns).join(mask.select(*AT, "mask"), AT, "left")
    return got.select(*AT, *[F.when(F.col("mask") > 0, F.col(c)).otherwise(0.0).alias(c) for c in columns])


def from_colours(pixels: DataFrame, channels: list[str], foreground: list[tuple], background: list[tuple], epsilon: float = 1e-3) -> DataFrame:
    """(mask, valid): 1 for the exact foreground colours; valid for those and the background colours."""

    def among(colours: list[tuple]) -> Column:
        out = F.lit(False)
        for colour in colours:
            same = F.lit(True)
            for c, v in zip(channels, colour, strict=True):
                same = same & (F.abs(F.col(c) - v) < epsilon)
            out = out | same
        return F.coalesce(out, F.lit(False))

    return pixels.select(*AT, among(foreground).cast("int").alias("mask"), (among(foreground) | among(background)).cast("int").alias("valid"))


def ground_truth(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """(mask, valid): black is 0, all else 1; valid where the whole 3 x 3 neighbourhood in the image agrees."""
    black = F.lit(True)
    for c in channels:
        black = black & (F.col(c) < 0.5 / 255)
    mask = pixels.select(*AT, (~black).cast("int").alias("mask"))
    got = around(mask, SQUARE, ["mask"], F.max(F.when(F.col("own"), F.col("mask"))).alias("o"), F.min("mask").alias("lo"), F.max("mask").alias("hi"))
    return got.select(*AT, F.col("o").alias("mask"), (F.col("lo") == F.col("hi")).cast("int").alias("valid"))


def frame_crop(pixels: DataFrame, start: int, length: int | None = None) -> DataFrame:
    """Frames from `start` on, so many, counted from 0 again; the filter reaches the scan."""
    some = pixels.where(F.col("frame") >= start if length is None else F.col("frame").between(start, start + length - 1))
    return some.withColumn("frame", F.col("frame") - start)


def combine_grid(streams: list[DataFrame], height: int, width: int, horizontal: int) -> DataFrame:
    """Streams of one size side by side, so many in a row."""
    out = None
    for i, s in enumerate(streams):
        s = s.withColumn("y", F.col("y") + (i // horizontal) * height).withColumn("x", F.col("x") + (i % horizontal) * width)
        out = s if out is None else out.unionByName(s)
    return out


def remap(streams: dict[str, DataFrame], channels: list[tuple[str, str, str]]) -> DataFrame:
    """One stream from channels of several: (new name, stream, channel) each; pixels that all of them have."""
    out = None
    for name, stream, channel in channels:
        one = streams[stream].select(*AT, F.col(channel).alias(name))
        out = one if out is None else out.join(one, AT)
    return out


def f_measure(cells: DataFrame, start: int, end: int) -> DataFrame:
    """(mean_f, total_f) over frames from start to end, both included: the mean of the frames' F and the F of summed counts. cells: (frame, tp, fp, fn)."""
    some = cells.where(F.col("frame").between(start, end))
    f = lambda tp, fp, fn: F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(1.0)
    return some.agg(F.avg(f(F.col("tp"), F.col("fp"), F.col("fn"))).alias("mean_f"), f(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("total_f"))


def tight_total(counts: list[float], total: float) -> tuple[int, int]:
    """The shortest [start, end) whose sum reaches the total, of equally short ones the first; counts are bins, so few."""
    best, start, held = None, 0, 0.0
    for end, c in enumerate(counts, 1):
        held += c
        while start < end and held - counts[start] >= total:
            held -= counts[start]
            start += 1
        if held >= total and (best is None or end - start < best[1] - best[0]):
            best = start, end
    if best is None:
        raise ValueError("the counts do not reach the total")
    return best


def background_cuboid(pixels: DataFrame, channels: list[str], percentage: float = 50.0) -> dict[str, tuple[int, int]]:
    """For each channel of whole numbers from 0 to 255, the shortest range that holds the percentage of all pixels; 256 sums a channel."""
    out = {}
    for c in channels:
        n = dict(map(tuple, pixels.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("int")).count().collect()))
        out[c] = tight_total([n.get(v, 0) for v in range(256)], -(-sum(n.values()) * percentage // 100))
    return out


def foreground(pixels: DataFrame, cuboid: dict[str, tuple[int, int]]) -> DataFrame:
    """Set where a channel lies outside its background range."""
    out = F.lit(False)
    for c, (a, b) in cuboid.items():
        out = out | ~F.col(c).between(a, b - 1)
    return pixels.select(*AT, F.coalesce(out, F.lit(False)).cast("int").alias("mask"))
