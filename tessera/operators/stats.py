"""Weighted sufficient statistics, entropies, splits and scores as mergeable aggregations.

Running sums go over values that have been aggregated first and are dealt to ranges, so no
task holds a group's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


def histogram(df: DataFrame, label: str, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows and weight of each class."""
    return df.groupBy(*(by or []), label).agg(F.count("*").alias("n"), F.sum(weight if weight is not None else F.lit(1.0)).alias("w"))


def entropy(counts: DataFrame, by: list[str], weight: str = "w") -> DataFrame:
    """Entropy in nats of each group's class weights: log W - sum(w log w) / W, one pass."""
    w = F.col(weight)
    return counts.where(w > 1e-6).groupBy(*by).agg((F.log(F.sum(w)) - F.sum(w * F.log(w)) / F.sum(w)).alias("entropy"))


def gaussian(df: DataFrame, by: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted means, variances and covariance of two features. Sums are taken of distances to the group's mean, so that values far from zero lose no digits; rows with a null feature or weight do not count."""
    rows = df.select(*by, x.cast("double").alias("_x"), y.cast("double").alias("_y"), w.cast("double").alias("_w")).where("_x is not null and _y is not null and _w is not null")
    mean = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_mx"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_my"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    dx, dy, w = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my"), F.col("_w")
    joined = rows.join(mean, on) if by else rows.crossJoin(F.broadcast(mean))
    s = joined.groupBy(*by).agg(F.sum(w).alias("w"), F.first("_mx").alias("mx"), F.first("_my").alias("my"), *(F.sum(w * v).alias(n) for n, v in (("sx", dx), ("sy", dy), ("sxx", dx * dx), ("syy", dy * dy), ("sxy", dx * dy))))
    ex, ey = F.col("sx") / F.col("w"), F.col("sy") / F.col("w")
    return s.select(*by, "w", (F.col("mx") + ex).alias("mean_x"), (F.col("my") + ey).alias("mean_y"), (F.col("sxx") / F.col("w") - ex * ex).alias("var_x"), (F.col("syy") / F.col("w") - ey * ey).alias("var_y"), (F.col("sxy") / F.col("w") - ex * ey).alias("cov"))


def running(df: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    """Adds `run_<c>`: the sum of c over the group's rows up to this one, in the order of distinct values. Rows are dealt to ranges, and what comes before a range is added from totals, of which there are as many as ranges and groups: no task sorts a whole group."""
    rows = df.repartitionByRange(*by, order).sortWithinPartitions(*by, order).withColumn("_p", F.spark_partition_id())
    rows = materialize(rows, "ranges")
    totals = rows.groupBy("_p", *by).agg(*[F.sum(c).alias(f"_t{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_p", *[F.col(c).alias(f"_{c}") for c in by], *[F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0.0)).alias(f"_b{c}") for c in sums])
    own = Window.partitionBy("_p", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(own).alias(f"_l{c}") for c in sums])
    on = [local["_p"] == totals["_p"], *[local[c].eqNullSafe(totals[f"_{c}"]) for c in by]]
    return local.join(totals, on).select(*[local[c] for c in df.columns], *[(F.col(f"_l{c}") + F.col(f"_b{c}")).alias(f"run_{c}") for c in sums])


def split_entropy(total: Column, sums: Column) -> Column:
    """W log W - sum(w log w): a side's entropy times its weight."""
    return F.when(total > 0, total * F.log(total) - sums).otherwise(0.0)


def xlogx(w: Column) -> Column:
    return F.when(w > 0, w * F.log(w)).otherwise(0.0)


def sweep_split(df: DataFrame, value: str, label: str) -> DataFrame:
    """For each threshold, the information gain of `value < threshold`: (threshold, gain). Any number of labels: a side's sum of w log w changes at a value only by the labels that occur there, so it is a running sum itself."""
    counts = df.select(F.col(value).alias("_value"), F.col(label).alias("_own")).dropna().groupBy("_value", "_own").agg(F.count("*").cast("double").alias("c"))
    value, label = "_value", "_own"
    totals = counts.groupBy(F.col(label).alias("_label")).agg(F.sum("c").alias("all"))
    at = running(counts, [label], value, ["c"]).join(totals, F.col(label) == F.col("_label"))
    after, before = F.col("run_c"), F.col("run_c") - F.col("c")
    steps = at.groupBy(value).agg(F.sum("c").alias("c"), F.sum(xlogx(after) - xlogx(before)).alias("lo"), F.sum(xlogx(F.col("all") - after) - xlogx(F.col("all") - before)).alias("hi"))
    s = running(steps, [], value, ["c", "lo", "hi"]).select(value, *[(F.col(f"run_{c}") - F.col(c)).alias(c) for c in ("c", "lo", "hi")])
    whole = totals.agg(F.sum("all").alias("t"), F.sum(xlogx(F.col("all"))).alias("tt"))
    t, left = F.col("t"), F.col("c")
    gain = (split_entropy(t, F.col("tt")) - split_entropy(left, F.col("lo")) - split_entropy(t - left, F.col("tt") + F.col("hi"))) / t
    return s.crossJoin(F.broadcast(whole)).where("c > 0").select(F.col(value).alias("threshold"), gain.alias("gain"))


def gaussian_split(df: DataFrame, value: str, target: str, floor: float = 1e-6) -> DataFrame:
    """For each threshold on a value, what `value < threshold` tells of a continuous target: the entropy of one Gaussian less those of the two sides, (threshold, gain). Sums are taken around the target's mean."""
    rows = df.select(F.col(value).alias("_value"), F.col(target).cast("double").alias("_y")).dropna()
    value = "_value"
    mean = rows.agg(F.avg("_y").alias("_m"))
    d = F.col("_y") - F.col("_m")
    steps = rows.crossJoin(F.broadcast(mean)).groupBy(value).agg(F.count("*").cast("double").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"))
    whole = steps.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    at = running(steps, [], value, ["n", "s", "q"]).select(value, *[(F.col(f"run_{c}") - F.col(c)).alias(c) for c in ("n", "s", "q")]).crossJoin(F.broadcast(whole)).where("n > 0")
    part = lambda n, s, q: n * F.log(F.greatest(q / n - (s / n) * (s / n), F.lit(floor)))
    n, s, q, tn, ts, tq = (F.col(c) for c in ("n", "s", "q", "tn", "ts", "tq"))
    return at.select(F.col(value).alias("threshold"), ((part(tn, ts, tq) - part(n, s, q) - part(tn - n, ts - s, tq - q)) / 2 / tn).alias("gain"))


def category_split(df: DataFrame, category: str, label: str) -> DataFrame:
    """Information gain of each category alone against the rest: (category, gain). Any number of labels: those that a category lacks stay whole on the other side."""
    counts = df.select(F.col(category).alias("_value"), F.col(label).alias("_own")).dropna().groupBy("_value", "_own").agg(F.count("*").cast("double").alias("c"))
    category, label = "_value", "_own"
    totals = counts.groupBy(F.col(label).alias("_label")).agg(F.sum("c").alias("all"))
    at = counts.join(totals, F.col(label) == F.col("_label"))
    own, rest = F.col("c"), F.col("all") - F.col("c")
    s = at.groupBy(category).agg(F.sum(own).alias("l"), F.sum(xlogx(own)).alias("ll"), F.sum(xlogx(rest) - xlogx(F.col("all"))).alias("dh"))
    whole = totals.agg(F.sum("all").alias("t"), F.sum(xlogx(F.col("all"))).alias("tt"))
    t, left = F.col("t"), F.col("l")
    gain = (split_entropy(t, F.col("tt")) - split_entropy(left, F.col("ll")) - split_entropy(t - left, F.col("tt") + F.col("dh"))) / t
    return s.crossJoin(F.broadcast(whole)).select(F.col(category).alias("category"), gain.alias("gain"))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The least value at which the group's cumulative weight reaches one half."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    total = sums.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("w").alias("t"))
    at = running(sums, by, value, ["w"]).join(total, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return at.where(F.col("run_w") >= F.col("t") / 2).groupBy(*by).agg(F.min(value).alias("median"))


def bandwidth(df: DataFrame, by: list[str], x: Column, rule: str, dims: int = 1) -> DataFrame:
    """Scale (inverse bandwidth) by Silverman's or Scott's rule; the deviation is floored at 1e-6."""
    s = df.groupBy(*by).agg(F.count("*").cast("double").alias("w"), F.greatest(F.stddev_pop(x), F.lit(1e-6)).alias("sd"))
    base = F.col("w") * (dims + 2) / 4 if rule == "silverman" else F.col("w")
    return s.select(*by, (1 / (F.col("sd") * F.pow(base, F.lit(-1.0 / (dims + 4))))).alias("scale"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count("*").alias("n"))


def precision_recall(cells: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class recall, precision and F; empty denominators give 1, and F of 0/0 is null."""
    t = cells.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("hit"))
    g = cells.groupBy(F.col(guess).alias("class")).agg(F.sum("n").alias("g"))
    j = t.join(g, "class", "full").fillna(0, ["t", "g", "hit"])
    recall = F.when(F.col("t") > 0, F.col("hit") / F.col("t")).otherwise(1.0)
    precision = F.when(F.col("g") > 0, F.col("hit") / F.col("g")).otherwise(1.0)
    return j.select("class", recall.alias("recall"), precision.alias("precision"), F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).alias("f"))
