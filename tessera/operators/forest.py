"""Classification and regression forests grown level by level.

A level costs one aggregation over all trees: every row copy adds its weight to (tree, node,
feature, bin, label) counts, or to sums of a continuous target, which merge before the shuffle; what reaches the driver is one
row for each split. Thresholds are approximate quantiles, so no node's rows are sorted. The
model is a node table, a few thousand rows, broadcast within the size bound.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize, small

#: gain is in nats for each row of the node, weight the rows (bootstrap copies counted) that it holds.
LEAST_VARIANCE = 1e-6
NODES = "tree int, node long, feature int, threshold double, depth int, gain double, weight double"


def poisson(key: Column, seed: Column) -> Column:
    """Poisson(1) copies of a row in a tree, fixed by a hash: bootstrap weights that a retried task repeats."""
    u = F.pmod(F.xxhash64(key, seed), F.lit(1 << 40)) / float(1 << 40)
    p, cut, steps = 1 / math.e, 0.0, []
    for k in range(8):
        cut += p
        p /= k + 1
        steps.append((k, cut))
    out = F.lit(8)
    for k, c in reversed(steps):
        out = F.when(u < c, k).otherwise(out)
    return out


def thresholds(rows: DataFrame, vector: str, bins: int) -> list[list[float]]:
    """Cut points of each feature from one mergeable quantile sketch."""
    d = rows.select(F.max(F.size(vector))).first()[0] or 0
    qs = [(i + 1) / (bins + 1) for i in range(bins)]
    if not d or d < 0:
        return []
    got = rows.select(*[F.col(vector)[i].cast("double").alias(f"f{i}") for i in range(d)]).agg(*[F.percentile_approx(f"f{i}", qs).alias(f"f{i}") for i in range(d)]).first()
    return [sorted(set(got[i] or [])) for i in range(d)]


def _entropy(w: Column, total: Column) -> Column:
    return F.when(w > 0, -w / total * F.log(w / total)).otherwise(0.0)


def _splits(counts: DataFrame, least: float, least_gain: float) -> DataFrame:
    """Best (feature, bin) of each node by information gain; counts (tree, node, feature, bin, label, w). Ties go to the lower feature and bin."""
    at = ["tree", "node", "feature"]
    labels = counts.groupBy(*at, "label").agg(F.sum("w").alias("lw"))
    grid = counts.select(*at, "bin").distinct().join(labels, at)
    full = grid.join(counts, [*at, "bin", "label"], "left").fillna(0.0, ["w"])
    run = Window.partitionBy(*at, "label").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = full.withColumn("left", F.sum("w").over(run)).withColumn("right", F.col("lw") - F.col("left"))
    s = sides.groupBy(*at, "bin").agg(F.sum("left").alias("nl"), F.sum("right").alias("nr"), F.collect_list(F.struct("left", "right", "lw")).alias("all"))
    n = F.col("nl") + F.col("nr")
    part = lambda field, total: F.aggregate("all", F.lit(0.0), lambda a, r: a + _entropy(r[field], total))
    gain = part("lw", n) - F.col("nl") / n * part("left", F.col("nl")) - F.col("nr") / n * part("right", F.col("nr"))
    ok = s.where((F.col("nl") >= least) & (F.col("nr") >= least)).withColumn("gain", gain).where(F.col("gain") > least_gain)
    return ok.groupBy("tree", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), n.alias("n"))).alias("m")).select("tree", "node", (-F.col("m.f")).alias("feature"), (-F.col("m.b")).alias("bin"), "m.gain", "m.n")


def _gaussian_splits(counts: DataFrame, least: float, least_gain: float) -> DataFrame:
    """Best (feature, bin) of each node by how much narrower Gaussians of the two sides are; counts (tree, node, feature, bin, w, s, q): rows, sums and squares around the target's mean."""
    at = ["tree", "node", "feature"]
    run = Window.partitionBy(*at).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*at)
    part = lambda n, s, q: n * F.log(F.greatest(q / n - (s / n) * (s / n), F.lit(LEAST_VARIANCE)))
    t = counts.select(*at, "bin", *[F.sum(c).over(run).alias(f"l{c}") for c in "wsq"], *[F.sum(c).over(whole).alias(f"t{c}") for c in "wsq"])
    l, n = [F.col(f"l{c}") for c in "wsq"], [F.col(f"t{c}") for c in "wsq"]
    ok = t.where((F.col("lw") >= least) & (F.col("tw") - F.col("lw") >= least))
    ok = ok.withColumn("gain", (part(*n) - part(*l) - part(*[a - b for a, b in zip(n, l)])) / 2 / F.col("tw")).where(F.col("gain") > least_gain)
    return ok.groupBy("tree", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.col("tw").alias("n"))).alias("m")).select("tree", "node", (-F.col("m.f")).alias("feature"), (-F.col("m.b")).alias("bin"), "m.gain", "m.n")


def descend(rows: DataFrame, nodes: DataFrame, vector: str) -> DataFrame:
    """Moves each row copy (tree, node, ...) to the child of its node, if that was split; children of node n are 2n and 2n + 1."""
    got = rows.join(small(nodes.select("tree", "node", "feature", "threshold")), ["tree", "node"], "left")
    child = F.col("node") * 2 + F.when(F.get(F.col(vector), F.col("feature")).cast("double") <= F.col("threshold"), 0).otherwise(1)
    return got.withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(child)).drop("feature", "threshold")


def _grow(data: DataFrame, trees: int, depth: int, least: float, least_gain: float, bins: int, sums: list[Column], by: list[str], splits) -> tuple[DataFrame, DataFrame]:
    """(nodes, row copies at their leaves) of data (id, v, label): sums by (tree, node, feature, bin) and further columns decide the splits."""
    spark = data.sparkSession
    cuts = thresholds(data, "v", bins)
    d = len(cuts)
    tree = F.explode(F.array(*[F.lit(t) for t in range(trees)]))
    copies = data.withColumn("tree", tree).withColumn("w", poisson(F.col("id"), F.col("tree")).cast("double")).where("w > 0").withColumn("node", F.lit(1).cast("long"))
    cut_of = F.array(*[F.array(*[F.lit(float(c)) for c in cs]).cast("array<double>") for cs in cuts]) if d else None
    tried = max(1, round(math.sqrt(d))) if d else 0
    found: list[tuple] = []
    for level in range(depth if d else 0):
        order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.struct(F.xxhash64(F.col("tree"), F.col("node"), i).alias("h"), i.alias("i"))))
        picked = copies.select("tree", "node", "label", "w", "v", F.explode(F.slice(order, 1, tried)).alias("o")).withColumn("feature", F.col("o.i"))
        x = F.get(F.col("v"), F.col("feature")).cast("double")
        binned = picked.withColumn("x", x).withColumn("bin", F.size(F.filter(F.get(cut_of, F.col("feature")), lambda c: c < F.col("x"))))
        counts = materialize(binned.where("x is not null").groupBy("tree", "node", "feature", "bin", *by).agg(*sums), "counts")
        best = [r for r in splits(counts, least, least_gain).collect() if r["bin"] < len(cuts[r["feature"]])]  # at most trees * 2^level rows
        if not best:
            break
        new = [(r["tree"], r["node"], r["feature"], cuts[r["feature"]][r["bin"]], level, float(r["gain"]), float(r["n"])) for r in best]
        found += new
        copies = materialize(descend(copies, spark.createDataFrame(new, NODES), "v"), "copies")
    return spark.createDataFrame(found, NODES), copies


def train(rows: DataFrame, id_col: str, label: str, vector: str, trees: int = 8, depth: int = 6, least: int = 4, least_gain: float = 1e-3, bins: int = 31) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): nodes (tree, node, feature, threshold, depth, gain, weight); leaves (tree, node, label, w). Rows without label or vector are left out; an empty table gives empty frames. Each node tries the square root of the features, chosen by a hash."""
    data = rows.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where("label is not null and v is not null")
    nodes, copies = _grow(data, trees, depth, least, least_gain, bins, [F.sum("w").alias("w")], ["label"], _splits)
    return nodes, materialize(copies.groupBy("tree", "node", "label").agg(F.sum("w").alias("w")), "leaves")


def train_regression(rows: DataFrame, id_col: str, target: str, vector: str, trees: int = 8, depth: int = 6, least: int = 4, least_gain: float = 1e-3, bins: int = 31) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) for a continuous target; leaves (tree, node, w, mean, var). Sums are taken around the target's mean."""
    data = rows.select(F.col(id_col).alias("id"), F.col(target).cast("double").alias("label"), F.col(vector).alias("v")).where("label is not null and v is not null")
    middle = data.agg(F.avg("label")).first()[0] or 0.0
    y, w = F.col("label"), F.col("w")
    sums = [F.sum(w).alias("w"), F.sum(w * y).alias("s"), F.sum(w * y * y).alias("q")]
    nodes, copies = _grow(data.withColumn("label", y - middle), trees, depth, least, least_gain, bins, sums, [], _gaussian_splits)
    mean, var = F.col("s") / F.col("w"), F.greatest(F.col("q") / F.col("w") - (F.col("s") / F.col("w")) ** 2, F.lit(0.0))
    return nodes, materialize(copies.groupBy("tree", "node").agg(*sums).select("tree", "node", "w", (mean + middle).alias("mean"), var.alias("var")), "leaves")


def _fallen(rows: DataFrame, nodes: DataFrame, leaves: DataFrame, id_col: str, vector: str, bag: bool) -> DataFrame:
    """(id, tree, node, out_of_bag with `bag`): the leaf of each row in each tree that may answer for it."""
    all_trees = sorted(r["tree"] for r in leaves.select("tree").distinct().collect())
    trees = F.explode(F.array(*[F.lit(t) for t in all_trees]).cast("array<int>"))
    at = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("v is not null")
    if bag:
        out = [poisson(F.col("id"), F.lit(t)) == 0 for t in all_trees]
        at = at.withColumn("out_of_bag", reduce(lambda a, b: a | b, out, F.lit(False)))
    at = at.withColumn("tree", trees).withColumn("node", F.lit(1).cast("long"))
    if bag:
        at = at.where(~F.col("out_of_bag") | (poisson(F.col("id"), F.col("tree")) == 0))
    for level in range((nodes.agg(F.max("depth")).first()[0] or 0) + 1 if nodes.take(1) else 0):
        at = descend(at, nodes.where(F.col("depth") == level), "v")
    return at


def predict_regression(rows: DataFrame, nodes: DataFrame, leaves: DataFrame, id_col: str, vector: str, bag: bool = False) -> DataFrame:
    """(id, mean, var): the trees' Gaussians taken together as one; with `bag` as in `predict`."""
    at = _fallen(rows, nodes, leaves, id_col, vector, bag).join(small(leaves.select("tree", "node", "mean", "var")), ["tree", "node"])
    got = at.groupBy("id", *(["out_of_bag"] if bag else [])).agg(F.avg("mean").alias("mean"), F.avg("var").alias("v"), F.coalesce(F.var_pop("mean"), F.lit(0.0)).alias("between"))
    return got.select("id", *(["out_of_bag"] if bag else []), "mean", (F.col("v") + F.col("between")).alias("var"))


def bag_error(rows: DataFrame, nodes: DataFrame, leaves: DataFrame, id_col: str, target: str, vector: str) -> DataFrame:
    """(n, error): the share of rows that trees which did not train on them get wrong, or for a continuous target the mean squared error."""
    truth = rows.select(F.col(id_col).alias("id"), F.col(target).alias("truth")).where("truth is not null")
    if "mean" in leaves.columns:
        got = predict_regression(rows, nodes, leaves, id_col, vector, True).where("out_of_bag").select("id", "mean")
        return got.join(truth, "id").agg(F.count("*").alias("n"), F.avg((F.col("mean") - F.col("truth")) ** 2).alias("error"))
    got = predict(rows, nodes, leaves, id_col, vector, True).where("out_of_bag").select("id", "best").distinct()
    return got.join(truth, "id").agg(F.count("*").alias("n"), F.avg((F.col("best") != F.col("truth")).cast("double")).alias("error"))


def importance(nodes: DataFrame) -> DataFrame:
    """(feature, importance): each feature's share of all gain, weighted by the rows of the nodes that it splits."""
    sums = nodes.groupBy("feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("g"))
    total = sums.agg(F.sum("g").alias("t"))
    return sums.crossJoin(F.broadcast(total)).select("feature", (F.col("g") / F.col("t")).alias("importance"))


def save(nodes: DataFrame, leaves: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    leaves.write.mode("overwrite").parquet(f"{path}/leaves")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/leaves")


def merge(forests: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One forest of all trees, numbered on. Bootstrap weights follow a tree's number, so only the first forest's trees keep their out-of-bag rows."""
    out, start = None, 0
    for nodes, leaves in forests:
        moved = tuple(f.withColumn("tree", (F.col("tree") + start).cast("int")) for f in (nodes, leaves))
        out = moved if out is None else tuple(a.unionByName(b) for a, b in zip(out, moved))
        start += (leaves.agg(F.max("tree")).first()[0] if leaves.take(1) else -1) + 1
    return out


def predict(rows: DataFrame, nodes: DataFrame, leaves: DataFrame, id_col: str, vector: str, bag: bool = False) -> DataFrame:
    """(id, label, p, best): mean of the trees' leaf distributions, a row for each label seen; with `bag`, only trees that did not train on the row answer (out of bag), the whole forest for a row that all trees trained on, and `out_of_bag` tells which."""
    key = ["id", "out_of_bag"] if bag else ["id"]
    at = _fallen(rows, nodes, leaves, id_col, vector, bag)
    share = leaves.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("tree", "node"))).select("tree", "node", "label", "p")
    votes = at.join(small(share), ["tree", "node"]).groupBy(*key, "label").agg(F.sum("p").alias("p"))
    whole = Window.partitionBy("id")
    p = votes.withColumn("p", F.col("p") / F.sum("p").over(whole))
    return p.withColumn("best", F.max_by("label", F.struct("p", -F.xxhash64("label"))).over(whole))
