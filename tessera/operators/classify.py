"""Bayesian classification with Gaussian classes, a row for an unseen class, and selection scores for active learning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.density import MODEL_BYTES
from tessera.session import width

FLOOR = 1e-3


def fit(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(class, n, mean, var): diagonal Gaussians from sums that merge; variances are floored."""
    s = rows.select(F.col(label).alias("class"), F.posexplode(vector).alias("i", "x")).select("class", "i", F.col("x").cast("double").alias("x"))
    parts = s.groupBy("class", "i").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.greatest(F.var_pop("x"), F.lit(FLOOR)).alias("v"))
    cols = F.array_sort(F.collect_list(F.struct("i", "m", "v")))
    return parts.groupBy("class").agg(F.max("n").alias("n"), F.transform(cols, lambda s: s["m"]).alias("mean"), F.transform(cols, lambda s: s["v"]).alias("var"))


def small_model(model: DataFrame) -> DataFrame:
    """The model, if its bytes allow it to be sent to every task."""
    n, held = model.agg(F.count("*"), F.sum(width(model))).first()
    if (held or 0) > MODEL_BYTES:
        raise ValueError(f"a model of {n} classes and {held} bytes; the limit is {MODEL_BYTES}")
    return model


def scores(rows: DataFrame, model: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, class, log posterior up to a constant); the model, a row for each class, is broadcast."""
    z = F.zip_with(vector, "mean", lambda x, m: x.cast("double") - m)
    terms = F.zip_with(z, "var", lambda d, v: d * d / v + F.log(v * (2 * math.pi)))
    nll = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2
    return rows.crossJoin(F.broadcast(small_model(model))).select(id_col, "class", (F.log(F.col("n").cast("double")) - nll).alias("score"))


def posterior(scored: DataFrame, id_col: str, concentration: float = 0.0, base: float = 0.0) -> DataFrame:
    """Per row: best class, entropy of the posterior, P(new class) from a Dirichlet-process prior with a constant log density `base`, and P(best is wrong)."""
    top = scored.groupBy(id_col).agg(F.max("score").alias("m"), F.max_by("class", F.struct("score", -F.col("class"))).alias("best"), F.collect_list("score").alias("all"))
    shift = F.greatest(F.col("m"), F.lit(math.log(concentration) + base)) if concentration else F.col("m")
    total = F.aggregate(F.transform("all", lambda s: F.exp(s - shift)), F.lit(0.0), lambda a, b: a + b)
    new = F.exp(F.lit(math.log(concentration) + base) - shift) if concentration else F.lit(0.0)
    t = top.withColumn("t", total).withColumn("new", new).withColumn("all", F.transform("all", lambda s: F.exp(s - shift))).withColumn("m", F.col("m") - shift)
    p = F.transform("all", lambda e: e / F.col("t"))
    ent = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 1e-300, x * F.log(x)).otherwise(0.0))
    return t.select(id_col, "best", ent.alias("entropy"), (F.col("new") / (F.col("t") + F.col("new"))).alias("p_new"), (1 - F.exp("m") / (F.col("t") + F.col("new"))).alias("p_wrong"))


def posterior_nll(scored: DataFrame, truth: DataFrame, id_col: str) -> DataFrame:
    """(nll, n): negative log posterior of the true classes, summed; truth: (id, class). Classes that the model lacks count with the floor 1e-300."""
    norm = scored.groupBy(id_col).agg(F.max("score").alias("m"), F.collect_list("score").alias("all"))
    norm = norm.select(id_col, (F.col("m") + F.log(F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("m"))))).alias("norm"))
    own = truth.join(scored, [id_col, "class"], "left").join(norm, id_col)
    return own.agg(F.sum(-F.coalesce(F.col("score") - F.col("norm"), F.lit(math.log(1e-300)))).alias("nll"), F.count("*").alias("n"))


def _draw(id_col: str, seed: int):
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed)))


def subsample(rows: DataFrame, id_col: str, share: float, seed: int = 0) -> DataFrame:
    """About this share of the rows, by a hash of the id: no row depends on another, so nothing is shuffled."""
    return rows.where(F.conv(F.substring(_draw(id_col, seed), 1, 8), 16, 10).cast("double") < share * 2**32)


def select_random(pool: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """One row of the pool, by a hash of its id: the same one however the pool is dealt."""
    return pool.orderBy(_draw(id_col, seed), id_col).limit(1)


def select_random_by_label(pool: DataFrame, id_col: str, label: str, seed: int = 0) -> DataFrame:
    """(label, id): one row of each label, by a hash of its id."""
    return pool.groupBy(label).agg(F.min_by(id_col, F.struct(_draw(id_col, seed), id_col)).alias(id_col))


def select_outlier(scored: DataFrame, id_col: str, k: int = 1) -> DataFrame:
    """(id, density): the rows that all classes together explain least, by the log of their summed weights."""
    top = scored.groupBy(id_col).agg(F.max("score").alias("m"), F.collect_list("score").alias("all"))
    total = F.col("m") + F.log(F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("m"))))
    return top.select(id_col, total.alias("density")).orderBy("density", id_col).limit(k)


def committee(scored: list[DataFrame], id_col: str) -> DataFrame:
    """(id, disagreement): one less the largest share of models that agree on a row's class."""
    votes = None
    for s in scored:
        best = s.groupBy(id_col).agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("class"))
        votes = best if votes is None else votes.unionAll(best)
    n = votes.groupBy(id_col, "class").agg(F.count("*").alias("n"))
    return n.groupBy(id_col).agg((1 - F.max("n") / F.sum("n")).alias("disagreement"))
