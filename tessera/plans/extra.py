"""More queries with their reference SQL: model selection, active learning, masks, chains, text lines, relational forms."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import classify, density, inference, masks, stats, text
from tessera.plans.catalog import PIXELS, SCALE, _centers, _customers, _pixels, query, rounded, table

SCALES = [SCALE / 2, SCALE, SCALE * 2]
NORM = kernels.normaliser("gaussian")
BY_SCALE = " UNION ALL ".join(f"SELECT {s!r}::DOUBLE AS scale" for s in SCALES)


@query(f"WITH z AS ({BY_SCALE}), p AS (SELECT scale, a.c_custkey AS id, sum(CASE WHEN abs(a.c_acctbal - b.c_acctbal) * scale < 3.5 THEN exp(-0.5 * pow((a.c_acctbal - b.c_acctbal) * scale, 2)) ELSE 0 END) * scale / {NORM!r} / count(*) AS p FROM z, customer a JOIN customer b ON a.c_custkey != b.c_custkey GROUP BY 1, 2) SELECT scale, round(sum(-ln(greatest(p, 1e-16))), 3) AS nll FROM p GROUP BY 1")
def scale_loo_grid(spark, sf_dir):
    """Bandwidths by the likelihood of each row under the others."""
    return rounded(density.best_scale(_customers(spark, sf_dir), "x", "gaussian", SCALES).withColumn("nll", F.round("nll", 3)), 12)


@query(f"WITH k AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier), d AS (SELECT a.id, avg(CASE WHEN abs(a.x - b.x) * {SCALE} < 3.5 THEN exp(-0.5 * pow((a.x - b.x) * {SCALE}, 2)) ELSE 0 END) * {SCALE / NORM!r} AS p FROM k a, k b GROUP BY 1), e AS (SELECT a.id, avg(CASE WHEN abs(a.x - c_acctbal) * {SCALE} < 3.5 THEN exp(-0.5 * pow((a.x - c_acctbal) * {SCALE}, 2)) ELSE 0 END) * {SCALE / NORM!r} AS q FROM k a, customer GROUP BY 1) SELECT round(avg(ln(greatest(p, 1e-16)) - ln(greatest(q, 1e-16))), 5) AS kl FROM d JOIN e USING (id)")
def density_divergence(spark, sf_dir):
    """Divergence of the customers' balances from the suppliers' as densities."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    return rounded(density.kl_divergence(s, _customers(spark, sf_dir).select("x"), "x", "gaussian", SCALE, SCALE), 5)


MEANS = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label AS c, i, avg(x) AS m FROM e GROUP BY 1, 2)"


@query(f"WITH {MEANS}, d AS (SELECT vec_id, c, sum((x - m) * (x - m)) AS d2 FROM e JOIN m USING (i) GROUP BY 1, 2), b AS (SELECT vec_id, min(d2) AS d2, arg_min(c, d2) AS c FROM d GROUP BY 1), g AS (SELECT c, count(*)::DOUBLE AS n, sum(d2) AS s FROM b GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(s) AS s, sum(n * ln(n)) AS clc FROM g), v AS (SELECT *, s / (n - k) AS var FROM t) SELECT round(s / (2 * var) + n / 2 * 64 * ln(2 * pi() * var) - (clc - n * ln(n)), 4) AS nll, round(var, 6) AS var, n::BIGINT AS n, k FROM v")
def kmeans_likelihood(spark, sf_dir):
    """Likelihood of vectors at their nearest class means."""
    rows, centers = _centers(spark, sf_dir)
    out = density.kmeans_nll(rows, centers, "vec_id", "embedding")
    return out.select(F.round("nll", 4).alias("nll"), F.round("var", 6).alias("var"), "n", "k")


FIT = f"""e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label AS class, i, count(*) AS n, avg(x) AS mu, greatest(var_pop(x), {classify.FLOOR}) AS v FROM e GROUP BY 1, 2),
s AS (SELECT vec_id, label, class, ln(max(n)::DOUBLE) - sum((x - mu) * (x - mu) / v + ln(v * 2 * pi())) / 2 AS score FROM e JOIN m USING (i) GROUP BY 1, 2, 3),
z AS (SELECT vec_id, max(score) AS top FROM s GROUP BY 1), t AS (SELECT vec_id, max(top) + ln(sum(exp(score - top))) AS total FROM s JOIN z USING (vec_id) GROUP BY 1)"""


def _scored(spark, sf_dir, part=None):
    rows = table(spark, sf_dir, "embeddings")
    if part:
        rows = rows.withColumn("embedding", F.slice("embedding", *part))
    return rows, classify.scores(rows, classify.fit(rows, "label", "embedding"), "vec_id", "embedding")


@query(f"WITH {FIT} SELECT round(sum(total - score), 4) AS nll, count(*) AS n FROM s JOIN t USING (vec_id) WHERE class = label")
def classifier_nll(spark, sf_dir):
    """Negative log posterior of the vectors' own classes."""
    rows, scored = _scored(spark, sf_dir)
    return rounded(classify.posterior_nll(scored, rows.select("vec_id", F.col("label").alias("class")), "vec_id"))


@query(f"WITH {FIT} SELECT vec_id, round(total, 4) AS density FROM t ORDER BY total, vec_id LIMIT 10")
def select_outlier(spark, sf_dir):
    """The ten vectors that all classes together explain least."""
    return rounded(classify.select_outlier(_scored(spark, sf_dir)[1], "vec_id", 10))


def _votes(a: int, b: int) -> str:
    return f"SELECT vec_id, arg_max(class, score) AS class FROM (SELECT vec_id, class, ln(max(n)::DOUBLE) - sum((x - mu) * (x - mu) / v + ln(v * 2 * pi())) / 2 AS score FROM e JOIN m USING (i) WHERE i BETWEEN {a} AND {b} GROUP BY 1, 2) GROUP BY 1"


@query(f"WITH {FIT}, w AS ({_votes(1, 21)} UNION ALL {_votes(22, 42)} UNION ALL {_votes(43, 64)}), n AS (SELECT vec_id, class, count(*) AS n FROM w GROUP BY 1, 2) SELECT vec_id, round(1 - max(n) / sum(n), 6) AS disagreement FROM n GROUP BY 1")
def select_committee(spark, sf_dir):
    """How far three classifiers on a third of the components each disagree."""
    return rounded(classify.committee([_scored(spark, sf_dir, p)[1] for p in ((1, 21), (22, 21), (43, 22))], "vec_id"), 6)


@query("SELECT label, arg_min(vec_id, md5(vec_id::VARCHAR || ':3')) AS vec_id FROM embeddings WHERE label IS NOT NULL GROUP BY 1")
def select_random_by_label(spark, sf_dir):
    return classify.select_random_by_label(table(spark, sf_dir, "embeddings").where("label is not null"), "vec_id", "label", 3)


@query("SELECT vec_id FROM embeddings ORDER BY md5(vec_id::VARCHAR || ':1') LIMIT 1")
def select_random(spark, sf_dir):
    return classify.select_random(table(spark, sf_dir, "embeddings"), "vec_id", 1).select("vec_id")


@query("SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5(o_orderkey::VARCHAR || ':0'), 1, 8))::BIGINT < 0.1 * 4294967296")
def subsample(spark, sf_dir):
    """A tenth of the orders; the share is the feature."""
    return classify.subsample(table(spark, sf_dir, "orders"), "o_orderkey", 0.1).select("o_orderkey")


@query("WITH s AS (SELECT l_returnflag, var_pop(l_extendedprice) AS a, var_pop(l_tax) AS b, covar_pop(l_extendedprice, l_tax) AS c FROM lineitem GROUP BY 1) SELECT l_returnflag, round(ln(2 * pi() * exp(1) * greatest(a, 1e-6)) / 2, 6) AS entropy, round(ln(pow(2 * pi() * exp(1), 2) * (a * b - c * c)) / 2, 6) AS joint FROM s")
def gaussian_entropies(spark, sf_dir):
    """Entropies of one and of two features as Gaussians."""
    g = stats.gaussian(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), F.col("l_tax"), F.lit(1.0))
    e = 2 * math.pi * math.e
    return rounded(g.select("l_returnflag", (F.log(e * F.greatest("var_x", F.lit(1e-6))) / 2).alias("entropy"), (F.log(e * e * (F.col("var_x") * F.col("var_y") - F.col("cov") * F.col("cov"))) / 2).alias("joint")), 6)


@query("WITH c AS (SELECT l_quantity AS v, count(*)::DOUBLE AS n, sum(l_extendedprice - 38000) AS s, sum(pow(l_extendedprice - 38000, 2)) AS q FROM lineitem GROUP BY 1), r AS (SELECT v, sum(n) OVER w - n AS n, sum(s) OVER w - s AS s, sum(q) OVER w - q AS q, sum(n) OVER () AS tn, sum(s) OVER () AS ts, sum(q) OVER () AS tq FROM c WINDOW w AS (ORDER BY v)) SELECT v AS threshold, round((tn * ln(tq / tn - pow(ts / tn, 2)) - n * ln(q / n - pow(s / n, 2)) - (tn - n) * ln((tq - q) / (tn - n) - pow((ts - s) / (tn - n), 2))) / 2 / tn, 6) AS gain FROM r WHERE n > 0")
def regression_split(spark, sf_dir):
    """What each threshold on the quantity tells of the price as a Gaussian."""
    return rounded(stats.gaussian_split(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 6)


@query("SELECT label, i, round(quantile_cont(x, 0.5), 6) AS threshold FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2")
def median_splits(spark, sf_dir):
    """The median threshold of every component in every class."""
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return rounded(x.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.percentile(F.col("x").cast("double"), 0.5).alias("threshold")), 6)


@query("SELECT s_suppkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, row_number() OVER v AS row, ntile(4) OVER v AS quarter, round(percent_rank() OVER w, 6) AS percent FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000)), v AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)")
def ranking(spark, sf_dir):
    w = Window.partitionBy("s_nationkey").orderBy(F.round(F.col("s_acctbal") / 1000))
    v = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.row_number().over(v).alias("row"), F.ntile(4).over(v).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("percent"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def except_keys(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).exceptAll(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_nationkey").distinct())


@query("SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::INT) AS k FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, count(*) AS n, sum(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS days, count_if(l_shipdate > o_orderdate + INTERVAL 60 DAY) AS late FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def date_parts(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    late = F.count_if(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAY"))
    return j.groupBy(F.year("o_orderdate").cast("long").alias("year"), F.quarter("o_orderdate").cast("long").alias("quarter")).agg(F.count("*").alias("n"), F.sum(F.date_diff("l_shipdate", "o_orderdate")).alias("days"), late.alias("late"))


@query("SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL")
def distinct_labels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label").where("label is not null").distinct()


MASK = f"{PIXELS}, k AS (SELECT frame, y, x, (v > 0.05)::INT AS mask FROM p)"


def _mask(spark, sf_dir):
    return _pixels(spark, sf_dir).select("frame", "y", "x", (F.col("v") > 0.05).cast("int").alias("mask"))


@query(f"WITH {MASK} SELECT a.frame, a.y, a.x, max(b.mask) AS mask FROM k a JOIN k b ON a.frame = b.frame AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3")
def mask_dilate(spark, sf_dir):
    return masks.dilate(_mask(spark, sf_dir))


@query(f"WITH {MASK}, d AS (SELECT a.frame, a.y, a.x, max(b.mask) AS mask FROM k a JOIN k b ON a.frame = b.frame AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3) SELECT a.frame, a.y, a.x, min(b.mask) AS mask FROM d a JOIN d b ON a.frame = b.frame AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3")
def mask_smooth(spark, sf_dir):
    return masks.smooth(_mask(spark, sf_dir))


@query(f"WITH {MASK} SELECT a.frame, a.y, a.x, (a.mask > 0 AND max(CASE WHEN a.y != b.y OR a.x != b.x THEN b.mask ELSE 0 END) > 0)::INT AS mask FROM k a JOIN k b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3, a.mask")
def mask_cull_lonely(spark, sf_dir):
    return masks.cull_lonely(_mask(spark, sf_dir))


@query(f"WITH {MASK} SELECT frame, y, x, CASE WHEN y BETWEEN 1 AND 5 AND x BETWEEN 2 AND 6 THEN mask ELSE 0 END AS mask FROM k")
def mask_clip(spark, sf_dir):
    return masks.clip(_mask(spark, sf_dir), 8, 8, top=1, bottom=2, left=2, right=1)


@query(f"WITH {PIXELS} SELECT a.frame, a.y, a.x, round(median(b.v), 6) AS v FROM p a JOIN p b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3")
def image_median(spark, sf_dir):
    return rounded(masks.median_filter(_pixels(spark, sf_dir), "v"), 6)


@query(f"WITH {MASK} SELECT frame, y, x, CASE WHEN mask > 0 THEN v ELSE 0 END AS dx, CASE WHEN mask > 0 THEN -v ELSE 0 END + 0.0 AS dy FROM p JOIN k USING (frame, y, x)")
def flow_masked(spark, sf_dir):
    flow = _pixels(spark, sf_dir).select("frame", "y", "x", F.col("v").alias("dx"), (-F.col("v")).alias("dy"))
    got = masks.mask_flow(flow, _mask(spark, sf_dir))
    return got.select("frame", "y", "x", "dx", (F.col("dy") + 0.0).alias("dy"))


@query(f"WITH {PIXELS}, b AS (SELECT frame, y, x, (v >= 0.5 / 255)::INT AS mask FROM p) SELECT a.frame, a.y, a.x, a.mask, (min(b.mask) = max(b.mask))::INT AS valid FROM b a JOIN b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3, 4")
def mask_ground_truth(spark, sf_dir):
    return masks.ground_truth(_pixels(spark, sf_dir), ["v"])


@query(f"WITH {PIXELS} SELECT frame, y, x, (abs(round(v, 1) - 0.1) < 0.001)::INT AS mask, (abs(round(v, 1) - 0.1) < 0.001 OR abs(round(v, 1)) < 0.001)::INT AS valid FROM p")
def mask_from_colours(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    return masks.from_colours(p.withColumn("v", F.round("v", 1)), ["v"], [(0.1,)], [(0.0,)])


@query(f"WITH {PIXELS} SELECT frame - 100 AS frame, y, x, v FROM p WHERE frame BETWEEN 100 AND 149")
def frames_crop(spark, sf_dir):
    return masks.frame_crop(_pixels(spark, sf_dir), 100, 50)


@query(f"WITH {PIXELS} SELECT frame, y, x, v FROM p UNION ALL SELECT frame, y, x + 8, -v FROM p UNION ALL SELECT frame, y + 8, x, v * 2 FROM p")
def frames_grid(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    return masks.combine_grid([p, p.withColumn("v", -F.col("v")), p.withColumn("v", F.col("v") * 2)], 8, 8, 2)


@query(f"WITH {PIXELS}, g AS (SELECT frame, v > 0 AS t, x % 2 = 0 AS g FROM p), c AS (SELECT frame, count_if(t AND g)::DOUBLE AS tp, count_if(g AND NOT t)::DOUBLE AS fp, count_if(t AND NOT g)::DOUBLE AS fn FROM g GROUP BY 1) SELECT round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS mean_f, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS total_f FROM c WHERE frame BETWEEN 20 AND 120")
def f_over_frames(spark, sf_dir):
    p = _pixels(spark, sf_dir).select("frame", (F.col("v") > 0).alias("t"), (F.col("x") % 2 == 0).alias("g"))
    cells = p.groupBy("frame").agg(F.count_if(F.col("t") & F.col("g")).alias("tp"), F.count_if(F.col("g") & ~F.col("t")).alias("fp"), F.count_if(F.col("t") & ~F.col("g")).alias("fn"))
    return rounded(masks.f_measure(cells, 20, 120), 6)


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


@query(f"WITH {LINES} SELECT doc_id, pos::INT AS pos, line FROM l WHERE pos BETWEEN 1 AND 3")
def lines_between(spark, sf_dir):
    return text.trim_lines(table(spark, sf_dir, "documents"), 2, 5)


@query(f"WITH {LINES} SELECT doc_id, pos::INT AS pos, trim(line, ' ') AS line FROM l WHERE NOT (starts_with(line, 'The') OR starts_with(line, 'And'))")
def lines_without_starts(spark, sf_dir):
    return text.skip_starts_with(text.lines(table(spark, sf_dir, "documents")), ["The", "And"])


CHAIN = "v AS (SELECT DISTINCT l_suppkey AS chain, l_orderkey * 10 + l_linenumber AS var, l_returnflag AS f FROM lineitem), w AS (SELECT chain, var, sum((f != 'A')::INT)::DOUBLE AS a, sum((f != 'N')::INT)::DOUBLE AS b, sum((f != 'R')::INT)::DOUBLE AS c FROM v GROUP BY 1, 2), u AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY var) AS n, row_number() OVER (PARTITION BY chain ORDER BY var DESC) AS m FROM w)"


def _step(name: str, at: str) -> str:
    best = lambda x, y, z: f"least({x}, {y} + 0.75, {z} + 0.75)::DOUBLE"
    return f"{name} AS (SELECT chain, {at} AS k, a, b, c FROM u WHERE {at} = 1 UNION ALL SELECT u.chain, u.{at}, u.a + {best('r.a', 'r.b', 'r.c')}, u.b + {best('r.b', 'r.a', 'r.c')}, u.c + {best('r.c', 'r.a', 'r.b')} FROM {name} r JOIN u ON u.chain = r.chain AND u.{at} = r.k + 1)"


@query(f"WITH RECURSIVE {CHAIN}, {_step('ahead', 'n')}, {_step('back', 'm')}, t AS (SELECT u.chain, u.var, p.a + q.a - u.a AS a, p.b + q.b - u.b AS b, p.c + q.c - u.c AS c FROM u JOIN ahead p ON p.chain = u.chain AND p.k = u.n JOIN back q ON q.chain = u.chain AND q.k = u.m) SELECT chain, var, 0::BIGINT AS state, a AS total FROM t UNION ALL SELECT chain, var, 1, b FROM t UNION ALL SELECT chain, var, 2, c FROM t")
def chain_costs(spark, sf_dir):
    """For every flag of every line of a supplier, the cost of the best smoothing that has it."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chain"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("var"), "l_returnflag").distinct()
    state = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("state"), F.lit(f).alias("f")) for i, f in enumerate("ANR")]))
    costs = lines.select("chain", "var", "l_returnflag", state.alias("s")).select("chain", "var", "s.state", (F.col("s.f") != F.col("l_returnflag")).cast("double").alias("cost"))
    return inference.chain_min_marginals(costs, inference.pair_different(3, 0.75))
