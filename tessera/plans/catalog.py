"""Queries over the supplied tables, each with its reference SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import classify, density, graph, images, stats, text
from tessera.session import materialize
from tessera.streaming import events

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, without a negative zero."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Flagship: Gaussian classes, Bayes rule, confusion

FIT = f"""e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label AS class, i, count(*) AS n, avg(x) AS mu, greatest(var_pop(x), {classify.FLOOR}) AS v FROM e GROUP BY 1, 2),
s AS (SELECT vec_id, label, class, ln(max(n)::DOUBLE) - sum((x - mu) * (x - mu) / v + ln(v * 2 * pi())) / 2 AS score FROM e JOIN m USING (i) GROUP BY 1, 2, 3)"""


def _scored(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows, classify.scores(rows, classify.fit(rows, "label", "embedding"), "vec_id", "embedding")


@query(f"WITH {FIT}, b AS (SELECT vec_id, label, arg_max(class, score) AS guess FROM s GROUP BY 1, 2) SELECT label, guess, count(*) AS n FROM b GROUP BY 1, 2")
def gaussian_confusion(spark, sf_dir):
    rows, scored = _scored(spark, sf_dir)
    best = classify.posterior(scored, "vec_id").select("vec_id", F.col("best").alias("guess"))
    return stats.confusion(rows.select("vec_id", "label").join(best, "vec_id"), "label", "guess")


def flagship(spark, sf_dir):
    return gaussian_confusion(spark, sf_dir)


@query(f"WITH {FIT} SELECT vec_id, class, round(score, 4) AS score FROM s")
def gaussian_nb_scores(spark, sf_dir):
    return rounded(_scored(spark, sf_dir)[1])


POST = "x AS (SELECT vec_id, max(score) AS m FROM s GROUP BY 1), p AS (SELECT s.vec_id, class, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY s.vec_id) AS p FROM s JOIN x USING (vec_id))"


@query(f"WITH {FIT}, {POST} SELECT vec_id, round(sum(CASE WHEN p > 1e-300 THEN -p * ln(p) ELSE 0 END), 4) AS entropy, round(1 - max(p), 4) AS p_wrong FROM p GROUP BY 1")
def select_entropy(spark, sf_dir):
    return rounded(classify.posterior(_scored(spark, sf_dir)[1], "vec_id").select("vec_id", "entropy", "p_wrong"))


CONC, BASE = 2.0, -20.0


@query(f"WITH {FIT}, x AS (SELECT vec_id, greatest(max(score), {math.log(CONC) + BASE}) AS m FROM s GROUP BY 1) SELECT vec_id, round(exp({math.log(CONC) + BASE} - m) / (sum(exp(score - m)) + exp({math.log(CONC) + BASE} - m)), 4) AS p_new FROM s JOIN x USING (vec_id) GROUP BY vec_id, m")
def bayes_with_new_class(spark, sf_dir):
    return rounded(classify.posterior(_scored(spark, sf_dir)[1], "vec_id", CONC, BASE).select("vec_id", "p_new"))


MEANS = """c AS (SELECT label AS center, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
d AS (SELECT vec_id, label, center, sum((x - m) * (x - m)) AS d2 FROM e JOIN c USING (i) GROUP BY 1, 2, 3)"""


def _centers(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows, density.mean_vectors(rows, F.col("label"), "embedding")


@query(f"WITH {MEANS} SELECT vec_id, arg_min(center, d2) AS center, round(min(d2), 4) AS d2 FROM d GROUP BY 1")
def nearest_center(spark, sf_dir):
    rows, centers = _centers(spark, sf_dir)
    return rounded(density.nearest_center(rows, centers, "vec_id", "embedding"))


@query(f"WITH {MEANS}, a AS (SELECT vec_id, arg_min(center, d2) AS center FROM d GROUP BY 1) SELECT center, i - 1 AS i, round(avg(x), 4) AS x FROM a JOIN e USING (vec_id) GROUP BY 1, 2")
def kmeans_one_step(spark, sf_dir):
    rows, centers = _centers(spark, sf_dir)
    at = density.nearest_center(rows, centers, "vec_id", "embedding", ["embedding"])
    return rounded(density.mean_vectors(at, F.col("center"), "embedding").select("center", F.posexplode("v").alias("i", "x")).withColumn("i", F.col("i").cast("long")))


@query(f"WITH {MEANS}, r AS (SELECT center, vec_id, d2, row_number() OVER (PARTITION BY center ORDER BY d2, vec_id) AS rank FROM d) SELECT center, vec_id, rank::INT AS rank, round(d2, 4) AS d2 FROM r WHERE rank <= 5")
def knn_join(spark, sf_dir):
    rows, centers = _centers(spark, sf_dir)
    return rounded(density.nearest_rows(centers, rows, "vec_id", "embedding", 5))


@query(f"WITH {MEANS}, a AS (SELECT vec_id, label, arg_min(center, d2) AS g FROM d GROUP BY 1, 2), t AS (SELECT label AS class, count(*) AS t, sum((label = g)::INT) AS hit FROM a GROUP BY 1), g AS (SELECT g AS class, count(*) AS g FROM a GROUP BY 1), j AS (SELECT class, coalesce(t, 0) AS t, coalesce(g, 0) AS g, coalesce(hit, 0) AS hit FROM t FULL JOIN g USING (class)), k AS (SELECT class, CASE WHEN t > 0 THEN hit / t ELSE 1 END AS r, CASE WHEN g > 0 THEN hit / g ELSE 1 END AS p FROM j) SELECT class, round(r, 4) AS recall, round(p, 4) AS precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) END, 4) AS f FROM k")
def prf_per_class(spark, sf_dir):
    rows, centers = _centers(spark, sf_dir)
    at = density.nearest_center(rows, centers, "vec_id", "embedding", ["label"])
    return rounded(stats.precision_recall(stats.confusion(at, "label", "center"), "label", "center"))


SVM = {"linear": (1.0, 0.0, "s"), "poly": (2.0, 0.0, "pow(s + 1, 2)"), "rbf": (0.5, 0.0, "exp(-0.5 * d2)"), "sigmoid": (0.5, 0.1, "tanh(s * 0.5 + 0.1)")}


@query(f"WITH {MEANS}, k AS (SELECT vec_id, center, sum(x * m) AS s, sum((x - m) * (x - m)) AS d2 FROM e JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, center, " + ", ".join(f"round({s}, 4) + 0 AS {n}" for n, (_, _, s) in SVM.items()) + " FROM k")
def svm_kernels(spark, sf_dir):
    rows, centers = _centers(spark, sf_dir)
    a, b = F.col("embedding"), F.col("v")
    return rounded(rows.crossJoin(F.broadcast(centers)).select("vec_id", "center", *(kernels.svm(n, a, b, p, q).alias(n) for n, (p, q, _) in SVM.items())))


def kmeans(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return density.nearest_center(rows, density.kmeans(rows, 10, "vec_id", "embedding"), "vec_id", "embedding")


QUERIES["kmeans"] = kmeans

# Text


@query("SELECT letter, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS letter FROM documents) WHERE letter != '' GROUP BY 1")
def letter_counts(spark, sf_dir):
    return text.letter_counts(table(spark, sf_dir, "documents"))


@query("WITH c AS (SELECT string_split(text, '') AS c FROM documents), p AS (SELECT unnest(list_transform(generate_series(1, len(c) - 1), lambda i: c[i] || c[i + 1])) AS pair FROM c) SELECT pair[1] AS a, pair[2] AS b, count(*) AS n FROM p WHERE regexp_matches(pair, '^[A-Za-z ]{2}$') GROUP BY 1, 2")
def bigram_counts(spark, sf_dir):
    return text.bigram_counts(table(spark, sf_dir, "documents"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[.!?]')) + 1 AS sentences, len(regexp_extract_all(text, '\n')) + 1 AS lines, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS words, len(regexp_extract_all(text, '[A-Za-z]')) AS letters, len(regexp_extract_all(text, '[0-9]')) AS digits FROM documents")
def text_metrics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *text.metrics(F.col("text")))


@query("SELECT * FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS block, unnest(string_split(text, chr(10))) AS body FROM documents) WHERE trim(body) != ''")
def paragraph_blocks(spark, sf_dir):
    return text.paragraphs(table(spark, sf_dir, "documents"))


BOW = "w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS word FROM documents), b AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2)"


TEXT_BLOCKS = r"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), h AS (SELECT *, regexp_matches(line, '[A-Za-z]') AS has FROM l), r AS (SELECT *, sum((NOT has)::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS block FROM h), t AS (SELECT doc_id, block, string_agg(trim(replace(line, '_', '')), ' ' ORDER BY pos) AS body FROM r WHERE has GROUP BY 1, 2)"


@query(f"WITH {TEXT_BLOCKS} SELECT doc_id, block, body FROM t")
def text_blocks(spark, sf_dir):
    return text.text_blocks(table(spark, sf_dir, "documents"))


@query(f"WITH {TEXT_BLOCKS}, n AS (SELECT *, regexp_matches(body, '[a-z]') AS low FROM t), c AS (SELECT *, last_value(CASE WHEN NOT low THEN body END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block) AS title FROM n) SELECT doc_id, block, title, body FROM c WHERE low")
def titled_blocks(spark, sf_dir):
    return text.titled_blocks(table(spark, sf_dir, "documents"))


@query(f"WITH {BOW} SELECT * FROM b")
def bow_matrix(spark, sf_dir):
    return text.bag_of_words(table(spark, sf_dir, "documents"))


@query(f"WITH {BOW} SELECT doc_id, sum(n)::BIGINT AS with_repeats, count(*) AS without_repeats FROM b GROUP BY 1")
def document_words(spark, sf_dir):
    return text.bag_of_words(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.sum("n").alias("with_repeats"), F.count("*").alias("without_repeats"))


@query(f"WITH {BOW}, t AS (SELECT lang AS topic, word, sum(n) AS c FROM b JOIN documents USING (doc_id) GROUP BY 1, 2), p AS (SELECT topic, word, (c + 0.1) / (sum(c) OVER (PARTITION BY topic) + (SELECT count(DISTINCT word) FROM b) * 0.1) AS p FROM t) SELECT doc_id, round(sum(-n * ln(p)), 2) AS nll FROM b JOIN documents USING (doc_id) JOIN p ON topic = lang AND p.word = b.word GROUP BY 1")
def doc_nll_under_topics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # The bags are read by three branches, so they are written once.
    bags, topics = materialize(text.bag_of_words(docs), "bags"), docs.select("doc_id", F.col("lang").alias("topic"))
    return rounded(text.topic_nll(bags, topics, text.topic_words(bags, topics, "doc_id", 0.1), "doc_id"), 2)


# Statistics


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS w FROM lineitem GROUP BY 1")
def class_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_quantity"))


@query("WITH c AS (SELECT l_linestatus, l_returnflag, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2) SELECT l_linestatus, round(ln(sum(w)) - sum(w * ln(w)) / sum(w), 6) AS entropy FROM c GROUP BY 1")
def class_entropy(spark, sf_dir):
    return rounded(stats.entropy(stats.histogram(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_quantity"), ["l_linestatus"]), ["l_linestatus"]), 6)


@query("WITH s AS (SELECT l_returnflag, sum(l_quantity) AS w, sum(l_quantity * l_discount) AS sx, sum(l_quantity * l_tax) AS sy, sum(l_quantity * l_discount * l_discount) AS sxx, sum(l_quantity * l_tax * l_tax) AS syy, sum(l_quantity * l_discount * l_tax) AS sxy FROM lineitem GROUP BY 1) SELECT l_returnflag, round(w, 6) AS w, round(sx / w, 6) AS mean_x, round(sy / w, 6) AS mean_y, round(sxx / w - sx / w * sx / w, 6) AS var_x, round(syy / w - sy / w * sy / w, 6) AS var_y, round(sxy / w - sx / w * sy / w, 6) + 0 AS cov FROM s")
def weighted_gaussian_stats(spark, sf_dir):
    return rounded(stats.gaussian(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")), 6)


XLX = "CASE WHEN {0} > 0 THEN {0} * ln({0}) ELSE 0 END"
GAIN = "round((t * ln(t) - tt - (CASE WHEN l > 0 THEN l * ln(l) - ll ELSE 0 END) - (CASE WHEN h > 0 THEN h * ln(h) - hh ELSE 0 END)) / t, 6)"


@query(f"WITH v AS (SELECT DISTINCT l_quantity AS threshold FROM lineitem), c AS (SELECT threshold, l_returnflag, count(*) FILTER (l_quantity < threshold)::DOUBLE AS lo, count(*) FILTER (l_quantity >= threshold)::DOUBLE AS hi FROM v, lineitem GROUP BY 1, 2), s AS (SELECT threshold, sum(lo) AS l, sum(hi) AS h, sum({XLX.format('lo')}) AS ll, sum({XLX.format('hi')}) AS hh, sum(lo + hi) AS t, sum({XLX.format('(lo + hi)')}) AS tt FROM c GROUP BY 1) SELECT threshold, {GAIN} AS gain FROM s WHERE l > 0")
def information_gain_axis(spark, sf_dir):
    return rounded(stats.sweep_split(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag"), 6)


@query(f"WITH v AS (SELECT DISTINCT o_orderpriority AS category FROM orders), c AS (SELECT category, o_orderstatus, count(*) FILTER (o_orderpriority = category)::DOUBLE AS lo, count(*) FILTER (o_orderpriority != category)::DOUBLE AS hi FROM v, orders GROUP BY 1, 2), s AS (SELECT category, sum(lo) AS l, sum(hi) AS h, sum({XLX.format('lo')}) AS ll, sum({XLX.format('hi')}) AS hh, sum(lo + hi) AS t, sum({XLX.format('(lo + hi)')}) AS tt FROM c GROUP BY 1) SELECT category, {GAIN} AS gain FROM s")
def one_category_split(spark, sf_dir):
    return rounded(stats.category_split(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus"), 6)


@query("WITH s AS (SELECT p_brand, p_retailprice AS v, sum(p_size)::DOUBLE AS w FROM part GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY v) AS c, sum(w) OVER (PARTITION BY p_brand) AS t FROM s) SELECT p_brand, min(v) AS median FROM c WHERE c >= t / 2 GROUP BY 1")
def weighted_median(spark, sf_dir):
    return stats.weighted_median(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_size")


def _bandwidth(rule: str, factor: str):
    def f(spark, sf_dir):
        return rounded(stats.bandwidth(table(spark, sf_dir, "customer"), ["c_mktsegment"], F.col("c_acctbal"), rule), 8)

    f.__name__ = f"{rule}_scale"
    query(f"SELECT c_mktsegment, round(1 / (greatest(stddev_pop(c_acctbal), 1e-6) * pow({factor}, -0.2)), 8) AS scale FROM customer GROUP BY 1")(f)


_bandwidth("silverman", "count(*) * 3 / 4.0")
_bandwidth("scott", "count(*)")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return stats.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM labels) SELECT round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(tp + fn, 0), 0), 6) AS fnr, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(100 * (fn + fp) / (tp + fn + fp + tn), 6) AS percent_wrong FROM c")
def change_detection_stats(spark, sf_dir):
    n = lambda t, g: F.count(F.when((F.col("toxic") == t) & (F.col("quality") == 1 - g), 1))
    c = table(spark, sf_dir, "labels").agg(n(1, 1).alias("tp"), n(1, 0).alias("fn"), n(0, 1).alias("fp"), n(0, 0).alias("tn"))
    part = lambda a, *b: F.coalesce(F.try_divide(F.expr(a), F.expr("+".join((a, *b)))), F.lit(0.0))
    return rounded(c.select(part("tp", "fn").alias("recall"), part("tn", "fp").alias("specificity"), part("fp", "tn").alias("fpr"), part("fn", "tp").alias("fnr"), part("tp", "fp").alias("precision"), F.expr("100 * (fn + fp) / (tp + fn + fp + tn)").alias("percent_wrong")), 6)


@query("WITH c AS (SELECT p_size, count(*)::DOUBLE AS n FROM part GROUP BY 1), v AS (SELECT p_size, n / sum(n) OVER (ORDER BY p_size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM c) SELECT p_size, round(v * coalesce(exp(sum(ln(greatest(1 - v, 1e-300))) OVER (ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1), 6) AS weight FROM v")
def stick_breaking(spark, sf_dir):
    """Weights of the sticks v_k = n_k / (n_k + n_k+1 + ...), over the sizes (50 rows after aggregation)."""
    c = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").cast("double").alias("n"))
    w = Window.orderBy("p_size")
    v = c.select("p_size", (F.col("n") / F.sum("n").over(w.rowsBetween(0, Window.unboundedFollowing))).alias("v"))
    rest = F.exp(F.sum(F.log(F.greatest(1 - F.col("v"), F.lit(1e-300)))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rounded(v.select("p_size", (F.col("v") * F.coalesce(rest, F.lit(1.0))).alias("weight")), 6)


# Density

SCALE = 0.002
KERNEL_SQL = {"uniform": "1", "triangular": "1 - d", "epanechnikov": "1 - d * d", "cosine": "cos(d * pi() / 2)", "gaussian": "exp(-0.5 * d * d)", "cauchy": "1 / (1 + d * d)", "logistic": "exp(-d) / pow(1 + exp(-d), 2)"}


def _kde(name: str):
    def f(spark, sf_dir):
        q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("q"))
        return rounded(density.kde(q, table(spark, sf_dir, "customer"), "q", "c_acctbal", name, SCALE), 10)

    f.__name__ = f"kde_prob_{name}"
    query(f"WITH p AS (SELECT s_suppkey AS id, abs(s_acctbal * {SCALE} - c_acctbal * {SCALE}) AS d FROM supplier, customer) SELECT id, round(sum(CASE WHEN d < {kernels.RANGE[name]} THEN {KERNEL_SQL[name]} ELSE 0 END) * {SCALE / kernels.normaliser(name)} / count(*), 10) AS density FROM p GROUP BY 1")(f)


for _name in KERNEL_SQL:
    _kde(_name)


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))


SELF = f"p AS (SELECT a.c_custkey AS id, sum(CASE WHEN abs(a.c_acctbal - b.c_acctbal) * {SCALE} < 3.5 THEN exp(-0.5 * pow((a.c_acctbal - b.c_acctbal) * {SCALE}, 2)) ELSE 0 END) AS s, count(*) AS n FROM customer a JOIN customer b ON {{0}} GROUP BY 1), q AS (SELECT s * {SCALE / kernels.normaliser('gaussian')} / n AS p FROM p)"


@query(f"WITH {SELF.format('a.c_custkey != b.c_custkey')} SELECT round(sum(-ln(greatest(p, 1e-16))), 4) AS nll FROM q")
def kde_loo_nll(spark, sf_dir):
    return rounded(density.loo_nll(_customers(spark, sf_dir), "x", "gaussian", SCALE))


@query(f"WITH {SELF.format('true')} SELECT round(-avg(ln(p)), 6) AS entropy FROM q")
def kde_entropy(spark, sf_dir):
    return rounded(density.density_entropy(_customers(spark, sf_dir), "x", "gaussian", SCALE), 6)


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 50")
def range_join_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    pairs = density.range_join(s.select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x")), s.select(F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("y")), [("x", "y")], 50.0)
    return pairs.where("a < b").select("a", "b")


# Graphs


@query("WITH o AS (SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal - lag(s_acctbal) OVER (ORDER BY s_acctbal) < 50 THEN 0 ELSE 1 END AS g FROM supplier), i AS (SELECT s_suppkey, sum(g) OVER (ORDER BY s_acctbal) AS i FROM o) SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY i) AS component FROM i")
def connected_components(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return nodes.join(graph.components(range_join_pairs(spark, sf_dir)), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((-F.col("l_suppkey")).alias("a"), F.col("l_orderkey").alias("b")).distinct()


EDGES = "e AS (SELECT DISTINCT -l_suppkey AS a, l_orderkey AS b FROM lineitem)"


@query(f"WITH {EDGES}, n AS (SELECT a AS node FROM e UNION ALL SELECT b FROM e), d AS (SELECT node, count(*) AS d FROM n GROUP BY 1) SELECT least(d, 3)::INT AS degree, count(*) AS n FROM d GROUP BY 1")
def degree_census(spark, sf_dir):
    return graph.degree_census(_edges(spark, sf_dir))


@query(f"WITH {EDGES}, v AS (SELECT -s_suppkey AS node, s_acctbal AS value FROM supplier UNION ALL SELECT o_orderkey, o_totalprice FROM orders), b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), m AS (SELECT a AS node, avg(value) AS mean FROM b JOIN v ON v.node = b.b GROUP BY 1) SELECT v.node, round(coalesce(value * 0.7 + mean * 0.3, value), 6) AS value FROM v LEFT JOIN m USING (node)")
def neighbour_smooth(spark, sf_dir):
    values = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("node"), F.col("s_acctbal").alias("value")).unionAll(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    return rounded(graph.neighbour_smooth(_edges(spark, sf_dir), values, 0.3), 6)


# Events


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return rounded(events.tumbling(table(spark, sf_dir, "events")))


@query("WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start, value FROM events) SELECT start, count(*) AS n, round(avg(value), 9) AS mean FROM w GROUP BY 1")
def sliding_avg(spark, sf_dir):
    return rounded(events.sliding(table(spark, sf_dir, "events")), 9)


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS g FROM events), i AS (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, i")
def session_windows(spark, sf_dir):
    return events.sessions(table(spark, sf_dir, "events"))


@query("SELECT event_id, round(CASE WHEN lag(value) OVER w != 0 THEN value / lag(value) OVER w END, 6) AS ratio FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_ratio(spark, sf_dir):
    return rounded(events.lag_ratio(table(spark, sf_dir, "events")), 6)


@query("WITH c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT hour, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY hour ORDER BY n DESC, event_type) = 1")
def hourly_majority(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return events.majority(e, ["hour"], "event_type")


# Sets


@query("SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS value FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")
def union_all(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")).unionAll(s.select(F.lit("s"), "s_suppkey", "s_acctbal"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def except_by_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_rollup(spark, sf_dir):
    return rounded(table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total")))


@query("SELECT p_partkey, round(sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS radius, round(atan2(p_retailprice, p_size), 6) AS angle, round(cos(radians(p_size)), 6) AS cx, round(sin(radians(p_size)), 6) AS cy FROM part")
def vector_converters(spark, sf_dir):
    v = kernels.from_radial(F.array(F.col("p_size").cast("double"), F.col("p_retailprice")))
    a = kernels.to_angle(F.radians("p_size"))
    return rounded(table(spark, sf_dir, "part").select("p_partkey", v[0].alias("radius"), v[1].alias("angle"), a[0].alias("cx"), a[1].alias("cy")), 6)


# Images: each embedding is an 8 x 8 frame of one channel

PIXELS = "p AS (SELECT vec_id AS frame, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, v FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings))"


def _pixels(spark, sf_dir):
    i = F.col("i")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "v")).select("frame", F.floor(i / 8).cast("int").alias("y"), (i % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


@query(f"WITH {PIXELS} SELECT frame, y // 2 AS y, x // 2 AS x, round(avg(v), 6) AS v FROM p GROUP BY 1, 2, 3")
def image_half(spark, sf_dir):
    return rounded(images.half(_pixels(spark, sf_dir), ["v"]), 6)


@query(f"WITH {PIXELS} SELECT frame, y * 2 + a.i::INT AS y, x * 2 + b.i::INT AS x, v FROM p, range(2) AS a(i), range(2) AS b(i)")
def image_step_scale(spark, sf_dir):
    return images.step_scale(_pixels(spark, sf_dir), 2)


@query(f"WITH {PIXELS} SELECT frame, y, 7 - x AS x, v FROM p")
def image_reflect(spark, sf_dir):
    return images.reflect(_pixels(spark, sf_dir), 8, 8)


@query(f"WITH {PIXELS} SELECT frame, y - 2 AS y, x - 1 AS x, v FROM p WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6")
def frame_crop(spark, sf_dir):
    return images.crop(_pixels(spark, sf_dir), 2, 1, 4, 6)


@query(f"WITH {PIXELS} SELECT a.frame, a.y, a.x, round(abs(a.v - b.v) * 100, 6) AS v FROM p a JOIN p b ON a.frame = b.frame AND a.y = b.y AND a.x = 7 - b.x")
def render_difference(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    return rounded(images.difference(p, images.reflect(p, 8, 8), ["v"]), 6)


@query(f"WITH {PIXELS} SELECT a.frame, a.y, a.x, round(a.v - b.v, 6) + 0.0 AS change FROM p a JOIN p b ON a.frame = b.frame + 1 AND a.y = b.y AND a.x = b.x")
def lag_frame(spark, sf_dir):
    return rounded(images.lag_difference(_pixels(spark, sf_dir), "v"), 6)


@query(f"WITH {PIXELS}, t AS (SELECT i - 3 AS o, exp(-0.5 * pow(i - 3, 2)) AS w FROM range(7) AS r(i)), b AS (SELECT frame, (y + o)::INT AS y, x, sum(v * w) / sum(w) AS v FROM p, t WHERE y + o BETWEEN 0 AND 7 GROUP BY 1, 2, 3) SELECT frame, y, (x + o)::INT AS x, round(sum(v * w) / sum(w), 6) AS v FROM b, t WHERE x + o BETWEEN 0 AND 7 GROUP BY 1, 2, 3")
def image_blur(spark, sf_dir):
    return rounded(images.blur(_pixels(spark, sf_dir), "v", 1.0), 6)


@query(f"WITH {PIXELS}, q AS (SELECT frame, y, x, y * 0.8 + x * 0.1 AS py, x * 0.8 + 0.3 AS px FROM p), n AS (SELECT q.frame, q.y, q.x, floor(py)::INT + a.i AS cy, floor(px)::INT + b.i AS cx, abs(1 - a.i - (py - floor(py))) * abs(1 - b.i - (px - floor(px))) AS w FROM q, range(2) AS a(i), range(2) AS b(i)), g AS (SELECT n.frame, n.y, n.x, sum(w * p.v) / sum(w) AS v FROM n JOIN p ON p.frame = n.frame AND p.y = cy AND p.x = cx WHERE w > 1e-12 GROUP BY 1, 2, 3) SELECT p.frame, p.y, p.x, round(g.v, 6) AS v FROM p LEFT JOIN g USING (frame, y, x)")
def image_warp(spark, sf_dir):
    return rounded(images.warp(_pixels(spark, sf_dir), [[0.8, 0.0, 0.3], [0.1, 0.8, 0.0], [0.0, 0.0, 1.0]], "v"), 6)


@query(f"WITH {PIXELS} SELECT frame, round(avg(v) * 255, 6) AS v FROM p GROUP BY 1")
def frame_average(spark, sf_dir):
    return rounded(images.frame_average(_pixels(spark, sf_dir), ["v"], 255.0), 6)


@query(f"WITH {PIXELS}, m AS (SELECT frame, (v > 0)::INT AS t, (lag(v) OVER (PARTITION BY frame, y ORDER BY x) > 0)::INT AS g FROM p) SELECT frame, count(*) FILTER (t = 0 AND g = 0) AS t0g0, count(*) FILTER (t = 0 AND g = 1) AS t0g1, count(*) FILTER (t = 1 AND g = 0) AS t1g0, count(*) FILTER (t = 1 AND g = 1) AS t1g1 FROM m GROUP BY 1")
def mask_stats(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    left = p.select("frame", "y", (F.col("x") + 1).alias("x"), (F.col("v") > 0).cast("int").alias("g"))
    return images.mask_stats(p.withColumn("t", (F.col("v") > 0).cast("int")).join(left, images.AT, "left"), "t", "g")


@query(f"WITH {PIXELS}, m AS (SELECT *, avg(v) OVER (PARTITION BY y, x ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p) SELECT frame, y, x, coalesce(round(abs(v - m), 9) > 0.25, false)::INT AS mask FROM m")
def background_mask(spark, sf_dir):
    return images.background(_pixels(spark, sf_dir), "v", 0.25)


@query(f"WITH {PIXELS}, f AS (SELECT a.frame, a.y, a.x, a.v AS dx, b.v AS dy FROM p a JOIN p b ON a.frame = b.frame AND a.y = b.y AND b.x = 7 - a.x) SELECT frame, y, x, round(CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) / (2 * pi()) + 1 ELSE atan2(dy, dx) / (2 * pi()) END, 6) AS hue, round(least(sqrt(dx * dx + dy * dy) * 2, 1), 6) AS value FROM f")
def flow_render(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    flow = p.withColumnRenamed("v", "dx").join(images.reflect(p, 8, 8).withColumnRenamed("v", "dy"), images.AT)
    return rounded(images.flow_render(flow, 2.0), 6)


@query(f"WITH {PIXELS}, n AS (SELECT max(frame) + 1 AS n FROM p) SELECT frame, y, x, v FROM p UNION ALL SELECT frame + n, y, x, -v FROM p, n")
def seq_concat(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    n = p.agg(F.max("frame") + 1).first()[0] or 0
    return images.concat([p, p.withColumn("v", -F.col("v"))], [n, n])


# Selections


@query(f"WITH {EDGES}, k AS (SELECT -s_suppkey AS node FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT a, b FROM e WHERE a IN (SELECT node FROM k) AND b IN (SELECT node FROM k)")
def induced_subgraph(spark, sf_dir):
    keep = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select((-F.col("s_suppkey")).alias("node")).unionAll(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey"))
    e = _edges(spark, sf_dir)
    return e.join(keep.withColumnRenamed("node", "a"), "a", "left_semi").join(keep.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")


@query("WITH m AS (SELECT DISTINCT lang, source FROM documents) SELECT lang, source, row_number() OVER (ORDER BY lang, source)::INT AS flag FROM m")
def flag_index(spark, sf_dir):
    masks = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return masks.select("lang", "source", F.row_number().over(Window.orderBy("lang", "source")).alias("flag"))


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), p AS (SELECT source, lang, n::DOUBLE / sum(n) OVER (PARTITION BY source) AS p FROM c), q AS (SELECT lang, sum(n)::DOUBLE / (SELECT sum(n) FROM c) AS q FROM c GROUP BY 1) SELECT source, round(sum(p * ln(p / q)), 6) AS kl FROM p JOIN q USING (lang) GROUP BY 1")
def category_divergence(spark, sf_dir):
    c = table(spark, sf_dir, "documents").where("lang is not null and source is not null").groupBy("lang", "source").agg(F.count("*").alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    q = c.groupBy("lang").agg(F.sum("n").alias("q"))
    total = c.agg(F.sum("n").alias("t"))
    return rounded(p.join(q, "lang").crossJoin(F.broadcast(total)).groupBy("source").agg(F.sum(F.col("p") * F.log(F.col("p") * F.col("t") / F.col("q"))).alias("kl")), 6)


@query("SELECT 'lang' AS kind, lang AS flag FROM documents WHERE lang IS NOT NULL UNION SELECT 'source', source FROM documents WHERE source IS NOT NULL")
def merge_flag_sets(spark, sf_dir):
    """The distinct union of two sets of flags."""
    d = table(spark, sf_dir, "documents")
    return d.where("lang is not null").select(F.lit("lang").alias("kind"), F.col("lang").alias("flag")).union(d.where("source is not null").select(F.lit("source"), "source")).distinct()


# Models and solvers that SQL cannot express; tested against brute force and dense algebra.


def chain_labels(spark, sf_dir):
    """Return flags along each supplier's lines, smoothed: a wrong flag costs 1, a change of flag 0.75."""
    from tessera.operators import inference

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chain"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("var"), "l_returnflag").distinct()
    state = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("state"), F.lit(f).alias("f")) for i, f in enumerate("ANR")]))
    costs = lines.select("chain", "var", "l_returnflag", state.alias("s")).select("chain", "var", "s.state", (F.col("s.f") != F.col("l_returnflag")).cast("double").alias("cost"))
    return inference.chain_labels(costs, 0.75)


def gmm_isotropic(spark, sf_dir):
    """Each vector's likeliest component, by EM from the class means until the shares rest."""
    from tessera.operators import mixture

    rows, centers = _centers(spark, sf_dir)
    model, _ = mixture.fit_isotropic(rows, centers.withColumn("center", F.col("center").cast("long")), "vec_id", "embedding")
    resp = mixture.responsibilities(rows, model, "vec_id", "embedding", 64)
    return resp.groupBy("vec_id").agg(F.max_by("center", "r").alias("component"), F.max("r").alias("r"))


def forest_classify(spark, sf_dir):
    """Each vector's label by the trees that did not train on it; by the whole forest, flagged, where all did."""
    from tessera.operators import forest

    rows = table(spark, sf_dir, "embeddings")
    nodes, leaves = forest.train(rows, "vec_id", "label", "embedding")
    return forest.predict(rows, nodes, leaves, "vec_id", "embedding", bag=True).select(F.col("id").alias("vec_id"), "best", "out_of_bag").distinct()


def svm_one_against_one(spark, sf_dir):
    """Each vector's label by the votes of the pairs of classes."""
    from tessera.operators import svm

    rows = table(spark, sf_dir, "embeddings")
    model = svm.train_pairs(rows, "label", "embedding")
    return svm.vote(svm.decisions(rows, model, "vec_id", "embedding")).select(F.col("id").alias("vec_id"), "best")


def topic_shares(spark, sf_dir):
    """Each document's likeliest of eight topics and its negative log likelihood."""
    from tessera.operators import topics
    from tessera.session import materialize

    bow = materialize(text.bag_of_words(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "doc"), "bow")
    shares = topics.fold_words(bow, topics.fit_words(bow, 8), 8)
    return shares.select(F.col("doc").alias("doc_id"), F.array_position("topics", F.array_max("topics")).alias("topic"), "nll")


def dirichlet_mixture(spark, sf_dir):
    """Each part's component and log density under a Dirichlet-process mixture of size and price."""
    from tessera.operators import dirichlet

    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("v"))
    model = dirichlet.fit(rows, "p_partkey", "v", components=6)
    return dirichlet.density(rows, model, "p_partkey", "v").select(F.col("id").alias("p_partkey"), "component", "log_p")


def kde_classes(spark, sf_dir):
    """Each order's status by incremental densities of price and day."""
    import numpy as np

    from tessera.operators import inckde

    o = table(spark, sf_dir, "orders")
    v = F.array(F.col("o_totalprice") / 1e5, F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / 365)
    rows = o.select("o_orderkey", v.alias("v"), F.ascii("o_orderstatus").alias("status"))
    model = inckde.fit(rows, "status", "v", np.eye(2) * 0.05, 12)
    return inckde.classify(rows, model, "o_orderkey", "v").select(F.col("id").alias("o_orderkey"), F.char(F.col("best")).alias("status"))


def background_model(spark, sf_dir):
    """Probability of foreground of each pixel of the embedding frames, the frames before it as background."""
    from tessera.streaming import background

    return background.foreground_batch(_pixels(spark, sf_dir))


def mean_shift(spark, sf_dir):
    """Clusters of supplier balances."""
    from tessera.operators import meanshift

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 800).alias("x"))
    return meanshift.cluster(rows, ["x"], epsilon=1e-2)


QUERIES |= {f.__name__: f for f in (chain_labels, gmm_isotropic, forest_classify, svm_one_against_one, topic_shares, mean_shift, dirichlet_mixture, kde_classes, background_model)}

from tessera.plans import extra  # noqa: E402, F401  (adds its queries to the tables above)
