"""URL filters: rules indexed by their rarest literal token; only candidate rules run regular expressions.

Only DataFrame functions. A rule is ``host[/path]``: it fits its host and every
subdomain when the url's path starts with the rule's path; the longest rule wins
(then the longer host, then the larger string). Null urls and urls without ``://``
have empty host and path, so no rule fits and the default verdict holds.
Repeated rows are judged alike; other columns of the input are not carried.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are looked up inside the projection; more are joined by token.
INLINE_RULES = 256
#: Index rows up to which the joined index is broadcast.
BROADCAST_RULES = 200_000
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?`` or ``#``; A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the end of the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    at = rule.find("/")
    return (rule.translate(str.maketrans(UPPER, LOWER)), "") if at < 0 else (rule[:at].translate(str.maketrans(UPPER, LOWER)), rule[at:])


def _literals(rule: str) -> list[str]:
    """Tokens that any url which the rule fits holds as whole tokens: the last one of an open path may go on in the url."""
    h, p = _split(rule)
    found = re.findall("[0-9A-Za-z]+", h) + re.findall(r"[0-9A-Za-z]+(?=[^0-9A-Za-z])", p)
    if not p and re.search("[0-9A-Za-z]$", h):
        return found  # the host ends at a slash, a mark or the end
    return found


def index(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, str, int, int]]:
    """(token, rule, verdict, regex, length, host length); the token is the rule's rarest, '' if it has none."""
    counts = Counter(t for _, r in rules for t in set(_literals(r)))
    out = []
    for verdict, rule in rules:
        h, p = _split(rule)
        token = min(_literals(rule), key=lambda t: (counts[t], -len(t), t), default="")
        quoted = "".join(c if c.isalnum() or c in "/_" else "\\" + c if ord(c) < 128 else c for c in h + p)
        out.append((token, rule, verdict, rf"^(?:[^/]*\.)?{quoted}" if p else rf"^(?:[^/]*\.)?{quoted}(?:/|$)", len(rule), len(h)))
    return out


def tokens(text: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit("([0-9A-Za-z]+)"), F.lit(1)), F.array(F.lit(""))))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """id, host, path, rule (null if none fits), verdict; one row for each input row."""
    rows = index(rules)
    base = pages.select(F.col(id_col).alias(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    at = F.concat("host", "path")
    if len(rows) <= inline:
        by: dict[str, list] = {}
        for token, rule, verdict, regex, n, hn in rows:
            by.setdefault(token, []).append(F.struct(F.lit(n).alias("n"), F.lit(hn).alias("hn"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(regex).alias("regex")))
        if not by:
            return base.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
        table = F.create_map(*[x for t, rs in by.items() for x in (F.lit(t), F.array(*rs))])
        candidates = F.flatten(F.transform(F.filter(tokens(at), lambda t: F.array_contains(F.array(*map(F.lit, by)), t)), lambda t: F.element_at(table, t)))
        best = F.array_max(F.filter(candidates, lambda c: F.rlike(at, c["regex"])))
        return base.withColumn("best", best).select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    spark = pages.sparkSession
    table = spark.createDataFrame(rows, "token string, rule string, verdict string, regex string, n int, hn int")
    table = F.broadcast(table) if len(rows) <= BROADCAST_RULES else table
    best = (
        base.select("host", "path").distinct().withColumn("token", F.explode(tokens(at))).join(table, "token").filter(F.rlike(at, F.col("regex")))
        .groupBy("host", "path").agg(F.max(F.struct("n", "hn", "rule", "verdict")).alias("best"))
    )
    return base.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def _sql() -> str:
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        h, p = _split(rule)
        cases.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{verdict} {rule}'")
    return f"""
WITH u AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
v AS (SELECT *, CASE {" ".join(cases)} END AS best FROM u)
SELECT page_id, host, path, split_part(best, ' ', 2) AS rule, coalesce(split_part(best, ' ', 1), 'allow') AS verdict FROM v"""


QUERIES = {"op1_url_filters": op1_url_filters}
ORACLE_SQL = {"op1_url_filters": _sql()}
