"""Every query against its reference SQL, on the smallest tables."""

import math
from datetime import datetime, timezone

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tessera.functions import special
from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 3) + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    got = df.collect()
    rel = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(x) for _, x in sorted(zip(names, r))) for r in rel.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in got), key=repr)
    assert len(have) == len(want) and len(want) > 0
    assert have == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_kmeans(spark, sf):
    assert catalog.QUERIES["kmeans"](spark, sf).select("center").distinct().count() > 1


def test_special():
    z = np.array([0.1, 0.5, 1.0, 2.5, 10.0, 100.0])
    assert np.allclose(special.log_gamma(z), [math.lgamma(x) for x in z], rtol=1e-9, atol=1e-9)
    h = 1e-5
    assert np.allclose(special.digamma(z), (special.log_gamma(z + h) - special.log_gamma(z - h)) / (2 * h), rtol=1e-5)
    assert np.allclose(special.trigamma(z), (special.digamma(z + h) - special.digamma(z - h)) / (2 * h), rtol=1e-5)


def test_stream_equals_batch(spark, sf, tmp_path):
    from tessera.streaming import events

    table = spark.read.parquet(f"{sf}/events.parquet")
    folder = f"{tmp_path}/in"
    table.write.parquet(folder)
    q = events.tumbling(events.read(spark, folder, "*.parquet")).writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in rows)
    assert key(spark.table("tumbled").collect()) == key(events.tumbling(table).collect())
