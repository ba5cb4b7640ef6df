"""Registered queries of the subpackage against their reference SQL."""

import duckdb
import pytest

from tessera.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf, name):
    sf = sf.replace("0.001", "0.01")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    rel = c.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    df = catalog.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(v for _, v in sorted(zip(names, r))) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) == want
