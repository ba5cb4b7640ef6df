"""Queries and reference SQL of this subpackage."""

from tessera.llm import langid, ngramjoin, packing, quality, sharding, suffixdedup, tokenize, urlfilter, vectors

MODULES = (urlfilter, tokenize, packing, ngramjoin, vectors, sharding, langid, quality, suffixdedup)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
