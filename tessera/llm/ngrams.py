"""Hashed byte n-grams of many texts at once, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
#: Digits, marks and control characters become a space when only letters count.
LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def gram_keys(texts: list[bytes], orders: tuple[int, ...], buckets: int):
    """Yields, for each order, text number * buckets + bucket of each n-gram; n-grams never cross texts."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    x = flat.astype(np.uint32)
    shift = np.uint32(33 - buckets.bit_length())
    h = np.full(len(x), 7, np.uint32)
    for n in range(1, max(orders) + 1):
        if len(x) < n:
            return
        h = (h[: len(x) - n + 1] ^ x[n - 1 :]) * np.uint32(MIX[n % 4])
        h ^= h >> np.uint32(15)
        if n in orders:
            key = ((h * np.uint32(MIX[(n + 1) % 4])) >> shift).astype(np.int64)
            key += row[: len(key)].astype(np.int64) * buckets
            yield key if n == 1 else key[row[: len(key)] == row[n - 1 :]]


def blocks(items: list, texts: list[bytes], rows: int = 128, size: int = 1_000_000):
    """Slices of at most so many rows and about so many bytes."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if i + 1 - first >= rows or held >= size:
            yield items[first : i + 1], texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield items[first:], texts[first:]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def share(*cols: Column) -> Column:
    """A number from 0 to 1 that these columns alone decide."""
    return (F.xxhash64(*cols, F.lit("share")).bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(1 << 24))).cast("double")


def narrow(docs: DataFrame, *cols: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *cols)


def carried(carry: list[str]) -> list[str]:
    """Names under which columns are carried through a worker, so that none clashes with an operator's own."""
    return [f"carry_{i}" for i in range(len(carry))]


def carrying(docs: DataFrame, carry: list[str], run, schema: str) -> DataFrame:
    """mapInArrow over (doc_id, text) and the columns to carry, which get their own names back behind the schema's; a decision stays with its row, whatever its id."""
    types = dict(docs.dtypes)
    own = [x.split()[0] for x in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{c}`").alias(a) for c, a in zip(carry, carried(carry))))
    out = rows.mapInArrow(run, ", ".join([schema, *(f"{a} {types[c]}" for c, a in zip(carry, carried(carry)))]))
    return out.select(*own, *(F.col(a).alias(c) for c, a in zip(carry, carried(carry)) if c not in own))
