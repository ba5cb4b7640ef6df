import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffixdedup as sd


def brute(rows, depth=50):
    """{row number: (bytes, removed, spans, sha of what stays)}"""
    first: dict = {}
    for d, t in rows:
        x = (t or "").encode()
        if d is not None:
            for p in range(len(x) - depth + 1):
                w = x[p : p + depth]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        x = (t or "").encode()
        gone = bytearray(len(x) + 1)
        if d is not None:
            for p in range(len(x) - depth + 1):
                if first[x[p : p + depth]] < d:
                    gone[p : p + depth] = b"\1" * depth
        spans = sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def rows_of(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()], key=lambda r: (r[0] is None, r))


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in sd.op10_suffix_dedup(spark, sf).collect())
    want = brute(rows)
    assert sum(r[2] for r in want) > 0 and got == want


@pytest.mark.parametrize("shard", [sd.SHARD, 3000])
def test_edges(spark, shard, monkeypatch):
    monkeypatch.setattr(sd, "SHARD", shard)
    monkeypatch.setattr(sd, "ARRAY", shard // 4)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, period = text(120), "ab" * 90
    rows = [(9, None), (8, ""), (7, "x"), (6, "y" * 50), (5, "y" * 49), (4, "y" * 51), (3, "z" * 500), (2, "z" * 300), (1, period), (20, "q" + period[:-3]), (21, period[1:] + "r")]
    for i in range(30, 70):
        rows.append((i, text(rng.randrange(200)) + passage[rng.randrange(40) : rng.randrange(80, 120)] + text(rng.randrange(200))))
    whole = text(400)
    for i in range(100, 130):
        c = list(whole)
        for _ in range(3):
            c[rng.randrange(len(c))] = rng.choice("XYZ")
        rows.append((i, "".join(c)))
    rows += [(i, whole) for i in range(140, 150)] + [(None, whole), (None, None), (140, whole), (150, text(100) * 2), (151, "漢字" * 60), (152, "字漢" * 60)]
    rng.shuffle(rows)
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, n int").repartition(3)
    assert rows_of(sd.remove_repeats(d)) == brute(rows)
    assert sd.remove_repeats(d.limit(0)).count() == 0


def test_repeated_ids(spark):
    """An id on two texts: each row loses what smaller ids hold, and nothing else."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one, two, three = text(90), text(120), text(70)
    rows = [(1, one + text(30)), (2, two + text(40)), (5, text(20) + two + text(70)), (5, text(33) + one + text(87)), (5, one), (5, one), (5, three * 3), (5, three * 3), (5, three), (7, three), ((1 << 60) + 1, two), ((1 << 60) + 2, text(15) + two + "x"), ((1 << 60) + 3, "tail " * 30), ((1 << 60) + 4, "tail " * 30 + "x"), (None, one), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(sd.remove_repeats(d)) == brute(rows)


def test_suffix_array_decides(spark, sf, monkeypatch):
    """Without the suffix arrays' classes the repeats within a shard stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    whole = sum(r[2] for r in rows_of(sd.remove_repeats(docs)))
    x = np.frombuffer(b"x" * 30 + bytes(range(100)) * 2 + b"y" * 30, np.uint8)
    gone = sd.repeats_in_shard(x, np.array([130, 130]), np.array([3, 4]))
    assert whole > 0 and gone.sum() == 51 and not gone[:81].any() and gone[81:132].all()


def test_anchor_buckets():
    """Anchors fall evenly into buckets although each is a least hash."""
    x = np.random.default_rng(1).integers(97, 123, 400_000).astype(np.uint8)
    anchor = np.unique(sd.blocks(x, np.array([len(x)]), False)[3])
    for lead in (5, 8):
        n = np.bincount((anchor >> np.uint64(64 - lead)).astype(np.int64), minlength=1 << lead)
        assert n.max() < 2 * n.mean()


def test_suffix_array():
    rng = np.random.default_rng(0)
    for x in (rng.integers(97, 100, 3000, dtype=np.uint8), np.full(300, 97, np.uint8), np.frombuffer(b"banana" * 40, np.uint8), np.zeros(1, np.uint8), np.tile(rng.integers(97, 99, 700, dtype=np.uint8), 5)):
        raw = x.tobytes()
        sa, ties = sd.suffix_array(x, 50)
        cut = [raw[i : i + 50] for i in sa]
        assert sorted(sa.tolist()) == list(range(len(x)))
        assert all(a <= b for a, b in zip(cut, cut[1:]) if len(a) == len(b) == 50)
        lcp = sd.common_prefixes(x, sa, ties, 50)
        for r in range(1, len(sa)):
            a, b = raw[sa[r - 1] :][:50], raw[sa[r] :][:50]
            n = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            if len(a) == len(b) == 50:
                assert lcp[r] == n
