import random
import re

from tessera.llm import ngramjoin
from tests.llm.test_vectors import brute_components


def shingles(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common: dict = {}
    for hs in holders.values():
        for p, a in enumerate(hs):
            for b in hs[p + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    links = [p for p, c in common.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    return {i: len(s) for i, s in sets.items()}, brute_components(list(sets), links)


def same(rows, sizes, comp):
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows) and set(got) == set(sizes)
    for i in sizes:
        assert (got[i].n_shingles, got[i].component_id) == (sizes[i], comp[i]), i
    return len({c for c in comp.values()})


def test_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    groups = same(ngramjoin.op4_ngram_join(spark, sf).collect(), *brute(rows, 4, 85))
    assert groups < len(rows)


def test_edges(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=60) for _ in range(6)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one two three four", "É é", "é É", "a\x1cb c d e", "x " * 30_000, "X " * 29_000]
    for b in base:  # near copies around the limit, so that chains of links form
        for _ in range(25):
            c = list(b)
            for _ in range(rng.randrange(5)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    common = rng.choices(words, k=50)
    texts += [" ".join(common + rng.choices(words, k=40)) for _ in range(60)] + [" ".join(common)] * 30
    rows = list(enumerate(texts))
    for n, percent in ((4, 85), (5, 80), (1, 50)):
        sizes, comp = brute(rows, n, percent)
        d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, rep string, n int, comp int").repartition(5)
        same(ngramjoin.jaccard_groups(d, n, percent).collect(), sizes, comp)
    twice = ngramjoin.jaccard_groups(d.limit(20).unionAll(d.limit(20)).unionAll(d.selectExpr("cast(null as long) doc_id", "text", "rep", "n", "comp").limit(5)), 4, 85)
    assert twice.count() == 45
    assert ngramjoin.jaccard_groups(d.limit(0)).count() == 0


def by_row(rows, n, percent):
    """(doc_id, set size, links, least id) of each row, every row a node of its own."""
    sets = [shingles(t, n) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = brute_components(range(len(rows)), links)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(comp[i], []).append((d is None, d or 0, d))
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return sorted(((d, len(sets[i]), count[i], min(least[comp[i]])[2]) for i, (d, _) in enumerate(rows)), key=repr)


def test_repeated_and_null_ids(spark, monkeypatch):
    """One id on several texts links none of them; null ids are rows like any other."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=60) for _ in range(4)]
    near = lambda b: " ".join(w if rng.random() > 0.01 else "zz" for w in b)
    rows = [(3, near(base[0])), (5, near(base[0])), (5, near(base[1])), (5, near(base[1])), (8, near(base[1])), (8, near(base[2])), (2, near(base[3])), (None, near(base[2])), (None, near(base[2])), (None, "alone in the world"), (9, "alone  in the WORLD"), (5, None), (5, "")]
    rows += [(rng.choice([3, 5, 8, None, 20]), near(rng.choice(base))) for _ in range(60)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, row int").repartition(4)
    for rows_of_block in (ngramjoin.BLOCK_ROWS, 3):
        monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", rows_of_block)
        want = by_row(rows, 4, 85)
        got = ngramjoin.jaccard_groups(d, 4, 85).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(((a, b, e) for a, b, _, e in want), key=repr)
        assert sorted(((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in ngramjoin.jaccard_links(d, 4, 85).collect()), key=repr) == want
    kept = ngramjoin.keep_one(d, ["text", "row", "doc_id"], 4, 85)
    assert kept.columns == ["text", "row", "doc_id"]
    sets = [shingles(t, 4) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert kept.count() == sum(r.kept for r in got) == len(set(brute_components(range(len(rows)), links).values()))
