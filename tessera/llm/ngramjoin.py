"""N-gram Jaccard join by prefix filters under several global token orders.

A document's tokens are its distinct word shingles, as 64-bit hashes. Documents with equal
sets are joined to one class first. Every global order of all tokens gives a necessary
condition: two sets that are similar enough share a token among the first of each. Orders:
rare tokens first, by a fixed-size sketch of document frequencies over the whole corpus,
ties broken by a different hash in each order. Candidates come from the first order (with
length and position filters); those that share no prefix token under the other orders go,
and the rest are verified on whole sets. Groups of near copies are first drawn together by
verified links to the holders of the same least tokens, so that pairs inside a group that
is already connected are never made. No cap applies to partners or candidates.

Every input row gets a number of its own and is one node, so an id that several texts carry links none of
them with another; the numbers are mapped back to ids at the end. A token that very many sets hold is
dealt to blocks of bounded size, and each pair of its blocks meets in one task.

Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than a
shingle is one token, a null or empty text none: it is linked with nothing. Rows with a
null id take part and get their group's least id, null if it has none. Each input row gives one row; repeated rows are
copies; of rows that tie for a group's least id the first in the input stays; very long texts are taken whole, one
slice at a time; empty tables give none; other columns are carried only on request, whatever their names.

The groups are whole, but pairs inside a group that is connected already are not made: ``jaccard_groups`` gives components.
``jaccard_links`` makes every pair of different sets and counts each row's links.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.llm.ngrams import carried
from tessera.session import drop_files, materialize, ship, small, tidy

#: Counters of the document-frequency sketch, its parts when it is summed, and the number of least-token orders that draw copies together.
SKETCH_BITS, PARTS, LEAST = 22, 64, 4
CACHE_WORDS, SLICE_BYTES = 200_000, 2_000_000
#: Rows of a block of a token that very many sets hold.
BLOCK_ROWS = 1 << 16
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class Hashes(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(ODD[seed % 4] >> (seed // 4))) * np.uint64(ODD[(seed + 1) % 4])
    x ^= x >> np.uint64(29)
    x *= np.uint64(ODD[(seed + 2) % 4])
    return x ^ (x >> np.uint64(32))


def token_sets(texts: list, n: int, cache: Hashes):
    """Yields each text's sorted distinct shingle hashes."""
    for i, j in _slices(texts):
        words, counts = [], []
        for t in texts[i:j]:
            w = t.encode("utf-8", "surrogatepass").lower().split() if t else []
            words += w
            counts.append(len(w))
        if len(cache) > CACHE_WORDS:
            cache.clear()
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        s = np.full(max(len(h) - n + 1, 0), n, np.uint64)
        for k in range(n):
            s = mix(s * np.uint64(31) + h[k : k + len(s)], 0)
        at = 0
        for c in counts:
            if c >= n:
                yield np.unique(s[at : at + c - n + 1])
            elif c:
                one = np.full(1, c, np.uint64)
                for x in h[at : at + c]:
                    one = mix(one * np.uint64(31) + x, 0)
                yield one
            else:
                yield np.zeros(0, np.uint64)
            at += c


def _slices(texts: list):
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _batches(batches, rows: int = 1000):
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def add(counts: np.ndarray, held: list[np.ndarray]) -> None:
    which, times = np.unique(np.concatenate(held), return_counts=True)
    counts[which] += times.astype(np.uint32)


def signed(docs: DataFrame, n: int) -> DataFrame:
    """A row for each text: row, doc_id, n tokens, 128-bit hash of the set, least tokens under several orders; and each task's part of the sketch."""

    def run(batches):
        tidy()
        cache, counts, held, waiting = Hashes(), np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
        for b in _batches(batches):
            out = []
            for t in token_sets(b.column(2).to_pylist(), n, cache):
                held.append((t >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                waiting += len(t)
                d = xxhash.xxh3_128_digest(t.tobytes())
                least = [int(mix(t, 4 + k).min().view(np.int64)) for k in range(LEAST)] if len(t) else None
                out.append((len(t), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), least))
                if waiting > 1_000_000:
                    add(counts, held)
                    held, waiting = [], 0
            yield _row_batch([b.column(0), b.column(1), *zip(*out), [None] * len(out), [None] * len(out)])
        if held:
            add(counts, held)
        blobs = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, PARTS)]
        none = [None] * PARTS
        yield _row_batch([none, none, none, none, none, none, list(range(PARTS)), blobs])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n long, h1 long, h2 long, least array<long>, part int, counts binary")


def _row_batch(columns: list) -> pa.RecordBatch:
    types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.int32(), pa.binary()]
    names = ["row", "doc_id", "n", "h1", "h2", "least", "part", "counts"]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """The whole corpus's sketch as logarithms in a byte; summed in two levels, of fixed size whatever the corpus."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((1 << SKETCH_BITS) // PARTS, np.uint32)
        for x in pdf["counts"]:
            out += np.frombuffer(zlib.decompress(x), np.uint32)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [zlib.compress(out.tobytes(), 1)]})

    parts = rows.where("part is not null").select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt"))
    some = parts.groupBy("part", "salt").applyInPandas(total, "part int, counts binary")
    whole = sorted(some.groupBy("part").applyInPandas(total, "part int, counts binary").collect())
    counts = np.concatenate([np.frombuffer(zlib.decompress(r.counts), np.uint32) for r in whole]) if whole else np.zeros(1 << SKETCH_BITS, np.uint32)
    return np.minimum(np.log2(counts + 1.0) * 8, 255).astype(np.uint8)


def prefix(tokens: np.ndarray, frequency: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens under a global order, in that order: a similar set shares one of them."""
    n = len(tokens)
    if not n:
        return tokens
    p = n - -(-percent * n // 100) + 1
    key = (mix(tokens, 8 + order) >> np.uint64(8)) | (frequency[tokens >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56))
    if p < n:
        at = np.argpartition(key, p - 1)[:p]
        return tokens[at[np.argsort(key[at])]]
    return tokens[np.argsort(key)]


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, frequency) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; only their texts are read again, and prefixes under two more orders are compared first."""
    pairs = materialize(pairs, "candidates")
    ids = materialize(pairs.select(F.col("a").alias("row")).unionAll(pairs.select(F.col("b").alias("row"))).distinct(), "ids")

    def run(batches):
        tidy()
        cache = Hashes()
        for b in _batches(batches):
            sets = list(token_sets(b.column(1).to_pylist(), n, cache))
            first = [[prefix(t, frequency.value, k, percent).astype(np.uint32).view(np.int32) for t in sets] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.view(np.int64) for t in sets], pa.list_(pa.int64())), *(pa.array(p, pa.list_(pa.int32())) for p in first)], names=["row", "t", "p1", "p2"])

    sets = materialize(docs.select("row", "text").join(small(ids), "row").mapInArrow(run, "row long, t array<long>, p1 array<int>, p2 array<int>"), "sets")
    of = lambda c, *cols: sets.select(F.col("row").alias(c), *(F.col(x).alias(c + x) for x in cols))
    near = pairs.join(of("a", "p1", "p2"), "a").join(of("b", "p1", "p2"), "b").where(F.arrays_overlap("ap1", "bp1") & F.arrays_overlap("ap2", "bp2")).select("a", "b")
    both = near.join(of("a", "t"), "a").join(of("b", "t"), "b").select("a", "b", F.size("at").alias("na"), F.size("bt").alias("nb"), F.size(F.array_intersect("at", "bt")).alias("i"))
    links = materialize(both.where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b"), "links")
    drop_files(pairs, ids, sets)
    return links


def pairs_of_runs(token, rep, comp, n, pos, percent: int):
    """Yields (a, b) arrays for rows sorted by token and length: pairs of one token whose lengths and positions allow the similarity and whose components differ."""
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(start, append=len(token))
    mixed = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
    run = np.repeat(np.arange(len(start)), size)
    keep = np.flatnonzero(mixed[run])
    end = (start + size)[run]
    step = 1
    while len(keep):
        keep = keep[keep + step < end[keep]]
        # Rows lie in the order of their lengths: once a partner is too long, so are all later ones.
        keep = keep[100 * n[keep] >= percent * n[keep + step]]
        for k in range(0, len(keep), 1_000_000):
            a = keep[k : k + 1_000_000]
            b = a + step
            most = np.minimum(n[a] - pos[a], n[b] - pos[b])
            good = (comp[a] != comp[b]) & (most * (100 + percent) >= percent * (n[a] + n[b]))
            if good.any():
                yield rep[a[good]], rep[b[good]]
        step += 1


def candidates(docs: DataFrame, known: DataFrame, n: int, percent: int, frequency) -> DataFrame:
    """(a, b), a < b: rows of different components that share a prefix token under the first order. known: (row, rep, comp) where they are not the row itself."""

    def emit(batches):
        tidy()
        cache = Hashes()
        for b in _batches(batches):
            ids, comp = b.column(0).to_numpy(), b.column(2).to_numpy()
            first, sizes = [], []
            for t in token_sets(b.column(1).to_pylist(), n, cache):
                first.append(prefix(t, frequency.value, 0, percent))
                sizes.append(len(t))
            count = np.array([len(p) for p in first], np.int64)
            pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            token, at = dealt(np.concatenate([np.zeros(0, np.uint64), *first]), np.repeat(ids, count), frequency.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), *(pa.array(c[at]) for c in (np.repeat(ids, count), np.repeat(comp, count), np.repeat(np.array(sizes, np.int32), count), pos.astype(np.int32)))], names=["token", "rep", "comp", "n", "pos"]
            )

    def pair(batches):
        tidy()
        held = None
        for b in _with_end(batches):
            rows = [b.column(i).to_numpy() for i in range(5)] if b is not None else [np.zeros(0, np.int64)] * 5
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            cut = len(rows[0])
            if b is not None:  # the last token may go on in the next batch
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                held = [x[cut:] for x in rows]
            seen = []
            if cut:
                for a, c in pairs_of_runs(*(x[:cut].astype(np.int64) for x in rows), percent):
                    seen.append(np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)], axis=1), axis=0))
            if seen:
                p = np.unique(np.concatenate(seen), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])

    reps = docs.select("row", "text").join(small(known), "row", "left").where(F.coalesce(F.col("rep") == F.col("row"), F.lit(True)))
    rows = reps.select("row", "text", F.coalesce("comp", "row").alias("comp")).mapInArrow(emit, "token long, rep long, comp long, n int, pos int")
    return rows.repartition("token").sortWithinPartitions("token", "n").mapInArrow(pair, "a long, b long").distinct()


def dealt(token: np.ndarray, rep: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and the rows that they belong to, a token that very many sets hold (by the sketch, never too low) being replaced by one for each pair of blocks that its row is in."""
    blocks = np.ceil(np.exp2((frequency[token >> np.uint64(64 - SKETCH_BITS)] + 1) / 8) / BLOCK_ROWS).astype(np.int64)
    if not len(token) or blocks.max() == 1:
        return token, np.arange(len(token))
    at = np.repeat(np.arange(len(token)), blocks)
    g = blocks[at]
    y = np.arange(len(at)) - (np.cumsum(blocks) - blocks)[at]
    x = (mix(rep.view(np.uint64), 12) % blocks.astype(np.uint64)).astype(np.int64)[at]
    place = (np.minimum(x, y) * g + np.maximum(x, y)).astype(np.uint64)
    return np.where(g > 1, mix(token[at] + place * np.uint64(ODD[1]), 13), token[at]), at


def _with_end(batches):
    yield from batches
    yield None


def _numbered(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row, doc_id, text and the columns to carry; written, so that the numbers stay what they are."""
    ship(docs.sparkSession)
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{c}`").alias(a) for c, a in zip(carry, carried(carry)))), "rows")


def _classes(docs: DataFrame, n: int):
    """The sketch, the classes of equal sets (rep: the row of the least id; z, d: whether that is null, and it; copies) and each row's class."""
    rows = materialize(signed(docs, n), "signed")
    frequency = docs.sparkSession.sparkContext.broadcast(document_frequencies(rows))
    signs, rows = rows, rows.where("part is null").drop("part", "counts")
    own = F.min(F.struct(F.isnull("doc_id").alias("z"), F.col("doc_id").alias("d"), F.col("row").alias("r"))).alias("own")
    classes = rows.where("n > 0").groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("least").alias("least"), own)
    classes = materialize(classes.select("h1", "h2", F.col("own.r").alias("rep"), "copies", "n", "least", "own.z", "own.d"), "classes")
    members = rows.select("row", "doc_id", "n", "h1", "h2").join(small(classes.select("h1", "h2", "rep", "copies", "d")), ["h1", "h2"], "left")
    members = materialize(members.select("row", "doc_id", "n", *(F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("rep", "copies", "d"))), "members")
    drop_files(signs)
    return frequency, classes, members


def _known(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(row, rep, comp) of the rows that are not their class's or whose component is not their own."""
    rows = members.where("rep is not null").select("row", "rep")
    rows = rows.withColumn("comp", F.col("rep")) if comp is None else rows.join(small(comp.withColumnRenamed("node", "rep")), "rep", "left").select("row", "rep", F.coalesce("component", "rep").alias("comp"))
    return materialize(rows.where("row != rep or comp != rep"), "known")


def _result(members: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Components of classes mapped to the least id, and the row that has it, over all their rows."""
    comp = materialize(components(links), "comp")
    linked = comp.unionAll(comp.select(F.col("component").alias("node"), "component").distinct())
    best = linked.join(classes.select(F.col("rep").alias("node"), "z", "d"), "node").groupBy("component").agg(F.min(F.struct("z", "d", "node")).alias("m"))
    best = materialize(best.select("component", F.col("m.d").alias("cd"), F.col("m.node").alias("cr")), "best")
    ends = materialize(linked.join(small(best), "component").select(F.col("node").alias("rep"), "cd", "cr"), "ends")
    out = members.join(small(ends), "rep", "left")
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), "rep", "copies", F.coalesce("cd", "d", "doc_id").alias("component_id"), (F.coalesce("cr", "rep", "row") == F.col("row")).alias("kept"))


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    frequency, classes, members = _classes(docs, n)
    # Near copies are drawn together: each class is compared with the least id among the holders of its least tokens, for an original usually comes before its copies.
    least = materialize(classes.select("z", "d", "rep", "n", F.posexplode("least").alias("k", "token")), "least")
    pivots = materialize(least.groupBy("k", "token").agg(F.min(F.struct("z", "d", "rep", "n")).alias("p"), F.count("*").alias("c")).where("c > 1").select("k", "token", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn")), "pivots")
    drawn = least.join(small(pivots), ["k", "token"]).where((F.col("rep") != F.col("pivot")) & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"))).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = verified(drawn, docs, n, percent, frequency)
    comp = materialize(components(links), "comp")
    drop_files(least, pivots)
    more = verified(candidates(docs, _known(members, comp), n, percent, frequency), docs, n, percent, frequency)
    return _result(members, classes, comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links), kept (whether the row is the one of its component that stays)."""
    return _grouped(_numbered(docs, []), n, percent).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, columns: list[str], n: int = 5, percent: int = 80) -> DataFrame:
    """These columns of the rows that stay: one of each component, the first with its least id."""
    rows = _numbered(docs, columns)
    gone = materialize(_grouped(rows, n, percent).where(~F.col("kept")).select("row"), "gone")
    return rows.join(small(gone), "row", "left_anti").select(*(F.col(a).alias(c) for c, a in zip(columns, carried(columns))))


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, n_links (other rows linked directly), component_id: every pair of different sets is made, none inside a group left out."""
    rows = _numbered(docs, [])
    frequency, classes, members = _classes(rows, n)
    links = verified(candidates(rows, _known(members, None), n, percent, frequency), rows, n, percent, frequency)
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.select(F.col("rep").alias("b"), "copies")
    count = materialize(both.join(copies, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("more")), "counts")
    out = _result(members, classes, links).join(small(count), "rep", "left")
    return out.select("doc_id", "n_shingles", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op4_ngram_join": op4_ngram_join}
#: Sets, pairs that share a shingle, exact similarity, and the least id reachable.
ORACLE_SQL = {
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g), t AS (SELECT doc_id, md5_number_lower(unnest(g)) AS t FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.root), n.doc_id)) AS component_id FROM n LEFT JOIN r USING (doc_id) GROUP BY n.doc_id, n.n""",
}
