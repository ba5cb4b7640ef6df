"""Topic models over bags of words (doc, word, n).

Variational fits loop on the driver over one job a round: blocks of documents get the topic rows of
their own words and send expected counts back, chunks of the vocabulary add them up; both travel as
packed arrays. Gibbs chains of small corpora are groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators.density import MOST_ROUNDS
from tessera.session import drop_files, materialize, release, ship

#: Words that a topic table on the driver may have; a larger vocabulary is refused, not cut.
VOCABULARY = 200_000


#: Distinct words of documents that one task holds.
BLOCK_PAIRS = 30_000
#: In a fit, so many times as many; and topic rows of all blocks that one chunk of the vocabulary serves.
FIT_BLOCKS, CHUNK_ROWS = 8, 400_000

#: Rows of a fit's frames (kind, block, chunk, data): a block's sizes of documents, places of words and counts; a chunk's places of a block's words; a block's topic shares; expected counts for a chunk; its totals and topic rows for a block; its topic rows, in all; its totals.
SIZES, PLACES, COUNTS, INDEX, GAMMA, SUMS, ROWS, TABLE, TOTALS = range(9)
PACKED = "kind int, block int, chunk int, data binary"


def _documents(d: np.ndarray, w: np.ndarray, n: np.ndarray, weights: np.ndarray, docs: int, alpha: float, rounds: int = 50, tol: float = 1e-4, start: np.ndarray | None = None):
    """(gamma, counts) of the documents of a block: mean-field topic shares (docs, topics), from `start` if given, and each pair's expected topic counts; pairs (d, w, n) in the order of d, weights (words, topics)."""
    k = weights.shape[1]
    gamma = alpha + np.bincount(d, n, docs)[:, None] / k * np.ones(k) if start is None else start.copy()
    # A row a topic, so that what is done for each pair runs along memory.
    mine = np.ascontiguousarray((weights / weights.max(axis=1, keepdims=True))[w].T)
    counts, left, much = np.zeros((k, len(d))), np.arange(len(d)), n
    at, first, size = np.unique(d, return_index=True, return_counts=True)
    e, moves = np.empty((len(at), k)), np.ones(len(at), bool)
    for done in range(rounds):
        if not len(at):
            break
        e[moves] = np.exp(special.digamma(gamma[at[moves]]))
        share = np.repeat(np.ascontiguousarray(e.T), size, axis=1)
        ratio = much / np.einsum("kp,kp->p", mine, share)
        new = alpha + e * np.add.reduceat(mine * ratio, first, axis=1).T
        still = moves & (np.abs(new - gamma[at]).max(1) >= tol)
        gamma[at[moves]] = new[moves]
        moves = still & (done < rounds - 1)
        if 4 * moves.sum() <= 3 * len(at):
            # Documents at rest leave with the counts of their last round, several at a time.
            go = np.repeat(moves, size)
            counts[:, left[~go]] = mine[:, ~go] * share[:, ~go] * ratio[~go]
            left, mine, much = left[go], mine[:, go], much[go]
            at, size, e, moves = at[moves], size[moves], e[moves], moves[moves]
            first = np.cumsum(size) - size
    return gamma, counts.T


def _blocks(bow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bags (block, doc, arrays at and n), words (block, word, at)): a block is some documents and the words that they have."""
    pairs = bow.where("n > 0 and word is not null").select("doc", "word", F.col("n").cast("double").alias("n"))
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int"))
    at = F.row_number().over(Window.partitionBy("block").orderBy("word")) - 1
    words = materialize(pairs.select("block", "word").distinct().withColumn("at", at), "words")
    bags = pairs.join(words, ["block", "word"]).groupBy("block", "doc").agg(F.collect_list(F.struct("at", "n")).alias("bag")).select("block", "doc", "bag.at", "bag.n")
    return materialize(bags, "bags"), words


def _pass(bags: DataFrame, words: DataFrame, model: DataFrame, step, schema: str) -> DataFrame:
    """step on each block: its bags, and its words with their rows of the model (word, b)."""
    known = words.join(model.select("word", "b"), "word")
    return bags.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(step, schema)


def _unpack(bags: pd.DataFrame, known: pd.DataFrame):
    """(d, w, n, b): the pairs whose words are known, w the row of b."""
    known = known.sort_values("at")
    size = [len(x) for x in bags["at"]]
    at, n = np.concatenate(list(bags["at"])).astype(int), np.concatenate(list(bags["n"])).astype(float)
    ats, d = known["at"].to_numpy(int), np.repeat(np.arange(len(bags)), size)
    has = np.isin(at, ats)
    return d[has], np.searchsorted(ats, at[has]), n[has], np.stack(known["b"]) if len(known) else np.zeros((0, 1)), known["word"].to_numpy()


def _packed(rows: list) -> pd.DataFrame:
    return pd.DataFrame([(k, b, c, np.ascontiguousarray(x).tobytes()) for k, b, c, x in rows], columns=["kind", "block", "chunk", "data"])


def _held(batches) -> dict:
    """Arrays of a task's rows by kind, block and chunk."""
    types = {SIZES: np.int32, PLACES: np.int32, INDEX: np.int32}
    return {(k, b, c): np.frombuffer(x, types.get(k, float)) for pdf in batches for k, b, c, x in zip(pdf["kind"], pdf["block"], pdf["chunk"], pdf["data"])}


def _pack(bow: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(frame of SIZES, PLACES, COUNTS and INDEX, words (word, chunk, pos), blocks, chunks)."""
    spark = bow.sparkSession
    pairs = bow.where("n > 0 and word is not null").select("doc", "word", F.col("n").cast("double").alias("n"))
    count = pairs.count()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, min(-(-count // BLOCK_PAIRS), cores * -(-count // (FIT_BLOCKS * BLOCK_PAIRS * cores))))
    chunks = max(1, -(-count // CHUNK_ROWS), min(blocks, cores))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("word")) - 1
    words = materialize(pairs.select("word").distinct().withColumn("chunk", F.pmod(F.xxhash64("word"), F.lit(chunks)).cast("int")).withColumn("pos", place), "words")
    placed = pairs.join(words, "word").select(F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int").alias("block"), "doc", (F.col("chunk").cast("long") * (1 << 32) + F.col("pos")).alias("code"), "n")

    def build(batches):
        got = [x for x in batches if len(x)]
        if got:
            pdf = pd.concat(got, ignore_index=True)
            block, d = int(pdf["block"].iloc[0]), pdf.groupby("doc", sort=True, dropna=False).ngroup().to_numpy()
            order = np.lexsort((pdf["code"], d))
            codes, at = np.unique(pdf["code"].to_numpy()[order], return_inverse=True)
            rows = [(SIZES, block, -1, np.bincount(d).astype(np.int32)), (PLACES, block, -1, at.astype(np.int32)), (COUNTS, block, -1, pdf["n"].to_numpy(float)[order])]
            cuts = np.searchsorted(codes, np.arange(chunks + 1) << 32)
            yield _packed(rows + [(INDEX, block, c, (codes[cuts[c] : cuts[c + 1]] & 0xFFFFFFFF).astype(np.int32)) for c in range(chunks)])

    return materialize(placed.repartitionById(blocks, F.col("block")).mapInPandas(build, PACKED), "packed"), words, blocks, chunks


def fit_words(bow: DataFrame, topics: int, alpha: float = 0.1, eta: float = 0.01, rounds: int | None = None, seed: int = 0, tol: float = 1e-4) -> DataFrame:
    """(word, p): each word's probability in each topic by variational inference, a table of any vocabulary. A document goes on from its topic shares of the round before. Rounds go on until less than tol of all words' counts changes its topic; a bound of MOST_ROUNDS raises, a number of rounds given does not."""
    ship(bow.sparkSession)
    packed, words, blocks, chunks = _pack(bow)
    size, ks = words.count(), range(topics)
    # Start counts about 1, spread by a hash of the word.
    start = [1 + 0.1 * math.sqrt(3) * (2 * F.pmod(F.xxhash64("word", F.lit(k), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) - 1) for k in ks]

    def begin(batches):
        got = [x for x in batches if len(x)]
        if got:
            pdf = pd.concat(got, ignore_index=True).sort_values("pos")
            yield _packed([(TABLE, -1, int(pdf["chunk"].iloc[0]), np.stack(pdf["b"].to_numpy()))])

    def share(batches):
        held = _held(batches)
        for block in sorted({b for k, b, _ in held if k == SIZES}):
            sizes, at, n = (held[k, block, -1] for k in (SIZES, PLACES, COUNTS))
            rows = [held[ROWS, block, c].reshape(-1, topics) for c in range(chunks)]
            total, b = sum(x[0] for x in rows), np.concatenate([x[1:] for x in rows])
            gamma = next((x.reshape(-1, topics) for (k, o, _), x in held.items() if k == GAMMA and o == block), None)
            weights = np.exp(special.digamma(b + eta) - special.digamma(total + size * eta))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums, new, first = np.zeros((topics, len(b))), [], 0
            while first < len(sizes):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK_PAIRS, side="right")) - 1)
                cut, docs = slice(ends[first], ends[last]), slice(first, last)
                g, counts = _documents(np.repeat(np.arange(last - first), sizes[docs]), at[cut], n[cut], weights, last - first, alpha, start=None if gamma is None else gamma[docs])
                new.append(g)
                for k in ks:
                    sums[k] += np.bincount(at[cut], counts[:, k], len(b))
                first = last
            cuts = np.cumsum([0] + [len(x) - 1 for x in rows])
            yield _packed([(GAMMA, block, block % chunks, np.concatenate(new))] + [(SUMS, block, c, sums.T[cuts[c] : cuts[c + 1]]) for c in range(chunks)])

    def gather(batches):
        held = _held(batches)
        out = [(k, b, c, x) for (k, b, c), x in held.items() if k == GAMMA]
        for chunk in sorted({c for k, _, c in held if k == TABLE}):
            old = table = held[TABLE, -1, chunk].reshape(-1, topics)
            met = sorted(b for k, b, c in held if k == INDEX and c == chunk)
            if any(k == SUMS for k, _, _ in held):
                table = np.zeros_like(old)
                for b in met:  # a block names a word once; in the order of blocks
                    table[held[INDEX, b, chunk]] += held[SUMS, b, chunk].reshape(-1, topics)
            total = table.sum(0)
            out += [(TABLE, -1, chunk, table), (TOTALS, -1, chunk, np.append(total, np.abs(table - old).sum()))]
            out += [(ROWS, b, chunk, np.concatenate([total[None], table[held[INDEX, b, chunk]]])) for b in met]
        yield _packed(out)

    def by_chunk(df: DataFrame) -> DataFrame:
        return materialize(df.repartitionById(chunks, F.col("chunk")).mapInPandas(gather, PACKED), "topics")

    def of(df: DataFrame, *kinds: int) -> DataFrame:
        return df.where(F.col("kind").isin(*kinds))

    tables = words.select("chunk", "pos", F.array(*start).alias("b")).repartitionById(chunks, F.col("chunk")).mapInPandas(begin, PACKED)
    # A chunk without words is a table without rows.
    tables = tables.unionByName(bow.sparkSession.createDataFrame(_packed([(TABLE, -1, c, np.zeros(0)) for c in range(chunks)]), PACKED)).groupBy("kind", "block", "chunk").agg(F.max_by("data", F.octet_length("data")).alias("data"))
    model = by_chunk(tables.unionByName(of(packed, INDEX)))
    for done in range(MOST_ROUNDS if rounds is None else rounds):
        shares = of(packed, SIZES, PLACES, COUNTS).unionByName(of(model, GAMMA, ROWS)).repartitionById(blocks, F.col("block")).mapInPandas(share, PACKED)
        before, model = model, by_chunk(shares.unionByName(of(packed, INDEX)).unionByName(of(model, TABLE)))
        total = sum(np.frombuffer(r["data"]) for r in sorted(of(model, TOTALS).select("chunk", "data").collect()))
        drop_files(before)
        if done % 8 == 7:
            release(bow.sparkSession)
        if rounds is None and done and total[-1] <= tol * total[:-1].sum():
            break
    else:
        if rounds is None:
            raise RuntimeError(f"the topics are not at rest after {MOST_ROUNDS} rounds")
    total = sum(np.frombuffer(r["data"]) for r in sorted(of(model, TOTALS).select("chunk", "data").collect()))[:-1] + size * eta

    def spread(batches):
        for (_, _, chunk), x in _held(batches).items():
            x = (x.reshape(-1, topics) + eta) / total
            for i in range(0, len(x), 10_000):
                part = x[i : i + 10_000]
                yield pd.DataFrame({"chunk": chunk, "pos": np.arange(i, i + len(part)), "p": list(part)})

    return words.join(of(model, TABLE).mapInPandas(spread, "chunk int, pos int, p array<double>"), ["chunk", "pos"]).select("word", "p")


def fold_words(bow: DataFrame, model: DataFrame, topics: int, alpha: float = 0.1) -> DataFrame:
    """(doc, topics, nll) of documents under a table (word, p); words it has not seen are left out, a document without known words gets equal shares."""
    bags, words = _blocks(bow)

    def step(bags: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        d, w, n, p, _ = _unpack(bags, known)
        p = p if len(p) else np.zeros((0, topics))
        gamma = _documents(d, w, n, p, len(bags), alpha)[0] if len(d) else np.ones((len(bags), topics))
        mix = gamma / gamma.sum(1, keepdims=True)
        nll = -np.bincount(d, n * np.log((mix[d] * p[w]).sum(1) + 1e-300), len(bags))
        return pd.DataFrame({"doc": bags["doc"], "topics": list(mix), "nll": nll})

    return _pass(bags, words, model.withColumnRenamed("p", "b"), step, "doc long, topics array<double>, nll double")


def fit(bow: DataFrame, topics: int, alpha: float = 0.1, eta: float = 0.01, rounds: int | None = None, seed: int = 0) -> tuple[dict, np.ndarray]:
    """(word index, log word probabilities by topic) on the driver; a vocabulary above the limit is refused, `fit_words` is the way."""
    rows = fit_words(bow, topics, alpha, eta, rounds, seed).orderBy("word").limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"the vocabulary has over {VOCABULARY} words")
    return {r["word"]: i for i, r in enumerate(rows)}, np.log(np.array([r["p"] for r in rows], float).reshape(-1, topics).T)


def fold_in(bow: DataFrame, index: dict, log_beta: np.ndarray, alpha: float = 0.1) -> DataFrame:
    """`fold_words` under a model of `fit`."""
    model = bow.sparkSession.createDataFrame([(w, np.exp(log_beta[:, i]).tolist()) for w, i in index.items()], f"word {dict(bow.dtypes)['word']}, p array<double>")
    return fold_words(bow, model, len(log_beta), alpha)


def gibbs(bow: DataFrame, topics: int, alpha: float = 0.1, beta: float = 0.01, burn: int = 200, samples: int = 10, lag: int = 5, chains: int = 1, seed: int = 0, limit: int = 2_000_000) -> DataFrame:
    """(chain, topic, word, p) of collapsed Gibbs chains, averaged over samples; each chain holds the corpus in one task, so one above the token limit is refused and `fit` is the way."""
    size = bow.agg(F.sum("n")).first()[0] or 0
    if size > limit:
        raise ValueError(f"the corpus has {size} tokens; a chain may have {limit}")
    copies = bow.withColumn("chain", F.explode(F.array(*[F.lit(c) for c in range(chains)])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc", "word"])
        chain = int(pdf["chain"].iloc[0])
        rng = np.random.default_rng([seed, chain])
        docs, d = np.unique(pdf["doc"], return_inverse=True)
        words, w = np.unique(pdf["word"], return_inverse=True)
        n = pdf["n"].to_numpy(int)
        d, w = np.repeat(d, n), np.repeat(w, n)
        z = rng.integers(topics, size=len(d))
        dt, wt, t = np.zeros((len(docs), topics)), np.zeros((len(words), topics)), np.bincount(z, minlength=topics).astype(float)
        np.add.at(dt, (d, z), 1)
        np.add.at(wt, (w, z), 1)
        mean, kept = np.zeros_like(wt), 0
        for sweep in range(burn + samples * lag):
            for i, u in enumerate(rng.random(len(d))):
                a, b, k = d[i], w[i], z[i]
                dt[a, k] -= 1
                wt[b, k] -= 1
                t[k] -= 1
                c = np.cumsum((dt[a] + alpha) * (wt[b] + beta) / (t + beta * len(words)))
                k = z[i] = min(int(np.searchsorted(c, u * c[-1], side="right")), topics - 1)
                dt[a, k] += 1
                wt[b, k] += 1
                t[k] += 1
            if sweep >= burn and (sweep - burn) % lag == lag - 1:
                mean += (wt + beta) / (t + beta * len(words))
                kept += 1
        k, v = np.meshgrid(np.arange(topics), np.arange(len(words)))
        return pd.DataFrame({"chain": chain, "topic": k.ravel(), "word": words[v.ravel()], "p": (mean / max(kept, 1)).ravel()})

    word = dict(bow.dtypes)["word"]
    return copies.groupBy("chain").applyInPandas(run, f"chain int, topic int, word {word}, p double")
