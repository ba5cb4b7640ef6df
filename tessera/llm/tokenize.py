"""Byte-pair encoding and decoding in numpy, and cached word tokenisation.

``ids`` columns are packed little-endian unsigned 32-bit integers. Null texts count as
empty, null ids are ids like any other; each input row gives one row, repeated rows each their own; equal ranks cannot
occur, and of touching equal pairs the left ones merge first; very long texts are taken whole, one at a time; empty tables
give none; other columns are not carried and may have any name. Vocabulary files are read on the driver and sent to the workers (a few MB, fixed).
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import KEPT, ship, tidy

#: White space as the tokenizers' patterns mean it, in a form that all Python versions read alike.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BYTE_LEVEL = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SPACES = re.compile(f"[{SPACE}]+")
#: str.split() also cuts at these, which are not white space here.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Words kept in a worker's cache before it is emptied, and characters taken at a time.
CACHE_WORDS, SLICE_CHARS = 600_000, 2_000_000
NO_RANK = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenates the slices flat[s : s + n]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class WordCache(dict):
    """Word -> number; ids of number i are flat[start[i] : start[i] + length[i]]. Unknown words wait in .new until encode() fills them in."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.new = encode, []
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def __missing__(self, word):
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def numbers(self, words: list) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.used = 0
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            ids, lengths = self.encode(self.new)
            n, first = len(self), len(self) - len(self.new)
            if n > len(self.start):
                self.start, self.length = (np.concatenate([x[:first], np.zeros(2 * n - first, np.int64)]) for x in (self.start, self.length))
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.length[first:n] = lengths
            self.start[first:n] = self.used + np.cumsum(lengths) - lengths
            self.used += len(ids)
            self.new = []
        return out

    def ids(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has; the words' numbers stay in .last."""
        n = self.last = self.numbers(words)
        return gather(self.flat, self.start[n], self.length[n]), self.length[n]


class ByteBPE:
    """Merge rounds over many words at once: the words' symbols lie in one flat array, each pair's rank is found by
    binary search in the sorted pair keys, and in every round each word merges all places of its lowest-ranked pair."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        vocab, merges = j["model"]["vocab"], j["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in j.get("added_tokens", [])}
        alphabet = byte_alphabet()
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        _, first = np.unique(keys, return_index=True)
        self.keys, self.rank = keys[first], first.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[first]
        self.byte_id = np.zeros(256, np.int64)
        suffix = j["model"].get("end_of_word_suffix")
        self.end_id = np.array([vocab[c + suffix] for c in sorted(alphabet, key=alphabet.get)], np.int64) if suffix else None
        text = [b""] * self.size
        for token, i in vocab.items():
            text[i] = bytes(alphabet[c] for c in token.removesuffix(suffix or "\0"))
            if len(token) == 1:
                self.byte_id[alphabet[token]] = i
        for token, i in self.special.items():
            text[i] = token.encode()
        self.text_flat = np.frombuffer(b"".join(text), np.uint8)
        self.text_len = np.array([len(x) for x in text], np.int64)
        self.text_start = np.cumsum(self.text_len) - self.text_len
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = WordCache(self.merge)

    def look_up(self, sym: np.ndarray, word: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin at these places."""
        after = np.minimum(where + 1, len(sym) - 1)
        key = sym[where] * self.size + sym[after]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (word[where] == word[after]) & (after > where), self.rank[at], NO_RANK), self.merged[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [b"" if w == "\n" and self.end_id is not None else w.encode() for w in words]  # there it ends a word
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        sym, word = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)], np.repeat(np.arange(len(raw)), lengths)
        if self.end_id is not None and len(sym):
            last = np.cumsum(lengths)[lengths > 0] - 1
            sym[last] = self.end_id[np.frombuffer(b"".join(raw), np.uint8)[last]]
        rank, into = self.look_up(sym, word, np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(word[1:] != word[:-1]) + 1
            starts = np.concatenate([[0], starts])
            size = np.diff(starts, append=len(sym))
            least = np.minimum.reduceat(rank, starts)
            if (least == NO_RANK).any():
                over = np.repeat(least == NO_RANK, size)
                done.append((word[over], sym[over]))
                sym, word, rank, into = (x[~over] for x in (sym, word, rank, into))
                size, least = size[least != NO_RANK], least[least != NO_RANK]
                if not len(sym):
                    break
            idx = np.flatnonzero(rank == np.repeat(least, size))
            # Of touching hits (a run of one symbol) every second is taken, from the left.
            run = np.flatnonzero(np.diff(idx, prepend=-2) > 1)
            if len(run) < len(idx):
                nth = np.arange(len(idx)) - np.repeat(run, np.diff(run, append=len(idx)))
                idx = idx[nth % 2 == 0]
            sym[idx] = into[idx]
            keep = np.ones(len(sym), bool)
            keep[idx + 1] = False
            idx = idx - np.arange(len(idx))  # their places without what goes
            sym, word, rank, into = (x[keep] for x in (sym, word, rank, into))
            before = idx[np.diff(idx, prepend=-1) > 1] - 1  # a merged symbol's left neighbour, if that was not merged itself
            changed = np.concatenate([idx, before])
            rank[changed], into[changed] = self.look_up(sym, word, changed)
        if not done:
            return np.zeros(0, np.uint32), lengths * 0
        word, sym = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words, counts, special = [], [], []
        for t in texts:
            n = len(words)
            for k, part in enumerate(self.split.split(t) if self.split else [t]):
                if k % 2:
                    special.append((len(words), self.special[part]))
                    words.append("")
                else:
                    words += BYTE_LEVEL.findall(part)
            counts.append(len(words) - n)
        ids, per_word = self.with_special(self.cache, words, special)
        ends = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum([0, *counts])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    @staticmethod
    def with_special(cache: WordCache, words: list[str], special: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, with special tokens at the places of the empty words that stand for them."""
        ids, per_word = cache.ids(words)
        if special:
            place = np.array([p for p, _ in special])
            ends = np.cumsum(per_word)
            ids = np.insert(ids, ends[place] - per_word[place], np.array([i for _, i in special], ids.dtype))
            per_word[place] = 1
        return ids, per_word

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.astype(np.int64)
        ids = ids[ids < self.size]
        return gather(self.text_flat, self.text_start[ids], self.text_len[ids]).tobytes().decode("utf-8", "replace")


class Words(ByteBPE):
    """A vocabulary of lower-cased words with word ends. It drops white space, so a text's ids are those of its
    white-space-separated words one after another; these are cut into runs of letters, single numbers and other runs."""

    PARTS = regex.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")

    def __init__(self, spec: bytes):
        super().__init__(spec)
        self.parts, self.cache = WordCache(self.merge), WordCache(self.look)

    def look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "\n".join([*words, ""])
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # each letter is lower-cased for itself
        parts, special = [], []
        for k, x in enumerate(self.split.split(text) if "<|" in text else [text]):
            if k % 2:
                special.append((len(parts), self.special[x]))
                parts.append("")
            else:
                parts += self.PARTS.findall(x.lower())
        ids, per = self.with_special(self.parts, parts, special)
        ends = np.cumsum(per)[self.parts.last == self.parts["\n"]] if parts else per
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words, counts = [], []
        for t in texts:
            got = [w for w in SPACES.split(t) if w] if SEPARATORS.search(t) else t.split()
            words += got
            counts.append(len(got))
        ids, per_word = self.cache.ids(words)
        ends = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum([0, *counts])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


def slices(texts: list[str | None]):
    """Index ranges of at most SLICE_CHARS characters, or one text."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _worker(kind: type, shared) -> object:
    key = (kind.__name__, shared.id if hasattr(shared, "id") else id(shared))
    if key not in KEPT:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        KEPT.clear()
        KEPT[key] = kind(shared.value)
    return KEPT[key]


ENCODED = "doc_id long, n_tokens long, ids binary"


def _shared(spark, path: str):
    ship(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encoder(spark, kind: type, path: str, end: int | None = None, shared=None):
    """A function from batches of (doc_id, text) to batches of ENCODED."""
    shared = shared or _shared(spark, path)
    tail = np.array([] if end is None else [end], "<u4").tobytes()

    def run(batches):
        tidy(keep=True)
        coder = _worker(kind, shared)
        for b in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                ids = [x.astype("<u4", copy=False).tobytes() + tail for x in coder.encode([t or "" for t in texts[i:j]])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def decoder(spark, path: str, shared=None):
    """A function from batches of ENCODED to batches with the decoded text as well."""
    shared = shared or _shared(spark, path)

    def run(batches):
        coder = None
        for b in batches:
            coder = coder or _worker(ByteBPE, shared)
            for i in range(0, b.num_rows, 64):
                s = b.slice(i, 64)
                text = [coder.decode(np.frombuffer(x or b"", "<u4")) for x in s.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids: byte-level BPE of whole texts, special tokens in a text recognised as the library does."""
    return _input(docs, id_col, text_col).mapInArrow(encoder(docs.sparkSession, ByteBPE, path), ENCODED)


def word_encode(docs: DataFrame, path: str, end: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids of a tokenizer of words, each document followed by the id ``end``."""
    return _input(docs, id_col, text_col).mapInArrow(encoder(docs.sparkSession, Words, path, end), ENCODED)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, text: the decoded texts; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decoder(encoded.sparkSession, path), f"{ENCODED}, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_decode(bpe_encode(docs)) in one pass through the workers."""
    shared = _shared(docs.sparkSession, path)  # one for both, so that a worker keeps one vocabulary
    encode, decode = encoder(docs.sparkSession, ByteBPE, path, None, shared), decoder(docs.sparkSession, path, shared)
    return _input(docs, id_col, text_col).mapInArrow(lambda batches: decode(encode(batches)), f"{ENCODED}, text string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLE_SQL: dict[str, str] = {}
