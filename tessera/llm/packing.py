"""Harmonic packing into sequences of a fixed capacity.

A document is cut into whole sequences and a rest. A rest of length r is of class capacity // r,
and a bin of class k takes exactly k rests, each worker filling its own bins. With ``cut`` the gap that a
full bin still has is closed by the documents that come next, the last of them being cut: so there is at most one
cut for each bin, and no padding. What a worker has left over, fewer than k rests of each class, follows one
after the other in whole sequences and at last in sequences whose lengths are powers of two, which need no
padding. Without ``cut`` rests stay whole and bins are padded.

Null and empty texts still have their end token; null ids, ties and repeated rows are packed like any other row; a
very long text makes whole sequences and one rest; empty tables give none; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokenize import Words, encoder
from tessera.session import ship

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def digits(n: int) -> list[int]:
    """The powers of two that make up n, greatest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Piece:
    """A stretch of a document: its first token, how many, and the document's ids and number of ids."""

    __slots__ = ("doc", "start", "length", "ids", "total")

    def __init__(self, doc, start: int, length: int, ids: memoryview, total: int):
        self.doc, self.start, self.length, self.ids, self.total = doc, start, length, ids, total

    def take(self, n: int) -> Piece:
        """Cuts off the first n tokens."""
        out = Piece(self.doc, self.start, n, self.ids[: 4 * n], self.total)
        self.start, self.length, self.ids = self.start + n, self.length - n, self.ids[4 * n :]
        return out


class Bins:
    """A worker's open bins, by class, and the one that has all its rests but a gap yet."""

    def __init__(self, capacity: int, cut: bool):
        self.capacity, self.cut, self.bins, self.gap, self.closed = capacity, cut, {}, None, []

    def add(self, p: Piece) -> None:
        while p.length >= self.capacity:
            self.closed.append([p.take(self.capacity)])
        if p.length and self.gap is not None:
            left = self.capacity - sum(x.length for x in self.gap)
            self.gap.append(p.take(min(left, p.length)))
            if self.gap[-1].length == left:
                self.closed.append(self.gap)
                self.gap = None
        if p.length:
            k = self.capacity // p.length
            kept = self.bins.setdefault(k, [])
            kept.append(p)
            if len(kept) == k:
                del self.bins[k]
                if self.cut and sum(x.length for x in kept) < self.capacity:
                    self.gap = kept
                else:
                    self.closed.append(kept)

    def finish(self) -> None:
        """Closes what is left; with cuts in whole sequences and at last in powers of two."""
        rest = [self.gap] if self.gap else []
        rest += [kept for _, kept in sorted(self.bins.items())]
        if not self.cut:
            self.closed += rest
            return
        pieces = [p for kept in rest for p in kept][::-1]
        total = sum(p.length for p in pieces)
        for n in [self.capacity] * (total // self.capacity) + digits(total % self.capacity):
            out = []
            while n:
                p = pieces[-1]
                out.append(p.take(min(n, p.length)))
                n -= out[-1].length
                if not p.length:
                    pieces.pop()
            self.closed.append(out)


def packer(capacity: int = 4096, cut: bool = True):
    """A function from batches of (doc_id, n_tokens, ids) to batches of pieces."""
    if cut and capacity & (capacity - 1):
        raise ValueError("cutting needs a capacity that is a power of two")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        sequence, bins = TaskContext.get().partitionId() << 33, Bins(capacity, cut)

        def flush():
            nonlocal sequence
            out = []
            for pieces in bins.closed:
                offset = 0
                for p in pieces:
                    out.append((p.doc, p.start, p.length, bytes(p.ids), p.total, sequence, offset))
                    offset += p.length
                sequence += 1
            bins.closed = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3)], names=names)

        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                for doc, ids in zip(s.column(0).to_pylist(), s.column(2).to_pylist()):
                    ids = ids or b""
                    bins.add(Piece(doc, 0, len(ids) // 4, memoryview(ids), len(ids) // 4))
                if bins.closed:
                    yield flush()
        bins.finish()
        if bins.closed:
            yield flush()

    return run


def pack(encoded: DataFrame, capacity: int = 4096, cut: bool = True) -> DataFrame:
    """Pieces of (doc_id, n_tokens, ids): doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    ship(encoded.sparkSession)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(packer(capacity, cut), SCHEMA)


def pack_texts(docs: DataFrame, path: str | None = None, capacity: int = 4096, end: int = 2) -> DataFrame:
    """Tokenises and packs whole texts in one pass through the workers."""
    import public_tokenizers

    encode, fill = encoder(docs.sparkSession, Words, path or public_tokenizers.path("word_bpe_49k.json"), end), packer(capacity)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: fill(encode(batches)), SCHEMA)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    out = pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op3_packing": op3_packing}
ORACLE_SQL: dict[str, str] = {}
