"""Removal of repeated byte strings with suffix arrays over shards.

A byte goes when it is covered by a 50-byte string that also starts in a document with a
smaller id; strings are judged on the input. Texts are UTF-8 bytes (null: empty), matches
never cross documents.

1. Exact copies of a whole text are resolved by its SHA-256; only the least id goes on.
2. Every 50-byte window has an anchor, the least hash of its 24-byte strings, so equal windows have equal
   anchors. Anchors that two documents share set a bit in a bitmap of bounded size; a window
   whose anchor has no bit repeats nowhere. When the bitmap fills up, more windows pass: it is a filter only.
3. What passes is cut into shards. Each gets suffix arrays by Larsson-Sadakane refinement (groups
   that are not sorted yet are refined by the rank at doubled distance) and common prefixes by Kasai's
   walk, many stretches of text in step; suffixes that share 50 bytes form a class with its least
   document. Classes of a shard's arrays are merged by binary search over sorted keys. A window goes
   when its class has a smaller document; only the windows of each class's least document go on.
4. Neighbouring windows of one anchor form a block, so that shards exchange one key a block: a
   block that is also a block of a smaller document of another shard goes, one whose anchor has no other block repeats nowhere.
5. The windows of blocks that may repeat in part are exchanged one by one: shards' sorted class
   keys are merged and looked up by binary search.

Blocks of a hot passage meet as one entry for each shard, not one for each document. Ids
decide, so rows with a null id lose nothing and take nothing away; rows that repeat an id are
each judged by their own text against smaller ids (a row is known by its id and text, and rows equal in both get
equal results). Ties have no order to settle. Very long texts are taken whole. Empty tables give none; other columns
are carried only on request, under whatever name they have.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ngrams import carried
from tessera.session import discard, materialize, release, ship, small, tidy

DEPTH, GRAM = 50, 24
#: Bytes of text of a shard, of a suffix array, and of a slice that is hashed at once; bits of the bitmap at most.
SHARD, ARRAY, SLICE, BITS = 6_000_000, 1_500_000, 400_000, 28
U = np.uint64
ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93))


def grams(x: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each place on."""
    a = x.astype(U)
    for s in (1, 2, 4):
        a = a[:-s] | (a[s:] << U(8 * s))
    n = len(x) - GRAM + 1
    h = a[:n] * ODD[0]
    for o in (8, 16):
        h ^= h >> U(29)
        h = (h ^ a[o : o + n]) * ODD[1]
    h ^= h >> U(32)
    h *= ODD[2]
    return h ^ (h >> U(29))


def least(h: np.ndarray, width: int) -> np.ndarray:
    s = 1
    while 2 * s <= width:
        h = np.minimum(h[:-s], h[s:])
        s *= 2
    return np.minimum(h[: len(h) - (width - s)], h[width - s :]) if s < width else h


def remix(a: np.ndarray) -> np.ndarray:
    """Least hashes have small leading bits; a one-to-one mixing makes all bits even again."""
    a = (a ^ (a >> U(32))) * ODD[0]
    a = (a ^ (a >> U(29))) * ODD[2]
    return a ^ (a >> U(32))


def window_keys(h: np.ndarray) -> np.ndarray:
    """A hash of the 50 bytes from each place on, from those of three overlapping strings."""
    n = len(h) - (DEPTH - GRAM)
    k = (h[:n] ^ (h[13 : 13 + n] * ODD[0])) * ODD[1]
    k ^= (k >> U(31)) ^ h[DEPTH - GRAM :]
    k *= ODD[2]
    return k ^ (k >> U(30))


def parts(size: np.ndarray, limit: int):
    """Ranges of pieces of at most so many bytes together, or of one."""
    ends, first = np.cumsum(size), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right")))
        yield first, last
        first = last


def windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the piece and the place in the flat text of every window of pieces of these sizes."""
    n = np.maximum(size - DEPTH + 1, 0)
    row = np.repeat(np.arange(len(size)), n)
    return row, np.arange(len(row)) + (np.cumsum(size) - size - np.cumsum(n) + n)[row]


def blocks(x: np.ndarray, size: np.ndarray, keys: bool):
    """For texts of these sizes in one flat array: (text number, first window, end, anchor, block key) arrays of the blocks; texts shorter than a window have none."""
    out, ends = [[] for _ in range(5)], np.cumsum(size)
    for first, last in parts(size, SLICE):
        own = size[first:last]
        row, p = windows(own)
        if len(p):
            part = x[ends[last - 1] - own.sum() : ends[last - 1]]
            h = grams(part)
            v = least(h, DEPTH - GRAM + 1)[p]
            cut = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (row[1:] != row[:-1])]))
            size_of = np.diff(cut, append=len(p))
            r, start = row[cut], p[cut]
            at = start - (np.cumsum(own) - own)[r]
            out[0].append(first + r)
            out[1].append(at)
            out[2].append(at + size_of)
            out[3].append(remix(v[cut]))
            if keys:
                w = window_keys(h)
                k = (w[start] ^ (w[start + size_of - 1] * ODD[1])) * ODD[2] + size_of.astype(U)
                mid = np.flatnonzero(size_of > DEPTH)  # ties of anchors in periodic text: not covered by the first and the last window
                for i in mid:
                    k[i] = U(int.from_bytes(hashlib.blake2b(part[start[i] : start[i] + size_of[i] + DEPTH - 1].tobytes(), digest_size=8).digest(), "little"))
                out[4].append(k ^ (k >> U(32)))
    kinds = (np.int64, np.int64, np.int64, U, U)
    return [np.concatenate([np.zeros(0, t), *o]) for o, t in zip(out, kinds)]


def all_window_keys(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The keys of the windows of all pieces, in order."""
    ends, out = np.cumsum(size), [np.zeros(0, U)]
    for first, last in parts(size, SLICE):
        own = size[first:last]
        _, p = windows(own)
        if len(p):
            out.append(window_keys(grams(x[ends[last - 1] - own.sum() : ends[last - 1]]))[p])
    return np.concatenate(out)


def suffix_array(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the text that follows them, as far as ``depth`` bytes at least: Larsson-Sadakane refinement from 8-byte groups.

    Also which places tie with the one before in the order, all bytes that were compared being equal; ties are in the order of the text."""
    n = len(x)
    a = np.concatenate([x, np.zeros(8, np.uint8)]).astype(U)
    for s in (1, 2, 4):
        a = (a[:-s] << U(8 * s)) | a[s:]
    key = a[:n]
    sa = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[sa[1:]] != key[sa[:-1]]])
    h = 8
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    while True:
        group = np.flatnonzero(new)
        name = np.repeat(group, np.diff(group, append=n))  # a group is named by its first place
        rank[sa] = name
        if h >= depth:
            return sa, ~new
        single = new & np.concatenate([new[1:], [True]])
        todo = np.flatnonzero(~single)
        if not len(todo):
            return sa, ~new
        own = sa[todo]
        key = (name[todo] << 32) | (rank[np.minimum(own + h, n)] + 1)
        order = np.argsort(key, kind="stable")
        key = key[order]
        sa[todo] = own[order]
        new[todo] |= np.concatenate([[True], key[1:] != key[:-1]])
        h *= 2


def common_prefixes(x: np.ndarray, sa: np.ndarray, ties: np.ndarray, depth: int, stretch: int = 64) -> np.ndarray:
    """For each place in the order, the bytes it shares with the one before, up to ``depth``: Kasai's walk, a stretch of text for each lane.

    A place keeps what its left neighbour shared, less one, unless that one tied: ties are not ordered by the bytes beyond, so nothing follows from them."""
    n = len(x)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    tied = np.zeros(n, bool)
    tied[sa] = ties
    padded = np.concatenate([x, np.zeros(depth + 1, np.uint8)])
    plcp, starts = np.zeros(n, np.int64), np.arange(0, n, stretch)
    have = np.zeros(len(starts), np.int64)
    for s in range(min(stretch, n)):
        i = starts + s
        i = i[i < n]
        have = np.maximum(have[: len(i)] - 1, 0)
        j = before[i]
        if s:
            have[tied[i - 1]] = 0
        have[j < 0] = 0
        have[tied[i]] = depth
        at = np.flatnonzero((j >= 0) & ~tied[i])
        while len(at):
            at = at[have[at] < depth]
            at = at[padded[i[at] + have[at]] == padded[j[at] + have[at]]]
            have[at] += 1
        plcp[i] = have
    return plcp[sa]


def merge_spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sorted, joined (start, end) rows."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], start[1:] > end[:-1]])
    return np.stack([start[first], end[np.append(np.flatnonzero(first)[1:], len(start)) - 1]], axis=1)


def pack_spans(s: np.ndarray) -> bytes:
    return s.astype("<u4").tobytes()


def line(top: np.ndarray) -> np.ndarray:
    """Where each row of so many bytes begins on a line on which windows of different rows never touch; and the line's end."""
    return np.concatenate([[0], np.cumsum(top + DEPTH + 2)])


def row_bytes(spans: np.ndarray, base: np.ndarray, rows: np.ndarray, differences: bool) -> list[bytes]:
    """The spans of each of these rows, counted from the row's begin, as unsigned 32-bit numbers or their differences; spans lie on the line in order."""
    lo, hi = np.searchsorted(spans[:, 0], base[rows]), np.searchsorted(spans[:, 0], base[rows + 1])
    flat = (spans - base[np.searchsorted(base, spans[:, 0], side="right") - 1][:, None]).ravel()
    if differences:
        d = np.diff(flat, prepend=0)
        first = 2 * lo[lo < hi]
        d[first] = flat[first]
        flat = d
    raw = flat.astype("<u4").tobytes()
    return [raw[8 * i : 8 * j] for i, j in zip(lo, hi)]


def unsqueeze(column) -> tuple[np.ndarray, np.ndarray]:
    """(row number, spans) of all rows' differences."""
    n = np.array([len(b) // 4 for b in column], np.int64)
    total = np.cumsum(np.frombuffer(b"".join(column), "<u4"), dtype=np.uint32)
    before = np.concatenate([[0], total]).astype(np.uint32)[np.cumsum(n) - n]
    return np.repeat(np.arange(len(n)), n // 2), (total - np.repeat(before, n)).astype(np.int64).reshape(-1, 2)


def on_line(*columns):
    """The line of a shard's rows, and each column's spans on it."""
    opened = [unsqueeze(c) for c in columns]
    top = np.zeros(len(columns[0]), np.int64)
    for row, s in opened:
        np.maximum.at(top, row, s[:, 1])
    base = line(top)
    return base, *(s + base[row][:, None] for row, s in opened)


def open_spans(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u4").reshape(-1, 2).astype(np.int64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as places in their sorted distinct values, compressed."""
    values, at = np.unique(ids, return_inverse=True)
    return zlib.compress(np.array([len(values)], "<i8").tobytes() + np.diff(values, prepend=0).tobytes() + at.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes(), 1)


def unpack_ids(b: bytes) -> np.ndarray:
    raw = zlib.decompress(b)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at = np.ascontiguousarray(np.frombuffer(raw, "<u2", offset=8 + 8 * n).reshape(2, -1).T).view("<u4").ravel()
    return np.cumsum(np.frombuffer(raw, "<i8", n, 8))[at]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte by byte, compressed."""
    return zlib.compress(np.ascontiguousarray(np.diff(keys, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, ::-1].T).tobytes(), 1)


def unpack_sorted(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T[:, ::-1]).view("<u8").ravel().astype(U), dtype=U)


def bucketed(bucket: np.ndarray, *columns: np.ndarray):
    """Yields (bucket, columns' parts as bytes)."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
    for i, j in zip(cut, [*cut[1:], len(b)]):
        yield (int(b[i]), *(c[order[i:j]] for c in columns))


class Shards:
    """Collects (id, tag, text) rows until a shard is full."""

    def __init__(self):
        tidy()
        self.number, self.rows, self.size = TaskContext.get().partitionId() << 24, [], 0

    def feed(self, batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                s = b.slice(k, 500)
                for doc, tag, text in zip(*(s.column(c).to_pylist() for c in range(3))):
                    x = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                    if doc is not None and len(x) >= DEPTH:
                        self.rows.append((doc, tag, x))
                        self.size += len(x)
                    if self.size >= SHARD or len(self.rows) >= 60_000:
                        yield self.take()
        if self.rows:
            yield self.take()

    def take(self):
        self.rows.sort(key=lambda r: r[0])
        out = self.number, *(np.array([r[c] for r in self.rows], np.int64) for c in (0, 1)), [r[2] for r in self.rows]
        self.number, self.rows, self.size = self.number + 1, [], 0
        return out


def shared_anchors(docs: DataFrame, bits: int, buckets: int) -> np.ndarray:
    """The bitmap of anchors that at least two ids have."""
    step = bits - buckets.bit_length() + 1

    def emit(batches):
        for _, ids, _, texts in Shards().feed(batches):
            row, _, _, anchor, _ = blocks(np.concatenate(texts), np.array([len(t) for t in texts]), False)
            ordinal = np.unique(ids, return_inverse=True)[1][row].astype(np.uint16)
            order = np.lexsort((ordinal, anchor))
            anchor, ordinal = anchor[order], ordinal[order]
            first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (ordinal[1:] != ordinal[:-1])])[: len(anchor)]
            anchor = anchor[first]
            same = np.concatenate([anchor[1:] == anchor[:-1], [False]])[: len(anchor)]
            again = np.concatenate([[False], same[:-1]])[: len(anchor)]
            # An anchor of several ids is sent twice, whatever their number.
            anchor = anchor[~(again & np.concatenate([[False], again[:-1]])[: len(anchor)])]
            rest = (anchor & U((1 << 48) - 1)).astype("<u8").view("<u2").reshape(-1, 4)[:, :3]
            for b, x in bucketed((anchor >> U(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(anchor), np.int64), rest):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["bucket", "x"])

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        parts = np.concatenate([np.frombuffer(x, "<u2").reshape(-1, 3) for x in pdf["x"]])
        a = np.zeros((len(parts), 4), np.uint16)
        a[:, :3] = parts
        a = np.sort(a.view(U).ravel())
        twice = np.unique(a[1:][a[1:] == a[:-1]])
        field = np.zeros(1 << step, bool)
        for place in places(twice, step):
            field[place] = True
        return pd.DataFrame({"bucket": [b], "x": [np.packbits(field, bitorder="little").tobytes()]})

    got = docs.mapInArrow(emit, "bucket int, x binary").groupBy("bucket").applyInPandas(mark, "bucket int, x binary").collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in got:
        part = np.frombuffer(r.x, np.uint8)
        out[r.bucket * len(part) : (r.bucket + 1) * len(part)] = part
    return out


def places(rest: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """An anchor's two bits in its bucket's part of the bitmap, from its low 48 bits."""
    return (rest >> U(48 - step)).astype(np.int64), (((rest * ODD[1]) >> U(64 - step)) if step else rest * U(0)).astype(np.int64)


def in_bitmap(bitmap: np.ndarray, anchor: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    lead = buckets.bit_length() - 1
    step = bits - lead
    base = ((anchor >> U(64 - lead)) << U(step) if lead else np.zeros(len(anchor), U)).astype(np.int64)
    hit = np.ones(len(anchor), bool)
    for place in places(anchor & U((1 << 48) - 1), step):
        at = base | place
        hit &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit


def candidate_rows(docs: DataFrame, bitmap, bits: int, lead: int, buckets: int) -> DataFrame:
    """kind 0: a document's spans that repeat in its shard, the spans that are still open and their bytes; kind 1: the open blocks of a shard by bucket."""

    def run(batches):
        for shard, ids, tags, texts in Shards().feed(batches):
            size = np.array([len(t) for t in texts])
            text, base = np.concatenate(texts), line(size)
            del texts
            row, start, end, anchor, _ = blocks(text, size, False)
            hit = in_bitmap(bitmap.value, anchor, bits, lead)
            spans = merge_spans(base[row[hit]] + start[hit], base[row[hit]] + end[hit])
            spans[:, 1] += DEPTH - 1
            of = np.searchsorted(base, spans[:, 0], side="right") - 1
            rows = np.unique(of)
            if not len(rows):
                continue
            piece = spans[:, 1] - spans[:, 0]
            text = slices(text, spans[:, 0] - base[of] + (np.cumsum(size) - size)[of], piece)
            gone = repeats_in_shard(text, piece, np.unique(ids, return_inverse=True)[1].astype(np.int32)[of])
            at = window_places(spans)
            removed, still = window_spans(at[gone]), window_spans(at[~gone])
            text = cut_out(text, spans, still)
            raw, held = text.tobytes(), np.bincount(np.searchsorted(base, still[:, 0], side="right") - 1, still[:, 1] - still[:, 0], len(base) - 1).astype(np.int64)[rows]
            ends = np.cumsum(held)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), pa.array([shard] * n, pa.int64()), pa.array(ids[rows]), pa.array(tags[rows]), *(pa.array(row_bytes(x, base, rows, True), pa.binary()) for x in (removed, still)), pa.array([raw[j - k : j] for j, k in zip(ends, held)], pa.binary()), pa.array([None] * n, pa.int32())], names=NAMES
            )
            row, _, _, anchor, key = blocks(text, still[:, 1] - still[:, 0], True)
            doc = ids[np.searchsorted(base, still[:, 0], side="right") - 1][row]
            order = np.lexsort((doc, key))
            first = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(order)]]
            for b, k, v, d in bucketed((anchor[first] % U(buckets)).astype(np.int64), key[first], anchor[first], doc[first]):
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([shard], pa.int64()), *[pa.array([None], pa.int64())] * 2, pa.array([pack_sorted(k)], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([pack_ids(d)], pa.binary()), pa.array([b], pa.int32())], names=NAMES)

    return docs.mapInArrow(run, SCHEMA)


NAMES = ["kind", "shard", "doc_id", "tag", "x", "y", "z", "bucket"]
SCHEMA = "kind int, shard long, doc_id long, tag long, x binary, y binary, z binary, bucket int"


def window_spans(at: np.ndarray) -> np.ndarray:
    """The (start, end) rows of the windows that begin at these sorted places; neighbouring windows make one row, windows further apart each their own."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    first = np.concatenate([[True], np.diff(at) > 1])
    return np.stack([at[first], at[np.append(np.flatnonzero(first)[1:], len(at)) - 1] + DEPTH], axis=1)


def window_places(spans: np.ndarray) -> np.ndarray:
    """The places of all windows of these spans."""
    n = spans[:, 1] - spans[:, 0] - DEPTH + 1
    return np.arange(n.sum()) + np.repeat(spans[:, 0] - np.cumsum(n) + n, n)


def cut_out(x: np.ndarray, spans: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The bytes of some spans, each of which lies in one of the spans whose bytes are x."""
    size = spans[:, 1] - spans[:, 0]
    w = np.searchsorted(spans[:, 0], some[:, 0], side="right") - 1
    return slices(x, (np.cumsum(size) - size)[w] + some[:, 0] - spans[w, 0], some[:, 1] - some[:, 0])


def slices(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    raw = x.tobytes()
    return np.frombuffer(b"".join([raw[i : i + n] for i, n in zip(start.tolist(), size.tolist())]), np.uint8)


def judge_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each shard's blocks: those that a smaller document has too, and those that may partly repeat because their anchor has other blocks."""
    keys = [unpack_sorted(k) for k in pdf["x"]]
    key, anchor = np.concatenate(keys), np.frombuffer(b"".join(pdf["y"]), U)
    doc, shard = np.concatenate([unpack_ids(x) for x in pdf["z"]]), np.repeat(pdf["shard"].to_numpy(), [len(k) for k in keys])
    order = np.lexsort((doc, key, anchor))
    k, v, d = key[order], anchor[order], doc[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
    first = d[new][np.cumsum(new) - 1]
    new_anchor = np.concatenate([[True], v[1:] != v[:-1]])
    group = np.cumsum(new_anchor) - 1
    many = np.bincount(group, new)[group] > 1
    state = np.empty(len(k), np.int8)
    state[order] = np.where(d > first, 1, np.where(many, 2, 0))
    out = []
    for s in np.unique(shard):
        mine = shard == s
        out.append((s, key[mine & (state == 1)].tobytes(), key[mine & (state == 2)].tobytes()))
    return pd.DataFrame(out, columns=["shard", "done", "open"])


def open_rows(rows: pd.DataFrame, answers: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """kind 0: a document's repeated spans so far, its open spans and their bytes; kind 1: the shard's classes of open windows by bucket."""
    if not len(rows):
        return pd.DataFrame({n: [] for n in NAMES})
    tidy()
    done, open_ = (np.sort(np.frombuffer(b"".join(answers[c]), U)) for c in ("done", "open"))
    base, gone, spans = on_line(rows["x"], rows["y"])
    x = np.frombuffer(b"".join(rows["z"]), np.uint8)
    piece, start, end, _, key = blocks(x, spans[:, 1] - spans[:, 0], True)
    start, end = start + spans[piece, 0], end + spans[piece, 0]
    known = among(key, done)
    wait = among(key, open_) & ~known
    gone = merge_spans(np.concatenate([gone[:, 0], start[known]]), np.concatenate([gone[:, 1], end[known] + DEPTH - 1]))
    still = window_spans(window_places(np.stack([start[wait], end[wait] + DEPTH - 1], axis=1)))
    x = cut_out(x, spans, still)
    n, size = np.arange(len(rows)), still[:, 1] - still[:, 0]
    of = np.searchsorted(base, still[:, 0], side="right") - 1
    held = np.bincount(of, size, len(rows)).astype(np.int64)
    raw, ends = x.tobytes(), np.cumsum(held)
    shard, ids, tags = int(rows["shard"].iloc[0]), rows["doc_id"].to_numpy(np.int64), rows["tag"].to_numpy(np.int64)
    out = [(0, shard, i, t, g, s, raw[j - k : j], None) for i, t, g, s, j, k in zip(ids, tags, row_bytes(gone, base, n, True), row_bytes(still, base, n, True), ends, held)]
    key, doc = least_of(all_window_keys(x, size), np.repeat(ids[of], size - DEPTH + 1))
    out += [(1, shard, None, None, pack_sorted(k), pack_ids(d), None, b) for b, k, d in bucketed((key >> U(33)).astype(np.int64) % buckets, key, doc)]
    kinds = {"doc_id": "Int64", "tag": "Int64", "bucket": "Int32"}  # never by way of floating point
    return pd.DataFrame({n: pd.array(list(c), dtype=kinds[n]) if n in kinds else list(c) for n, c in zip(NAMES, zip(*out))})


def least_of(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the least document of each."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    return key[new], doc[new]


def among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def repeats_in_shard(x: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every window of every piece, in order: whether a document with a smaller number has it. Suffix arrays of bounded size, their classes merged by their keys."""
    arrays, ends = [], np.cumsum(size)
    for first, last in parts(size, ARRAY):
        length = size[first:last]
        part = x[ends[last - 1] - length.sum() : ends[last - 1]]
        left = np.repeat(np.cumsum(length), length) - np.arange(len(part))  # bytes to the end of the piece
        sa, ties = suffix_array(part, DEPTH)
        name = np.cumsum(common_prefixes(part, sa, ties, DEPTH) < DEPTH)
        real = left[sa] >= DEPTH
        sa, name = sa[real], name[real]
        if not len(sa):
            continue
        new = np.concatenate([[True], name[1:] != name[:-1]])
        doc = np.repeat(ids[first:last], length)
        of = np.empty(len(part), np.int32)  # each window's class
        of[sa] = np.cumsum(new) - 1
        new = np.flatnonzero(new)
        arrays.append((sa[new], np.minimum.reduceat(doc[sa], new), of[left >= DEPTH], doc[left >= DEPTH], part))
    least_ids = [a[1] for a in arrays]
    if len(arrays) > 1:
        key = np.concatenate([window_keys(grams(part))[at] for at, _, _, _, part in arrays])
        order = np.argsort(key)
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        whole = np.empty(len(key), ids.dtype)
        whole[order] = np.minimum.reduceat(np.concatenate(least_ids)[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        least_ids = np.split(whole, np.cumsum([len(a[0]) for a in arrays])[:-1])
    return np.concatenate([np.zeros(0, bool), *(doc > own[of] for own, (_, _, of, doc, _) in zip(least_ids, arrays))])


def merge_classes(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each shard, its classes that a smaller document of another shard holds: the shards' sorted keys are merged into one and looked up in it."""
    keys, docs = [unpack_sorted(x) for x in pdf["x"]], [unpack_ids(y) for y in pdf["y"]]
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    k, d, count = k[new], d[new], np.diff(np.flatnonzero(new), append=len(new))
    out = []
    for shard, mine, own in zip(pdf["shard"], keys, docs):
        at = np.searchsorted(k, mine)
        known = (count[at] > 1) & (d[at] < own)
        out.append((shard, mine[known].tobytes()))
    return pd.DataFrame(out, columns=["shard", "x"])


def final_rows(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """doc_id, tag and all repeated spans."""
    known = np.sort(np.frombuffer(b"".join(answers["x"]), U))
    base, gone, spans = on_line(rows["x"], rows["y"])
    at = window_places(spans)[among(all_window_keys(np.frombuffer(b"".join(rows["z"]), np.uint8), spans[:, 1] - spans[:, 0]), known)]
    s = merge_spans(np.concatenate([gone[:, 0], at]), np.concatenate([gone[:, 1], at + DEPTH]))
    n = np.unique(np.searchsorted(base, s[:, 0], side="right") - 1)
    return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(np.int64)[n], "tag": rows["tag"].to_numpy(np.int64)[n], "spans": row_bytes(s, base, n, False)})


def repeated_spans(docs: DataFrame, total_bytes: int) -> DataFrame:
    """(doc_id, tag, spans: packed pairs of unsigned 32-bit byte offsets) of documents (doc_id, tag: hash of the text, text) that hold repeated strings."""
    spark = docs.sparkSession
    ship(spark)
    bits = int(np.clip(np.ceil(np.log2(max(total_bytes, 1) / 8)), 16, BITS))
    lead = 1 << int(np.clip(np.ceil(np.log2(max(total_bytes, 1) / 16e6)), 5, min(14, bits - 3)))  # buckets of the first exchange, a power of two
    buckets = int(np.clip(total_bytes // 8_000_000, 32, 1 << 20))
    bitmap = spark.sparkContext.broadcast(shared_anchors(docs, bits, lead))
    release(spark)
    rows = materialize(candidate_rows(docs, bitmap, bits, lead, buckets), "blocks")
    answers = rows.where("kind = 1").groupBy("bucket").applyInPandas(judge_blocks, "shard long, done binary, open binary")
    opened = rows.where("kind = 0").groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(lambda a, b: open_rows(a, b, buckets), SCHEMA)
    opened = materialize(opened, "open")
    discard(rows)
    rows = opened
    answers = rows.where("kind = 1").groupBy("bucket").applyInPandas(merge_classes, "shard long, x binary")
    return rows.where("kind = 0").groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(final_rows, "doc_id long, tag long, spans binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (packed offset pairs), kept (the bytes that stay) of each row, and the columns to carry."""
    ship(docs.sparkSession)
    carry = carry or []
    all_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(f"`{c}`").alias(a) for c, a in zip(carry, carried(carry))))
    tag = F.xxhash64("text").alias("tag")
    docs = all_docs.select("doc_id", tag, "text")
    long = docs.where((F.octet_length("text") >= DEPTH) & F.col("doc_id").isNotNull()).select("doc_id", F.octet_length("text").cast("long").alias("n"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha"))
    long = materialize(long, "hashes")
    total = long.agg(F.sum("n")).first()[0] or 0
    first = materialize(long.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("sha", "first"), "copies")
    copies = materialize(long.join(small(first), "sha").where("doc_id > first").select("doc_id", "sha").distinct(), "later")
    sha = F.when(F.octet_length("text") >= DEPTH, F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    rest = docs.withColumn("sha", sha).join(small(copies), ["doc_id", "sha"], "left_anti").select("doc_id", "tag", "text")
    spans = materialize(repeated_spans(rest, total).groupBy("doc_id", "tag").agg(F.first("spans").alias("spans")), "spans")

    def cut(batches):
        for b in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            out = []
            for text, s, copy in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                x = (text or "").encode("utf-8", "surrogatepass")
                s = np.array([[0, len(x)]]) if copy else open_spans(s or b"")
                ends = [0, *s.ravel().tolist(), len(x)]
                out.append((len(x), int((s[:, 1] - s[:, 0]).sum()), len(s), pack_spans(s), b"".join(x[i:j] for i, j in zip(ends[::2], ends[1::2]))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.binary()] * 2)), *b.columns[4:]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", *carried(carry)])

    keyed = all_docs.withColumn("sha", sha).withColumn("tag", tag)
    marked = keyed.join(small(copies.withColumn("copy", F.lit(True))), ["doc_id", "sha"], "left").join(small(spans), ["doc_id", "tag"], "left")
    types, own = dict(all_docs.dtypes), ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    schema = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, spans binary, kept binary", *(f"{a} {types[a]}" for a in carried(carry))])
    out = marked.select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"), *carried(carry)).mapInArrow(cut, schema)
    return out.select(*own, *(F.col(a).alias(c) for c, a in zip(carry, carried(carry)) if c not in own))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
#: Every 50-byte string with its least document; runs of covered bytes; what lies between them.
ORACLE_SQL = {
    "op10_suffix_dedup": """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents), s AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM s WHERE n >= 50)),
g AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS first FROM w) WHERE first < doc_id),
b AS (SELECT doc_id, p, coalesce(p > max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50, true) AS new FROM g),
i AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM b),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY 1, 2),
t AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM r GROUP BY 1),
f AS (SELECT doc_id, a, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM r UNION ALL SELECT s.doc_id, n, coalesce(max(z), 0) FROM s LEFT JOIN r USING (doc_id) GROUP BY 1, 2),
k AS (SELECT s.doc_id, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a, b) AS kept FROM s JOIN f USING (doc_id) GROUP BY 1)
SELECT s.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM s JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
