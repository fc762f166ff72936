"""Suffix-array dedup of byte strings that occur earlier in the collection.

A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a
document of smaller id, or in the same document further to the front. The repeats are
found in a Burrows-Wheeler transform with common prefixes, built column by column (see
columns.py). A transform of all texts would take as many rounds as the longest text has
bytes and would not divide among machines, so it is built for the pieces where a repeat
is possible, which have at most 2 window - gram bytes:

1. Every window names its *anchor*, the place of the smallest hash of `gram` bytes in it.
   Equal windows name the same bytes at the same offset. A counting exchange over chunks
   tells which anchors' bytes occur more than once; the windows of all others are unique.
2. An anchor's *piece* is the text under its windows. Pieces meet in the bucket of
   their anchor's bytes. A piece equal to an earlier one goes as a whole. What is left
   are distinct pieces round the same bytes: the edges of repeats.
3. Those pieces of a bucket are a collection of short texts. It gets its transform and
   common prefixes, one symbol a piece and round, in sequential files; neighbours that
   share `window` symbols or more are equal windows, of which the earliest stays.
4. Bytes that very many distinct pieces share, such as a line that a third of all documents
   hold, would make one large collection: beyond `limit` distinct pieces their windows are
   looked up one by one, as pieces of a single window, in an exchange of their own.

Texts are shuffled once and chunks exchange packed hashes. Of equal pieces, and of equal
windows in step 4, a chunk sends its earliest and settles the others itself, so passages that
very many documents hold cost an entry a chunk. Hashes have 64 bits, and a common prefix compares bytes.

Null texts are empty; shorter texts than a window lose nothing; of equal ids the order of
reading decides, null ids come first; repeated rows lose all but the first; an empty table
gives no rows; further columns are ignored. What is left of a text may not be UTF-8.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .columns import MOST, Collection

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
TEXTS = "doc_id long, kept binary, n_removed long"
#: kind 0: single windows; 1: pieces for a collection.
PIECES = "chunk long, bucket long, kind int, body binary"
REPLY = "chunk long, bucket long, reply binary"
LOW = C.U64(0xFFFFFFFF)
#: What a bucket says of a piece: it stays or goes; or its windows to the right or left of the anchor may be in another
#: piece, and are collected or, where there are very many pieces, looked up one by one.
STAYS, GOES, RIGHT, LEFT, SINGLE = 0, 1, 2, 4, 8


class Anchors:
    """Anchors of a chunk: hash of their bytes, and the run of windows [first, last] of each."""

    def __init__(self, c: C.Chunk, window: int, gram: int):
        self.c, self.window, self.reach = c, window, (window - gram + 1) // 2
        self.size = gram
        self.raw = raw = np.frombuffer(c.data, np.uint8)
        n = len(raw) - window + 1
        # windows lie in one document
        ends = np.zeros(max(n, 0) + 1, np.int32)
        long = np.diff(c.offsets) >= window
        np.add.at(ends, c.offsets[:-1][long], 1)
        np.add.at(ends, c.offsets[1:][long] - window + 1, -1)
        inside = np.cumsum(ends[:-1], dtype=np.int32) > 0 if n > 0 else np.zeros(0, bool)
        runs = [self._runs(raw[lo : lo + C.STEP + window - 1], inside[lo : lo + C.STEP], lo, window, gram) for lo in range(0, n, C.STEP)]
        empty = np.zeros(0, np.int64)
        anchor, self.gram, self.first, self.last = (np.concatenate(x) for x in zip(*runs)) if runs else (empty, empty.astype(C.U64), empty, empty)
        # a run may go on in the next step
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.first[1:] != self.last[:-1] + 1)
        head = np.flatnonzero(new)
        # anchors have small hashes; mixed again, they fill all buckets evenly
        self.anchor, self.gram, self.first = anchor[head], C.mix(self.gram[head]), self.first[head]
        self.last = self.last[np.append(head[1:], len(anchor))[: len(head)] - 1]
        self.doc = np.searchsorted(c.offsets, self.first, side="right") - 1

    @staticmethod
    def _runs(raw, inside, lo: int, window: int, gram: int):
        """Anchor, hash, first and last window of each run of windows that name the same anchor."""
        n = len(raw)
        p, inv = C.powers(C.STEP + window, C.ROOT)
        total = np.zeros(n + 1, C.U64)
        np.cumsum(C.BYTE[raw] * p[:n], out=total[1:])
        grams = C.mix((total[gram:] - total[:-gram]) * inv[: n - gram + 1])
        # the smallest hash of each window and, in its low bits, the leftmost place of it
        bits = C.U64(24)
        best = (grams >> bits << bits) | np.arange(len(grams), dtype=C.U64)
        width, span = 1, window - gram + 1
        while width < span:
            step = min(width, span - width)
            best = np.minimum(best[: len(best) - step], best[step:])
            width += step
        at = np.flatnonzero(inside)
        anchor = (best & C.U64((1 << 24) - 1)).astype(np.int64)[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(at))[: len(head)] - 1
        return anchor[head] + lo, grams[anchor[head]], at[head] + lo, at[last] + lo

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.gram, return_counts=True)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return C.span_hashes(C.BYTE[self.raw], start, end)

    def sides(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the text that all windows share which hold more of what follows the anchor, and likewise of what
        precedes it; 0 where the anchor has no such window."""
        a = self.anchor[at]
        right, left = np.zeros(len(at), C.U64), np.zeros(len(at), C.U64)
        r, l = self.last[at] >= a - self.reach, self.first[at] < a - self.reach
        right[r] = self.hashes(a[r], a[r] + self.window - self.reach)
        left[l] = self.hashes(a[l] - self.reach - 1, a[l] + self.size)
        return right & LOW, left & LOW

    def ids(self) -> np.ndarray:
        return np.array([-(2**63) if i is None else i for i in self.c.ids], np.int64)


def _body(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in columns), 1)


def _read_body(raw: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


#: Anchor bytes' hash (its last 32 bits), the piece's, document id, place in the chunk; and the hashes of its sides.
WINDOW_ENTRY = [np.uint32, np.uint64, np.int64, np.uint32]
ENTRY = [*WINDOW_ENTRY, np.uint32, np.uint32]


def _by_bucket(key: np.ndarray, n: int):
    """(bucket, places in ascending order) of each bucket that a key falls into."""
    of = ((key >> C.U64(32)) * C.U64(n)) >> C.U64(32)
    order = np.argsort(of, kind="stable")
    cut = np.flatnonzero(np.diff(of[order])) + 1
    for at in np.split(order, cut) if len(order) else []:
        yield int(of[at[0]]), at


def _firsts(key: np.ndarray, piece: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Ascending numbers of the earliest entry of each key and piece."""
    order = np.lexsort((place, doc, piece, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (piece[order[1:]] != piece[order[:-1]])
    return np.sort(order[new])


def _entries(chunk: int, key: np.ndarray, others: list[np.ndarray], n: int):
    """Rows of PIECES of kind 0 that carry the columns of an entry."""
    kinds = ENTRY[: 1 + len(others)]
    return [(chunk, b, 0, _body(*(x[at].astype(k) for x, k in zip([key, *others], kinds)))) for b, at in _by_bucket(key, n)]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(col, kinds[kind]) for (name, kind), col in zip(fields, cols)})


def _judge(chunks: list[int], bodies: list[bytes], limit: int | None) -> list[np.ndarray]:
    """What becomes of each entry of each body; without a limit they are windows, which stay or go."""
    parts = [_read_body(b, ENTRY if limit else WINDOW_ENTRY) for b in bodies]
    sizes = [len(p[0]) for p in parts]
    key, piece, doc, place, *sides = (np.concatenate(x) for x in zip(*parts))
    chunk = np.repeat(np.array(chunks, np.int64), sizes)
    order = np.lexsort((place, chunk, doc, piece, key))
    k, p = key[order], piece[order]
    new_key, new_piece = np.ones(len(k), bool), np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new_piece[1:] = new_key[1:] | (p[1:] != p[:-1])
    verdict = np.where(new_piece, STAYS, GOES)
    if limit:
        first = np.flatnonzero(new_piece)
        distinct = np.bincount(np.cumsum(new_key) - 1, new_piece)[np.cumsum(new_key) - 1]
        for side, bit in zip(sides, (RIGHT, LEFT)):
            side = side[order[first]]
            _, inverse, count = np.unique(k[first].astype(C.U64) << C.U64(32) | side, return_inverse=True, return_counts=True)
            verdict[first] |= np.where((side > 0) & (count[inverse] > 1), bit, 0)
        verdict[first] |= np.where((verdict[first] > 0) & (distinct[first] > limit), SINGLE, 0)
    out = np.empty(len(k), np.uint8)
    out[order] = verdict
    return np.split(out, np.cumsum(sizes)[:-1])


def _classify(limit: int):
    def run(t: pa.Table) -> pa.Table:
        chunks = t.column("chunk").to_pylist()
        got = _judge(chunks, [x.as_py() for x in t.column("body")], limit)
        return _table([(c, b, zstandard.compress(v.tobytes(), 1)) for c, b, v in zip(chunks, t.column("bucket").to_pylist(), got)], REPLY)

    return run


def _resolve(window: int):
    """Starts (in the chunk) of windows that also start earlier: of single windows by their hash, of pieces by a collection."""

    def run(t: pa.Table) -> pa.Table:
        kind, chunks, bodies = t.column("kind")[0].as_py(), t.column("chunk").to_pylist(), [x.as_py() for x in t.column("body")]
        rows = []
        if kind == 0:
            for c, body, verdict in zip(chunks, bodies, _judge(chunks, bodies, None)):
                rows.append((c, 0, _read_body(body, WINDOW_ENTRY)[3][verdict == GOES]))
        else:
            rows = _collect(chunks, bodies, window)
        return _table([(c, b, zstandard.compress(np.asarray(s, np.uint32).tobytes(), 1)) for c, b, s in rows if len(s)], REPLY)

    return run


#: Document id, place in the chunk, size, hash of the anchor's bytes.
PIECE = [np.int64, np.uint32, np.uint32, np.uint32]
#: About as many bytes make one collection; one anchor's pieces are never parted.
COLLECTION = 1 << 19


def _collect(chunks: list[int], bodies: list[bytes], window: int) -> list[tuple]:
    texts, chunk, doc, place, key = [], [], [], [], []
    for c, body in zip(chunks, bodies):
        head, data = body[:8], zstandard.decompress(body[8:])
        n = int.from_bytes(head, "little")
        d, at, size, gram = (np.frombuffer(data, k, n, n * o) for k, o in zip(PIECE, (0, 8, 12, 16)))
        cut = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]) + 20 * n
        texts += [data[a:b] for a, b in zip(cut[:-1], cut[1:])]
        chunk.append(np.full(n, c))
        doc.append(d)
        place.append(at.astype(np.int64))
        key.append(gram)
    chunk, doc, place, key = (np.concatenate(x) for x in (chunk, doc, place, key))
    rows, of = [], np.argsort(key, kind="stable")
    size = np.cumsum([len(texts[i]) for i in of])
    lo = 0
    while lo < len(of):
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + COLLECTION)) + 1
        while hi < len(of) and key[of[hi]] == key[of[hi - 1]]:
            hi += 1
        some = of[lo:hi]
        with tempfile.TemporaryDirectory() as folder:  # this task's own files, gone at once
            piece, start, group = Collection([texts[i] for i in some], folder).build().repeats(window)
        c, d, at = chunk[some][piece], doc[some][piece], place[some][piece] + start
        order = np.lexsort((at, c, d, group))
        later = np.zeros(len(order), bool)
        later[order[1:]] = group[order][1:] == group[order][:-1]
        rows += [(int(x), 1, at[later & (c == x)]) for x in np.unique(c[later])]
        lo = hi
    return rows


def check_reach(window: int, gram: int) -> None:
    """Pieces of 2 window - gram bytes must fit the columns' owners, and windows their common prefixes."""
    if 2 * window - gram > 254 or window > MOST:
        raise ValueError(f"window {window} with gram {gram}: pieces may have at most 254 bytes, windows {MOST}")


def repeated_windows(chunks: DataFrame, window: int, gram: int, limit: int, finish, schema: str) -> DataFrame:
    """finish(chunk, boolean for each byte: it goes) -> Arrow table, for every chunk."""
    n = C.buckets(chunks.sparkSession)

    def level(rep: DataFrame, k: int) -> DataFrame:
        return rep.withColumn("level", F.lit(k))

    def of(replies: pa.Table, k: int) -> pa.Table:
        return replies.filter(pc.equal(replies.column("level"), k)) if replies.num_rows else replies

    def ask(batches):
        for c in C.each_chunk(batches):
            yield C.request_rows(c.chunk, *Anchors(c, window, gram).keys(), n, narrow=True)

    def live(c, replies) -> tuple[Anchors, np.ndarray]:
        a = Anchors(c, window, gram)
        keys, inverse = np.unique(a.gram, return_inverse=True)
        return a, np.flatnonzero(C.read_reply(of(replies, 1), keys, n, many_only=True)[inverse]) if len(keys) else inverse

    def earliest(a: Anchors, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' hashes, and the places in `at` of the chunk's earliest anchor with each piece; all others go."""
        piece = a.hashes(a.first[at], a.last[at] + window)
        return piece, _firsts(a.gram[at], piece, a.ids()[a.doc[at]], a.first[at])

    def to_pieces(c, replies):
        a, at = live(c, replies)
        if not len(at):
            return _table([], PIECES)
        piece, some = earliest(a, at)
        at = at[some]
        return _table(_entries(c.chunk, a.gram[at], [piece[some], a.ids()[a.doc[at]], a.first[at], *a.sides(at)], n), PIECES)

    def verdicts(c, replies) -> tuple[Anchors, np.ndarray, np.ndarray]:
        a, at = live(c, replies)
        said = {b: r for b, r in zip(of(replies, 2).column("bucket").to_pylist(), of(replies, 2).column("reply").to_pylist())}
        out = np.full(len(at), GOES, np.uint8)
        if len(at):
            first = earliest(a, at)[1]
            for b, some in _by_bucket(a.gram[at[first]], n):
                out[first[some]] = np.frombuffer(zstandard.decompress(said[b]), np.uint8)
        return a, at, out

    def sides(a: Anchors, at: np.ndarray, verdict: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of an anchor's windows, first and last of those on the sides that another piece has too."""
        lo = np.where(verdict & LEFT, a.first[at], np.maximum(a.first[at], a.anchor[at] - a.reach))
        return lo, np.where(verdict & RIGHT, a.last[at], np.minimum(a.last[at], a.anchor[at] - a.reach - 1))

    def singles(a: Anchors, at: np.ndarray, verdict: np.ndarray):
        """Hash, document id and start of the windows that are looked up one by one, and the chunk's earliest of each hash."""
        single = (verdict & SINGLE) > 0
        lo, hi = (x[single] for x in sides(a, at, verdict))
        size = hi - lo + 1
        start = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        h, doc = a.hashes(start, start + window), np.repeat(a.ids()[a.doc[at[single]]], size)
        return h, doc, start, _firsts(h, h, doc, start)

    def to_collections(c, replies):
        a, at, verdict = verdicts(c, replies)
        rows, ids = [], a.ids()
        lo, hi = sides(a, at, verdict)
        single = (verdict & SINGLE) > 0
        if single.any():
            h, doc, start, first = singles(a, at, verdict)
            rows += _entries(c.chunk, h[first], [h[first], doc[first], start[first]], n)
        collect = np.flatnonzero(((verdict & (RIGHT | LEFT)) > 0) & ~single)
        some, lo, hi = at[collect], lo[collect], hi[collect]
        for b, k in _by_bucket(a.gram[some], n) if len(some) else []:
            start, size, k = lo[k], hi[k] - lo[k] + window, some[k]
            pieces = b"".join(c.data[x : x + y] for x, y in zip(start.tolist(), size.tolist()))
            columns = b"".join(x.astype(t).tobytes() for x, t in zip((ids[a.doc[k]], start, size, a.gram[k]), PIECE))
            rows.append((c.chunk, b, 1, len(k).to_bytes(8, "little") + zstandard.compress(columns + pieces, 1)))
        return _table(rows, PIECES)

    def last(c, replies):
        a, at, verdict = verdicts(c, replies)
        edge = np.zeros(len(a.raw) + 1, np.int64)
        gone = at[verdict == GOES]
        np.add.at(edge, a.first[gone], 1)
        np.add.at(edge, a.last[gone] + window, -1)
        again = []
        if ((verdict & SINGLE) > 0).any():
            _, _, start, first = singles(a, at, verdict)
            again.append(np.delete(start, first))
        again += [np.frombuffer(zstandard.decompress(raw), np.uint32).astype(np.int64) for raw in of(replies, 3).column("reply").to_pylist()]
        for start in again:
            np.add.at(edge, start, 1)
            np.add.at(edge, start + window, -1)
        return finish(c, np.cumsum(edge[:-1]) > 0)

    one = level(C.exchange_counts(chunks.mapInArrow(ask, C.REQUEST), many_only=True, narrow=True), 1)
    two = level(C.with_replies(chunks, one, to_pieces, PIECES).groupBy("bucket").applyInArrow(_classify(limit), REPLY), 2)
    three = C.with_replies(chunks, one.unionByName(two), to_collections, PIECES)
    three = level(three.groupBy("kind", "bucket").applyInArrow(_resolve(window), REPLY), 3)
    return C.with_replies(chunks, one.unionByName(two).unionByName(three), last, schema)


def _kept(c: C.Chunk, gone: np.ndarray):
    """For each document: its bytes, how many go in how many runs, and what is left."""
    raw = np.frombuffer(c.data, np.uint8)
    for i in range(len(c)):
        own = gone[c.offsets[i] : c.offsets[i + 1]]
        n = int(own.sum())
        if not n:
            yield i, 0, 0, c.text(i)
            continue
        runs = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
        yield i, n, runs, raw[c.offsets[i] : c.offsets[i + 1]][~own].tobytes()


def dedup_digests(df: DataFrame, window: int = 100, gram: int = 64, limit: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, removed bytes and runs, and the digest of what is left of each document."""
    check_reach(window, gram)

    def finish(c, gone):
        rows = [(n, runs, hashlib.sha256(left).hexdigest()) for _, n, runs, left in _kept(c, gone)]
        n, runs, digest = zip(*rows) if rows else ((), (), ())
        return pa.table({"doc_id": C.id_array(c.ids), "n_bytes": pa.array(np.diff(c.offsets)), "n_removed": pa.array(n, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return repeated_windows(C.pack(df, id_col, text_col), window, gram, limit, finish, RESULT)


def dedup_bytes(df: DataFrame, window: int = 100, gram: int = 64, limit: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (binary), n_removed of each document."""
    check_reach(window, gram)

    def finish(c, gone):
        rows = [(left, n) for _, n, _, left in _kept(c, gone)]
        left, n = zip(*rows) if rows else ((), ())
        return pa.table({"doc_id": C.id_array(c.ids), "kept": pa.array(left, pa.binary()), "n_removed": pa.array(n, pa.int64())})

    return repeated_windows(C.pack(df, id_col, text_col), window, gram, limit, finish, TEXTS)
