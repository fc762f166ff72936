"""Substring dedup by level-wise doubling.

A window of ``window`` words repeats only if every shorter stretch inside it repeats,
so lengths are tried from short to long and only what repeats at one length is
extended to twice that length: ceil(window/4) words, twice that, and at last the
window itself. The search ends there, or where no candidate survives.

1. Shortest length. Of all windows' short stretches, each window names one, its
   *anchor*: the stretch with the smallest hash. Equal windows name the same anchor at
   the same offset, so it is enough to look up anchors, about 2 in every window.
2. Twice that. Round an anchor that repeats, the stretch that begins with it and the
   one that ends with it are looked up; a window survives if those of them that lie
   inside it repeat.
3. The windows that survive are looked up themselves.

Each look-up is one counting exchange between chunks (see common.py): nothing is
paired with anything, so a passage that a third of all documents share costs one entry
a chunk. The plan reads the packed texts from the checkpoint and shuffles them once.
Hashes have 64 bits, each level's of its own.

Null texts have no words; texts shorter than the window lose nothing; repeated rows and
equal ids are documents of their own, which repeat each other; an empty table gives no
rows; further columns are ignored, and a null id is kept as null.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ROOTS = [C.ROOT, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5]
RESULT = "doc_id long, n_words long, n_removed long, n_spans long, longest_removed long, kept_sha256 string"


class Levels:
    """Candidates of one chunk, level by level."""

    def __init__(self, c: C.Chunk, window: int):
        self.c, self.window, self.short = c, window, -(-window // 4)
        self.w = w = C.Words(c, lower=False)
        at = np.flatnonzero(np.arange(len(w.hash)) + window <= w.last)  # where windows start
        self.at = at
        if not len(at):
            self.anchor = self.near = at
            return
        grams, _ = w.grams(self.short, ROOTS[0])
        self.grams = grams
        # position of the smallest gram in each window, the leftmost of equals, by doubling
        best = np.arange(len(grams))
        width, span = 1, window - self.short + 1
        while width < span:
            step = min(width, span - width)
            other = np.append(best[step:], np.full(step, len(grams) - 1))
            best = np.where(grams[best] <= grams[other], best, other)
            width += step
        self.anchor = best[at]
        self.near = np.unique(self.anchor)

    def first_keys(self) -> np.ndarray:
        """The anchors' hashes, mixed again: they are small ones, and must fill all buckets evenly."""
        return C.mix(self.grams[self.near]) if len(self.near) else np.zeros(0, C.U64)

    def second(self, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which anchors repeat, and of those the hashes of the stretches after and before (0: it leaves the document)."""
        live, long = self.near[repeats], 2 * self.short
        w, zero = self.w, np.zeros(0, C.U64)
        if not len(live):
            return live, zero, zero
        grams, ok = w.grams(long, ROOTS[1])
        after = np.where(ok[live], grams[live], C.U64(0))
        back = live - self.short
        inside = back >= w.first[w.doc[live]]
        back = np.maximum(back, 0)
        before = np.where(inside & ok[back], C.mix(grams[back] ^ C.U64(1)), C.U64(0))
        return live, after, before

    def third(self, live: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that survive both levels, and their hashes; after, before: whether the stretch repeats."""
        if not len(live):
            return live, np.zeros(0, C.U64)
        slot = np.searchsorted(live, self.anchor)
        slot[slot == len(live)] = 0
        offset = self.anchor - self.at
        ok = live[slot] == self.anchor
        ok &= after[slot] | (offset + 2 * self.short > self.window)
        ok &= before[slot] | (offset < self.short)
        start = self.at[ok]
        w = self.w
        return start, C.span_hashes(w.hash, start, start + self.window, ROOTS[2])


def _ask(chunk: int, keys: np.ndarray, n: int) -> pa.RecordBatch:
    return C.request_rows(chunk, *np.unique(keys, return_counts=True), n)


def _answers(replies: pa.Table, level: int, keys: np.ndarray, n: int) -> np.ndarray:
    """Whether each key (repeats allowed) was found more than once."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    own = replies.filter(pc.equal(replies.column("level"), level)) if replies.num_rows else replies
    return C.read_reply(own, distinct, n, many_only=True)[inverse] if len(distinct) else np.zeros(0, bool)


def _both(after: np.ndarray, before: np.ndarray) -> np.ndarray:
    keys = np.concatenate([after, before])
    return keys[keys != 0]


def repeated_windows(chunks: DataFrame, window: int, finish, schema: str) -> DataFrame:
    """finish(chunk, Levels, starts of windows that repeat) -> Arrow table, for every chunk."""
    n = C.buckets(chunks.sparkSession)

    def level(rep: DataFrame, k: int) -> DataFrame:
        return rep.withColumn("level", F.lit(k))

    def first(batches):
        for c in C.each_chunk(batches):
            yield _ask(c.chunk, Levels(c, window).first_keys(), n)

    def to_second(c, replies):
        s = Levels(c, window)
        _, after, before = s.second(_answers(replies, 1, s.first_keys(), n))
        return pa.Table.from_batches([_ask(c.chunk, _both(after, before), n)])

    def survivors(c, replies):
        s = Levels(c, window)
        live, after, before = s.second(_answers(replies, 1, s.first_keys(), n))
        found = _answers(replies, 2, _both(after, before), n)
        k = int((after != 0).sum())
        a, b = np.zeros(len(live), bool), np.zeros(len(live), bool)
        a[after != 0], b[before != 0] = found[:k], found[k:]
        return s, *s.third(live, a, b)

    def to_third(c, replies):
        _, _, keys = survivors(c, replies)
        return pa.Table.from_batches([_ask(c.chunk, keys, n)])

    def last(c, replies):
        s, start, keys = survivors(c, replies)
        return finish(c, s, start[_answers(replies, 3, keys, n)])

    one = level(C.exchange_counts(chunks.mapInArrow(first, C.REQUEST), many_only=True), 1)
    two = level(C.exchange_counts(C.with_replies(chunks, one, to_second, C.REQUEST), many_only=True), 2)
    three = level(C.exchange_counts(C.with_replies(chunks, one.unionByName(two), to_third, C.REQUEST), many_only=True), 3)
    return C.with_replies(chunks, one.unionByName(two).unionByName(three), last, schema)


def covered(n: int, start: np.ndarray, window: int) -> np.ndarray:
    """Which of n positions lie in a window that starts at one of `start`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(c: C.Chunk, s: Levels, start: np.ndarray):
    """For each document: its words, which of them go, and the text that is left."""
    gone = covered(len(s.w.hash), start, s.window)
    keep = ~gone
    for i in range(len(c)):
        a, b = s.w.first[i], s.w.first[i + 1]
        words = c.text(i).split()  # bytes are split at exactly the contract's six white-space bytes
        removed = gone[a:b]
        n = int(removed.sum())
        yield i, words, removed, n, b" ".join(itertools.compress(words, keep[a:b]) if n else words)


def dedup_digests(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word counts, removed words and runs, the longest run, and the digest of what is left of each document."""

    def finish(c, s, start):
        rows = []
        for _, words, removed, n, left in _kept(c, s, start):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], removed.view(np.int8), [0]]))) if n else np.zeros(0, int)
            runs = edges[1::2] - edges[::2]
            rows.append((len(words), n, len(runs), int(runs.max()) if n else 0, hashlib.sha256(left).hexdigest()))
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        names = ["n_words", "n_removed", "n_spans", "longest_removed", "kept_sha256"]
        return pa.table({"doc_id": C.id_array(c.ids)} | {k: pa.array(v, t) for k, v, t in zip(names, cols, kinds)})

    return repeated_windows(C.pack(df, id_col, text_col), window, finish, RESULT)


def dedup_texts(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """df with its repeated passages removed from the text, and the column of text lengths, if there is one, made to agree.

    A text that loses nothing stays as it is; of another, the words that are left are joined by one space."""
    names, schema = tuple(df.columns), df.schema

    def finish(c, s, start):
        rows = c.carried()
        texts, sizes = rows.column(text_col).to_pylist(), []
        for i, _, _, n, left in _kept(c, s, start):
            if n:
                texts[i] = left.decode()
            sizes.append(len(texts[i] or "") if n else None)
        rows = rows.set_column(names.index(text_col), text_col, pa.array(texts, pa.string()))
        if chars_col in names:
            at = names.index(chars_col)
            kind = rows.schema.field(at).type
            rows = rows.set_column(at, chars_col, pc.coalesce(pa.array(sizes, kind), rows.column(at)))
        return rows

    return repeated_windows(C.pack(df, id_col, text_col, carry=names), window, finish, schema)
