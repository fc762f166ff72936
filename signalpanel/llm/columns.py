"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of a collection.

In round j every text that has one inserts its suffix of length j (Bauer, Cox and
Rosone, 2013; with common prefixes: Cox et al., 2016). The transform, the common
prefixes and the suffixes' owners are three files, read once and written anew from
front to back in each round; memory holds one block of them and a few numbers a text.

A suffix c.X goes to the place after all suffixes that begin with a smaller symbol and
after as many that begin with c as the transform has c's before X's place. Its common
prefix with the one before it is one more than the least common prefix between X and the
last c before X, and likewise for the one after it.
"""

from __future__ import annotations

import contextlib
import os

import numpy as np

#: Common prefixes are counted up to this.
MOST = 250


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) for each pair; no range is empty."""
    if not len(lo):
        return np.zeros(0, values.dtype)
    order = np.argsort(-lo, kind="stable")  # descending, so that nothing is added up between two ranges
    index = np.empty(2 * len(lo), np.int64)
    index[::2], index[1::2] = lo[order], hi[order]
    out = np.empty(len(lo), values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, values.dtype.type(255)), index)[::2]
    return out


class Column:
    """A file of numbers that a round reads from front to back while it writes the next one."""

    def __init__(self, folder: str, name: str, kind):
        self.folder, self.name, self.kind, self.turn = folder, name, np.dtype(kind), 0

    def path(self, ahead: int = 0) -> str:
        return os.path.join(self.folder, f"{self.name}.{self.turn + ahead}")

    def blocks(self, size: int):
        with open(self.path(), "rb") as f:
            while len(part := np.fromfile(f, self.kind, size)):
                yield part

    def advance(self):
        os.unlink(self.path())
        self.turn += 1


class Collection:
    """Transform, common prefixes and owners (text << 8 | start) of at most 2**24 texts of at most 254 bytes below 255."""

    def __init__(self, texts: list[bytes], folder: str, block: int = 1 << 18):
        self.block, self.n = block, len(texts)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1)  # 0 ends a text
        self.end = np.cumsum(self.length)
        self.columns = [Column(folder, "bwt", np.uint8), Column(folder, "lcp", np.uint8), Column(folder, "own", np.uint32)]

    def symbol(self, texts: np.ndarray, j: int) -> np.ndarray:
        """The symbol before each text's suffix of length j, 0 if that is the whole text."""
        more = self.length[texts] > j
        out = np.zeros(len(texts), np.uint8)
        out[more] = self.data[self.end[texts[more]] - j - 1]
        return out

    def build(self) -> Collection:
        texts = np.arange(self.n)
        first = [self.symbol(texts, 0), np.zeros(self.n, np.uint8), (texts << 8 | self.length).astype(np.uint32)]
        for column, values in zip(self.columns, first):
            values.tofile(column.path())
        at, j = texts, 0
        while True:
            go = self.length[texts] > j
            texts, at, j = texts[go], at[go], j + 1
            if not len(texts):
                return self
            texts, at = self._round(texts, at, j)

    def _round(self, texts: np.ndarray, at: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Inserts the suffixes of length j of texts whose suffixes of length j - 1 stand at `at` (ascending)."""
        symbol, rank, before, after, total = self._look(at)
        total[0] = self.n  # suffixes of length 0 stand where symbol 0 would
        place = (np.cumsum(total) - total)[symbol] + rank
        order = np.argsort(place)
        texts, place, before, after = texts[order], place[order], before[order], after[order]
        added = [self.symbol(texts, j), before, (texts << 8 | (self.length[texts] - j)).astype(np.uint32)]
        self._merge(place, added, after)
        return texts, place

    def _look(self, at: np.ndarray):
        """Of the entries at `at`: symbol, how often it occurs before, one more than the least common prefix since its last
        and until its next occurrence (0: none); and how often each symbol occurs."""
        k = len(at)
        symbol, rank = np.zeros(k, np.int64), np.zeros(k, np.int64)
        before, after = np.zeros(k, np.int64), np.zeros(k, np.int64)
        count, since = np.zeros(256, np.int64), np.full(256, 255, np.int64)
        waiting, until = np.full(256, -1), np.full(256, 255, np.int64)
        start, whole = 0, os.path.getsize(self.columns[0].path())
        for b, h in zip(self.columns[0].blocks(self.block), self.columns[1].blocks(self.block)):
            alone = len(b) == whole  # nothing crosses blocks
            n = np.bincount(b, minlength=256)
            order = np.argsort(b, kind="stable")
            first = np.cumsum(n) - n
            has = n > 0
            if not alone:
                lead = np.minimum.accumulate(h)
                tail = np.append(np.minimum.accumulate(h[::-1])[::-1], np.uint8(255))[1:].astype(np.int64)  # least after each place
                least = int(lead[-1])
                # those that wait for their symbol's next occurrence since an earlier block
                met = np.flatnonzero((waiting >= 0) & has)
                after[waiting[met]] = np.minimum(until[met], lead[order[first[met]]]) + 1
                waiting[met] = -1
                until = np.minimum(until, least)
            lo, hi = np.searchsorted(at, [start, start + len(b)])
            if hi > lo:
                mine = np.zeros(len(b), bool)
                mine[at[lo:hi] - start] = True
                slot = np.flatnonzero(mine[order])
                place = order[slot]
                own = lo + np.searchsorted(at[lo:hi], place + start)
                c = b[place].astype(np.int64)
                symbol[own], rank[own] = c, count[c] + slot - first[c]
                inner = slot > first[c]
                before[own[inner]] = range_min(h, order[slot[inner] - 1] + 1, place[inner] + 1).astype(np.int64) + 1
                if not alone:
                    outer = ~inner & (count[c] > 0)
                    before[own[outer]] = np.minimum(since[c[outer]], lead[place[outer]]) + 1
                inner = slot < first[c] + n[c] - 1
                after[own[inner]] = range_min(h, place[inner] + 1, order[slot[inner] + 1] + 1).astype(np.int64) + 1
                if not alone:
                    waiting[c[~inner]], until[c[~inner]] = own[~inner], tail[place[~inner]]
            if not alone:
                since = np.minimum(since, least)
                since[has] = tail[order[(first + n - 1)[has]]]
            count += n
            start += len(b)
        return symbol, rank, np.minimum(before, MOST).astype(np.uint8), np.minimum(after, MOST).astype(np.uint8), count

    def _merge(self, place: np.ndarray, added: list[np.ndarray], after: np.ndarray) -> None:
        """Writes the files anew with the added entries at their places (ascending, in the new numbering)."""
        size = os.path.getsize(self.columns[0].path())
        old_place = place - np.arange(len(place))  # the old entry that each one goes before
        follows = np.flatnonzero(after > 0)
        next_at, after = place[follows] + 1, after[follows]
        start = written = 0
        with contextlib.ExitStack() as files:
            out = [files.enter_context(open(c.path(1), "wb")) for c in self.columns]
            for parts in zip(*(c.blocks(self.block) for c in self.columns)):
                end = start + len(parts[0])
                lo, hi = np.searchsorted(old_place, [start, end if end < size else size + 1])
                new = place[lo:hi] - written
                stays = np.ones(len(parts[0]) + hi - lo, bool)
                stays[new] = False
                # what comes after an added suffix and begins alike has a new common prefix
                a, b = np.searchsorted(next_at, [written, written + len(stays)])
                for column, part, values, f in zip(self.columns, parts, added, out):
                    block = np.empty(len(stays), column.kind)
                    block[stays], block[new] = part, values[lo:hi]
                    if column.name == "lcp":
                        block[next_at[a:b] - written] = after[a:b]
                    block.tofile(f)
                start, written = end, written + len(stays)
        for column in self.columns:
            column.advance()

    def repeats(self, length: int):
        """Arrays (text, start, group) of all suffixes that share their first `length` symbols with another; one group each."""
        found, before, group = [], np.zeros(0, np.uint32), 0
        for h, own in zip(self.columns[1].blocks(self.block), self.columns[2].blocks(self.block)):
            own = np.concatenate([before, own])
            h = np.concatenate([np.zeros(len(before), np.uint8), h]) if len(before) else h
            same = h >= length
            if len(before):  # the last entry of the block before, with the group it was in
                same[0] = False
            ids = group + np.cumsum(~same)
            joined = same.copy()
            joined[:-1] |= same[1:]
            found.append((own[joined], ids[joined]))
            before, group = own[-1:], int(ids[-1]) - 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = np.concatenate([f[0] for f in found]).astype(np.int64)
        ids = np.concatenate([f[1] for f in found])
        _, keep = np.unique(own, return_index=True)
        return own[keep] >> 8, own[keep] & 255, ids[keep]
