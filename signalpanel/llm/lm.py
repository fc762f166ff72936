"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

1. Counts. Every chunk sends its distinct words with their number in training documents
   to the buckets of a counting exchange, and gets their totals back: exact counts of
   all training documents for every word of every text, without a broadcast vocabulary.
2. Classes. Every token that makes up at least `share` of the training tokens (at most
   1 / share of them), the end, and GROUPS classes that the other words fall into by their
   last bytes are predicted from the two tokens before: the context's representations,
   each times its position's matrix, add up to a predicted representation, whose product
   with a class's own, plus its bias, is the class's score.
3. Training. Each round, every task takes its share of the training documents through
   Adam steps of noise-contrastive estimation in numpy, from the same parameters; the
   tasks' parameters are averaged by tokens, slice by slice, in a tree on the executors.
   All training documents are used.
4. Words. Every word that training documents hold `least` times or more has, as context, a
   representation of its own beside its class's: a Newton step towards its most likely value,
   given a prior and the loss of all places where it stands before a token. Chunks send their
   words' gradients and numbers of places to the words' buckets, which add them up over all
   chunks and send the representations back. So this vocabulary grows with the corpus, and no machine
   holds more of it than a bucket or a chunk.
5. Scores. The exponential of a score is the product of what the two tokens before make of
   it, so exponentials are taken for each word of a chunk and class, and products added up
   for each distinct context: the softmax. A word of a group has, within
   it, probability (c + 1) / (N' + V' + 1), with N' and V' the group's tokens and distinct
   tokens, so all probabilities add up to one.

Null texts are empty and hold the end alone; words are runs of bytes that are not white
space, A-Z lower-cased; rows without an id are training documents like any other;
repeated rows count as often as they occur; an empty table gives no rows; very long texts
are chunks of their own; scores depend on how the table is split into tasks, as training does; without
training tokens every score is the base score; further columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Classes of the words that are not listed; a key's last bits name its group.
GROUPS = 128
END = np.uint64(0x0E4D0E4D0E4D0E4D)
STOP = GROUPS
ORDER = 2
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out_ids(ids, mod: int, remainder: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % mod == remainder for i in ids], bool)


def grouped(c: C.Chunk, w: C.Words) -> np.ndarray:
    """Word hashes whose last bits are a hash of the word's last two bytes."""
    if not len(w.hash):
        return w.hash
    raw = np.frombuffer(c.data, np.uint8)
    last, before = (C.LOWER_NP[raw[at]].astype(C.U64) for at in (w.end - 1, np.maximum(w.start, w.end - 2)))
    tail = last * C.U64(256) + before
    return (w.hash & ~C.U64(GROUPS - 1)) | (C.mix(tail) & C.U64(GROUPS - 1))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, which sorts distinct keys only."""
    coded = pa.array(keys).dictionary_encode()
    own = coded.dictionary.to_numpy()
    order = np.argsort(own)
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    return own[order], rank[coded.indices.to_numpy()]


class Sequence:
    """All tokens of a chunk in order, each document's closed by the end token."""

    def __init__(self, c: C.Chunk, mod: int, remainder: int):
        w = C.Words(c, lower=True)
        size = np.diff(w.first) + 1
        self.stop = np.cumsum(size)  # after each document's end token
        self.keys = np.empty(int(self.stop[-1]) if len(size) else 0, C.U64)
        last = np.zeros(len(self.keys), bool)
        last[self.stop - 1] = True
        self.keys[last], self.keys[~last] = END, grouped(c, w)
        self.doc = np.repeat(np.arange(len(size)), size)
        self.held = held_out_ids(c.ids, mod, remainder)
        self.at = np.arange(len(self.keys)) - np.repeat(self.stop - size, size)  # place within the document

    def request(self) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = distinct(self.keys)
        return keys, np.bincount(inverse, weights=~self.held[self.doc], minlength=len(keys)).astype(np.int64)


def contexts(ids: np.ndarray, at: np.ndarray, begin: int) -> np.ndarray:
    """(tokens, ORDER) ids of the tokens before, `begin` where the document has none."""
    out = np.full((len(ids), ORDER), begin, np.int64)
    for k in range(ORDER):
        out[k + 1 :, k] = ids[: max(0, len(ids) - k - 1)]
        out[np.flatnonzero(at <= k), k] = begin
    return out


class Vocabulary:
    """Class ids of the listed tokens, and what is left to the groups: tokens and distinct tokens of each."""

    def __init__(self, top: list[tuple[int, int]], n: int, v: int, ends: int, group_n: np.ndarray, group_v: np.ndarray):
        top = [(k, c) for k, c in top if np.uint64(k) != END and c > 0]
        keys = np.array([k for k, _ in top], C.U64)
        order = np.argsort(keys)
        self.keys, self.n, self.v = keys[order], n, v
        listed = np.array([c for _, c in top], float)[order]
        group = (self.keys & C.U64(GROUPS - 1)).astype(np.int64)
        self.rest_n = group_n - np.bincount(group, listed, GROUPS)
        self.rest_v = group_v - np.bincount(group, minlength=GROUPS)
        self.counts = np.concatenate([self.rest_n, [ends], listed])
        self.size = len(self.counts)

    def ids(self, keys: np.ndarray) -> np.ndarray:
        out = (keys & C.U64(GROUPS - 1)).astype(np.int64)
        if len(self.keys):
            begins = np.zeros(1 << 16, bool)  # by first bits; other keys are not searched for
            begins[self.keys >> C.U64(48)] = True
            some = np.flatnonzero(begins[keys >> C.U64(48)])
            slot = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            listed = np.flatnonzero(self.keys[slot] == keys[some])
            out[some[listed]] = slot[listed] + GROUPS + 1
        out[keys == END] = STOP
        return out


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the column of `out` at its place, if there is one; places may repeat."""
    has = np.flatnonzero(at < out.shape[1])
    at, columns = at[has], np.ascontiguousarray(rows.take(has, axis=0).T)
    for total, x in zip(out, columns):
        total += np.bincount(at, x, len(total))


def summed_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sums of the rows of each place; for few places."""
    width = rows.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).ravel(), rows.ravel(), n * width).reshape(n, width)


#: Sums of scores of less than this, either way, have exponentials in single precision, which ends at 87, also summed over all classes.
FAR = 76
#: Odds of all classes that are kept in memory.
MOST_ODDS = 1 << 21


def reach(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x, a bound of its products with rows of y."""
    return np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y).max(initial=0))


def logistic_of_minus(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class LogBilinear:
    """Parameters in one flat array; views by name."""

    def __init__(self, classes: int, dim: int, noise: np.ndarray, flat: np.ndarray | None = None, seed: int = 7, kind=float):
        self.shapes = {"r": (classes + 1, dim), "c": (ORDER, dim, dim), "q": (classes, dim), "b": (classes,)}
        size = sum(int(np.prod(s)) for s in self.shapes.values())
        self.noise = noise / noise.sum()
        self.log_noise = np.log(self.noise).astype(kind)
        self.up_to = self.noise.cumsum()
        self.up_to /= self.up_to[-1]
        self.rooms: dict[int, np.ndarray] = {}
        fresh = flat is None
        self.flat = np.zeros(size, kind) if fresh else np.array(flat, kind)
        self.r, self.c, self.q, self.b = self.views(self.flat)
        if fresh:
            rng = np.random.default_rng(seed)
            self.r[:], self.q[:] = rng.normal(0, 0.3, self.r.shape), rng.normal(0, 0.1, self.q.shape)
            self.c[:] = np.eye(dim) / ORDER
            self.b[:] = np.log(self.noise)

    def views(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes.values():
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape))
            at += n
        return out

    def room(self, i: int, n: int, width: int) -> np.ndarray:
        """The i-th memory for n rows, the same at every call: fresh memory would cost more than what is done in it."""
        if i not in self.rooms or self.rooms[i].size < n * width:
            self.rooms[i] = np.empty(n * width, self.flat.dtype)
        return self.rooms[i][: n * width].reshape(n, width)

    def drawn(self, rng: np.random.Generator, k: int) -> np.ndarray:
        """k noise classes; what rng.choice gives, without adding up the noise each time."""
        return self.up_to.searchsorted(rng.random(k), side="right")

    def predicted(self, ctx: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """own: (tokens, ORDER, dim) what words add to the representations of the classes before."""
        if own is None:
            return sum((self.r @ self.c[k]).take(ctx[:, k], axis=0) for k in range(ORDER))
        return sum((self.r[ctx[:, k]] + own[:, k]) @ self.c[k] for k in range(ORDER))

    def shift(self, k: int) -> np.ndarray:
        """What k noise classes make of the biases."""
        return self.b - self.log_noise - self.flat.dtype.type(np.log(k))

    def odds(self, q: np.ndarray, b: np.ndarray) -> list[np.ndarray] | None:
        """For each place, by class there and row of q, the exponential of minus what the one adds to the other's score: the products
        of the places' are those of whole scores. None if they could leave single precision."""
        minus = [self.r @ c @ -q.T for c in self.c]
        minus[0] -= b
        if not max(np.abs(x).max() for x in minus) < FAR / ORDER:
            return None
        return [np.exp(x, out=x) for x in minus]

    def noise_contrast(self, ctx: np.ndarray, target: np.ndarray, drawn: np.ndarray, odds: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """The predicted representations, what is missing to certainty for each target and what each drawn class has too much, and
        the gradient of each token's own loss by its predicted representation. odds: those of all classes, if they are at hand."""
        b, at, of = self.shift(len(drawn)), self.q.take(target, axis=0), self.q.take(drawn, axis=0)
        hat = self.predicted(ctx)
        miss = logistic_of_minus(np.einsum("ij,ij->i", hat, at) + b[target])
        if odds:
            odds = [x.take(drawn, axis=1) for x in odds]
        elif ORDER * len(self.r) < len(ctx):  # fewer exponentials
            odds = self.odds(of, b[drawn])
        much = self.room(0, len(ctx), len(drawn))
        if odds:
            for k, (x, c) in enumerate(zip(odds, ctx.T)):
                factor = x.take(c, axis=0, out=self.room(1, *much.shape) if k else much, mode="clip")
                if k:
                    much *= factor
            much += 1
            np.reciprocal(much, out=much)
        else:
            np.matmul(hat, -of.T, out=much)
            much -= b[drawn]
            logistic_of_minus(much)
        at *= miss[:, None]
        return hat, miss, much, much @ of - at

    def gradient(self, ctx: np.ndarray, target: np.ndarray, drawn: np.ndarray, bent: bool = True) -> tuple[np.ndarray, np.ndarray | float]:
        """Of the mean noise-contrastive loss; all tokens share the drawn noise classes. And the loss's mean curvature by the
        representation of a token before, if `bent`."""
        n, dim, classes = len(target), self.q.shape[1], len(self.b)
        hat, miss, much, g_hat = self.noise_contrast(ctx, target, drawn)
        all_much = np.ones(n, much.dtype) @ much
        flat = np.empty_like(self.flat)
        r, c, q, b = self.views(flat)
        both, rows = np.concatenate([target, drawn]), self.room(2, n + len(drawn), dim + 1)
        np.multiply(hat, -miss[:, None], out=rows[:n, :dim])
        rows[:n, dim], rows[n:, :dim], rows[n:, dim] = -miss, much.T @ hat, all_much
        sums = summed_rows(both, rows, classes) / n
        q[:], b[:] = sums[:, :dim], sums[:, dim]
        r[:] = 0
        for i in range(ORDER):
            by_class = summed_rows(ctx[:, i], g_hat, classes + 1) / n
            c[i] = self.r.T @ by_class
            r += by_class @ self.c[i].T
        if not bent:
            return flat, 0.0
        bend = np.bincount(both, np.concatenate([miss * (1 - miss), all_much - np.einsum("ij,ij->j", much, much)]), classes) / n
        bend = (self.q * bend[:, None]).T @ self.q
        return flat, sum(c @ bend @ c.T for c in self.c) / ORDER

    def backs(self, ctx: np.ndarray, target: np.ndarray, drawn: np.ndarray) -> list[np.ndarray]:
        """Of each token's own loss, the gradient by the representation of each token before."""
        g = self.noise_contrast(ctx, target, drawn)[-1]
        return [g @ c.T for c in self.c]


class Trainer:
    """Adam over batches of tokens, each with noise classes of its own."""

    def __init__(self, model: LogBilinear, rate: float, batch: int, noise: int, seed: int, bent: bool = True):
        self.model, self.rate, self.batch, self.k, self.bent = model, rate, batch, noise, bent
        self.rng, self.t, self.seen, self.bend = np.random.default_rng(seed), 0, 0, 0.0
        self.m, self.v = np.zeros_like(model.flat), np.zeros_like(model.flat)

    def feed(self, ctx: np.ndarray, target: np.ndarray) -> None:
        order = self.rng.permutation(len(target))
        for lo in range(0, len(order), self.batch):
            at = order[lo : lo + self.batch]
            g, bend = self.model.gradient(ctx[at], target[at], self.model.drawn(self.rng, self.k), self.bent)
            self.t += 1
            self.bend = self.bend + bend * len(at)
            rate = self.rate / (1 + self.t / 200) ** 0.5
            self.m *= 0.9
            self.m += 0.1 * g
            self.v *= 0.99
            self.v += 0.01 * g * g
            self.model.flat -= rate / (1 - 0.9**self.t) * self.m / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)
            self.seen += len(at)


def top_rows(replies: DataFrame, least: float) -> DataFrame:
    """key, n: of the most frequent tokens that each bucket reported, those that occur `least` times or more."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                pair = np.frombuffer(zstandard.decompress(raw), "<i8").reshape(2, -1)
                pair = pair[:, pair[1] >= least]
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["key", "n"])

    return replies.where("chunk = -2").select("reply").mapInArrow(run, "key long, n long")


def counted(requests: DataFrame, share: float) -> DataFrame:
    """The exchange's replies, and for each bucket its distinct tokens and total (chunk -1) and its tokens that make up at
    least `share` of its own (chunk -2): among them are all that make up as much of the whole."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), C.U64) for x in table.column("keys")]
        sizes = [len(x) for x in parts]
        counts = np.concatenate([C.unpacked_counts(x.as_py(), n) for x, n in zip(table.column("counts"), sizes)])
        keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, weights=counts).astype(np.int64)
        reply = [C.packed_totals(x) for x in np.split(total[inverse], np.cumsum(sizes)[:-1])]
        best = np.flatnonzero(total >= max(1, share * total.sum()))
        end = keys == END
        word, group = total * ~end, (keys & C.U64(GROUPS - 1)).astype(np.int64)
        sums = [np.bincount(group, word, GROUPS), np.bincount(group, word > 0, GROUPS), [(total > 0).sum(), total.sum(), total[end].sum()]]
        reply.append(np.concatenate(sums).astype("<i8").tobytes())
        reply.append(zstandard.compress(np.concatenate([keys[best].view(np.int64), total[best]]).astype("<i8").tobytes(), 1))
        bucket = table.column("bucket").to_pylist()
        return pa.table({"chunk": pa.array([*table.column("chunk").to_pylist(), -1, -2], pa.int64()), "bucket": pa.array([*bucket, bucket[0], bucket[0]], pa.int64()), "reply": pa.array(reply, pa.binary())})

    return requests.groupBy("bucket").applyInArrow(run, C.REPLY)


SLICE = 4096
#: Tasks whose parameters meet in one sum.
MEET = 256
PARAMETERS = "slice int, part int, n long, total binary"


def added(t: pa.Table) -> pa.Table:
    """One row of the sums of its rows' parameters."""
    total = np.sum([np.frombuffer(x.as_py()) for x in t.column("total")], axis=0)
    return pa.table({"slice": t.column("slice")[:1], "part": t.column("part")[:1], "n": pa.array([pc.sum(t.column("n")).as_py()], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})


def train(chunks: DataFrame, words: Vocabulary, mod: int, remainder: int, dim: int, rounds: int, rate: float, batch: int, noise: int) -> tuple[LogBilinear, np.ndarray]:
    """Rounds of local training and averaging; round r takes the r-th part of every chunk. The model, and the loss's mean
    curvature in the last round."""
    prior = np.maximum(words.counts, 0.5)
    model, bend = LogBilinear(words.size, dim, prior), np.eye(dim)
    for turn in range(rounds):

        def local(batches, flat=model.flat.copy(), turn=turn):
            own, trainer = LogBilinear(words.size, dim, prior, flat, kind=np.float32), None
            for c in C.each_chunk(batches):
                c = c.part(turn, rounds)
                trainer = trainer or Trainer(own, rate / (1 + turn), batch, noise, c.chunk + 1, turn == rounds - 1)
                s = Sequence(c, mod, remainder)
                ids = words.ids(s.keys)
                use = ~s.held[s.doc]
                trainer.feed(contexts(ids, s.at, words.size)[use], ids[use])
            if trainer and trainer.seen:
                total = np.concatenate([own.flat.astype(float) * trainer.seen, (trainer.bend + np.zeros((dim, dim))).ravel()])
                parts = [total[lo : lo + SLICE] for lo in range(0, len(total), SLICE)]
                meet = TaskContext.get().partitionId() // MEET
                cols = [range(len(parts)), [meet] * len(parts), [trainer.seen] * len(parts), [p.tobytes() for p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, [pa.int32(), pa.int32(), pa.int64(), pa.binary()])], ["slice", "part", "n", "total"])

        parts = chunks.mapInArrow(local, PARAMETERS).groupBy("slice", "part").applyInArrow(added, PARAMETERS).groupBy("slice").applyInArrow(added, PARAMETERS).select("slice", "n", "total").collect()
        if parts:
            parts.sort()
            mean = np.concatenate([np.frombuffer(p.total) / p.n for p in parts])
            model, bend = LogBilinear(words.size, dim, prior, mean[: -dim * dim]), mean[-dim * dim :].reshape(dim, dim)
    return model, bend


class Known:
    """A chunk's tokens with the counts of the first exchange, and which of its words have a representation of their own."""

    def __init__(self, c: C.Chunk, replies: pa.Table, words: Vocabulary, least: int, n_buckets: int, mod: int, remainder: int):
        self.s = s = Sequence(c, mod, remainder)
        keys, inverse = distinct(s.keys)
        count = C.read_reply(replies, keys, n_buckets)
        ids = words.ids(keys)
        own = (ids < GROUPS) & (count >= least)
        self.keys = keys[own]
        number = np.where(own, np.cumsum(own) - 1, len(self.keys))
        self.count, self.ids, self.number = count[inverse].astype(float), ids[inverse], number[inverse]


#: Batches whose gradients are added to their words at once.
TOGETHER = 64


def evidence_rows(c: C.Chunk, k: Known, model: LogBilinear, words: Vocabulary, batch: int, noise: int, n_buckets: int) -> pa.Table:
    """For each bucket, the chunk's words with a representation of their own: keys, summed gradients, number of places."""
    n, dim, rng = len(k.keys), model.q.shape[1], np.random.default_rng(c.chunk + 1)
    model = LogBilinear(len(model.b), dim, model.noise, model.flat, kind=np.float32)
    sums, places, odds = np.zeros((ORDER, dim, n)), np.zeros(n + 1, np.int64), None
    if len(model.r) * len(model.q) <= MOST_ODDS:
        odds = model.odds(model.q, model.shift(noise))
    use = np.flatnonzero(~k.s.held[k.s.doc])
    ctx, own = contexts(k.ids, k.s.at, words.size), contexts(k.number, k.s.at, n)
    for lo in range(0, len(use) if n else 0, TOGETHER * batch):
        some = use[lo : lo + TOGETHER * batch]
        pulls = np.concatenate([model.noise_contrast(ctx[at], k.ids[at], model.drawn(rng, noise), odds)[-1] for at in (some[i : i + batch] for i in range(0, len(some), batch))])
        for i in range(ORDER):
            add_rows(sums[i], own[some, i], pulls)
        places += np.bincount(own[some].ravel(), minlength=n + 1)
    grad = sum(x.T @ c.T for x, c in zip(sums, model.c))
    of = ((k.keys >> C.U64(32)) * C.U64(n_buckets)) >> C.U64(32)
    rows = []
    for b in np.unique(of):
        a = of == b
        rows.append((c.chunk, int(b), k.keys[a].tobytes(), packed_rows(grad[a]), C.packed_counts(places[:-1][a])))
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.table({f.split()[0]: pa.array(x, t) for f, x, t in zip(EVIDENCE.split(", "), cols, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])})


def packed_rows(x: np.ndarray) -> bytes:
    """Rows in steps of a 127th of their greatest value, a byte each."""
    step = np.abs(x).max(axis=1, initial=0).astype("<f4") / np.float32(127)
    return step.tobytes() + np.rint(x / np.where(step > 0, step, 1)[:, None]).astype(np.int8).tobytes()


def unpacked_rows(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4", n)[:, None] * np.frombuffer(raw, np.int8, offset=4 * n).reshape(n, -1)


EVIDENCE = "chunk long, bucket long, keys binary, grad binary, places binary"
#: Precision of the prior of a word's own representation, which has the mean 0.
PRECISION = 16.0


def representations(evidence: DataFrame, bend: np.ndarray) -> DataFrame:
    """For each row of evidence, its words' representations, packed: one Newton step of each from its summed
    gradient, with the mean curvature for each of its places and the prior's."""
    dim = len(bend)
    curve, axes = np.linalg.eigh((bend + bend.T) / 2)

    def run(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), C.U64) for x in t.column("keys")]
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        places = np.bincount(inverse, np.concatenate([C.unpacked_counts(x.as_py(), len(p)) for x, p in zip(t.column("places"), parts)]))
        grad = np.concatenate([unpacked_rows(x.as_py(), len(p)) for x, p in zip(t.column("grad"), parts)])
        grad = np.stack([np.bincount(inverse, grad[:, j]) for j in range(dim)], axis=1)
        own = -(grad @ axes / (places[:, None] * np.maximum(curve, 0) + PRECISION) @ axes.T)
        replies = [packed_rows(own[x]) for x in np.split(inverse, np.cumsum([len(p) for p in parts])[:-1])]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "reply": pa.array(replies, pa.binary())})

    return evidence.groupBy("bucket").applyInArrow(run, C.REPLY)


def score_documents(df: DataFrame, mod: int = 7, remainder: int = 2, share: float = 1 / 4096, dim: int = 16, rounds: int = 3, rate: float = 0.03, batch: int = 2048, noise: int = 64, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every text; documents whose crc32 of the id modulo `mod` is `remainder` are held out of all learning."""
    n_buckets = C.buckets(df.sparkSession)
    chunks = C.pack(df, id_col, text_col)

    def ask(batches):
        for c in C.each_chunk(batches):
            yield C.request_rows(c.chunk, *Sequence(c, mod, remainder).request(), n_buckets)

    replies = C.saved(counted(chunks.mapInArrow(ask, C.REQUEST), share))
    totals = np.sum([np.frombuffer(r.reply, "<i8") for r in replies.where("chunk = -1").select("reply").collect()] or [np.zeros(2 * GROUPS + 3, np.int64)], axis=0)
    v, n, ends = (int(x) for x in totals[2 * GROUPS :])
    top = top_rows(replies, share * n).collect()  # at most 1 / share rows
    words = Vocabulary([(r.key & (1 << 64) - 1, r.n) for r in top], n, v, ends, totals[:GROUPS], totals[GROUPS : 2 * GROUPS])
    model, bend = train(chunks, words, mod, remainder, dim, rounds, rate, batch, noise) if n else (None, None)
    replies = replies.where("chunk >= 0")

    def known(c, replies):
        return Known(c, replies.filter(pc.is_valid(replies.column("reply"))) if replies.num_rows else replies, words, least, n_buckets, mod, remainder)

    def weigh(c, replies):
        return evidence_rows(c, known(c, replies), model, words, batch, noise, n_buckets)

    both = replies.withColumn("own", F.lit(None).cast("binary"))
    if model:
        C.release(df.sparkSession)  # the first exchange's shuffles have served
        own = representations(C.with_replies(chunks, replies, weigh, EVIDENCE), bend)
        both = both.unionByName(own.select("chunk", "bucket", F.lit(None).cast("binary").alias("reply"), F.col("reply").alias("own")))

    def score(c, replies):
        k = known(c, replies)
        s, vectors = k.s, np.zeros((len(k.keys) + 1, dim), np.float32)
        if model and len(k.keys):
            got = {b: o for b, o in zip(replies.column("bucket").to_pylist(), replies.column("own").to_pylist()) if o is not None}
            of = ((k.keys >> C.U64(32)) * C.U64(n_buckets)) >> C.U64(32)
            vectors[:-1] = np.concatenate([unpacked_rows(got[int(b)], size) for b, size in zip(*np.unique(of, return_counts=True))])
        base = np.log10((k.count + 1) / (n + v + 1))
        own = token_log10(model, words, k.ids, s.at, k.count, k.number, vectors) if model else base
        first = np.concatenate([[0], s.stop[:-1]]).astype(np.int64)
        add = lambda x: np.add.reduceat(x, first) if len(first) else x
        return pa.table({
            "doc_id": C.id_array(c.ids), "held_out": pa.array(s.held), "n_tokens": pa.array(np.diff(np.concatenate([[0], s.stop])).astype(np.int64)),
            "n_known": pa.array(add((k.count > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(c), n, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(own)),
        })

    return C.with_replies(chunks, both, score, SCORED)


def log_sums(s: np.ndarray) -> np.ndarray:
    """Of each row, which it overwrites, the natural logarithm of the sum of its exponentials."""
    plain = s.max(initial=0) < 60 and s.min(initial=0) > -60  # single precision ends at 88
    top = np.zeros((len(s), 1), s.dtype) if plain else s.max(1, keepdims=True)
    if not plain:
        s -= top
    np.exp(s, out=s)
    return np.log(s @ np.ones(s.shape[1], s.dtype)) + top[:, 0]


#: Scores that a core works on at once, so that they stay in its cache.
AT_ONCE = 1 << 18
#: Classes whose exponentials are held at once for all words of a chunk.
CLASSES = 64


def log_normalisers(each: list[np.ndarray], pairs: np.ndarray, q: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Of each context (a column of `pairs`, which names for each place a row of `each`), the natural logarithm of the sum over all
    classes of their scores' exponentials. These are products of one factor for each place, so that exponentials are
    taken once a word, not once a context; where factors could leave single precision, they are taken of the scores."""
    far = [reach(x, q) + np.abs(b).max() > FAR / ORDER for x in each]
    apart = functools.reduce(np.logical_or, (f.take(p) for f, p in zip(far, pairs)))
    out, near = np.zeros(pairs.shape[1]), np.flatnonzero(~apart)
    own = [p[near] for p in pairs]
    calm = [np.where(f[:, None], 0, x) for f, x in zip(far, each)]
    kept = np.empty((2, len(pairs), max(len(each[0]), step) * CLASSES), q.dtype)  # fresh memory for each step would cost more than the sums
    for y in range(0, len(q) if len(near) else 0, CLASSES):
        some, bias = q[y : y + CLASSES].T, b[y : y + CLASSES]
        shape = lambda x, n, w=len(bias): x[: n * w].reshape(n, w)
        factors = [shape(x, len(each[0])) for x in kept[0]]
        for i, (x, factor) in enumerate(zip(calm, factors)):
            for lo in range(0, len(x), step):
                part = np.matmul(x[lo : lo + step], some, out=factor[lo : lo + step])
                if not i:
                    part += bias
                np.exp(part, out=part)
        for lo in range(0, len(near), step):
            got = [f.take(p[lo : lo + step], axis=0, out=shape(x, len(p[lo : lo + step])), mode="clip") for f, p, x in zip(factors, own, kept[1])]
            out[near[lo : lo + step]] += np.einsum("ij,ij->i", functools.reduce(np.multiply, got[:-1]), got[-1])
    out[near] = np.log(out[near])
    rest, step = np.flatnonzero(apart), min(step, max(64, AT_ONCE // len(q)))
    for lo in range(0, len(rest), step):
        some = rest[lo : lo + step]
        out[some] = log_sums(sum(x.take(p[some], axis=0) for x, p in zip(each, pairs)) @ q.T + b)
    return out


def token_log10(model: LogBilinear, words: Vocabulary, ids: np.ndarray, at: np.ndarray, count: np.ndarray, number: np.ndarray, vectors: np.ndarray, step: int = 4096) -> np.ndarray:
    """log10 probability of each token, by batches of distinct contexts; number: each token's row of `vectors`, whose last is
    zero and stands for words without a representation of their own."""
    none, size, single = len(vectors) - 1, words.size + 1, np.float32
    before = contexts(np.where(number < none, size + number, ids), at, words.size)  # a class, the begin, or a word
    code, row = np.unique(before @ (size + none) ** np.arange(ORDER), return_inverse=True)
    of = np.zeros(none, np.int64)
    of[number[number < none]] = ids[number < none]
    each = np.concatenate([model.r, model.r[of] + vectors[:none]]).astype(single)  # representations, and what each place makes of them
    each, q, b = [each @ c.astype(single) for c in model.c], model.q.astype(single), model.b.astype(single)
    out = -log_normalisers(each, np.stack([code // (size + none) ** i % (size + none) for i in range(ORDER)]), q, b, step)[row]
    for lo in range(0, len(ids), step):
        some = ids[lo : lo + step]
        hat = sum(x.take(p, axis=0) for x, p in zip(each, before[lo : lo + step].T))
        out[lo : lo + step] += np.einsum("ij,ij->i", hat, q.take(some, axis=0)) + b[some]
    rest = ids < GROUPS
    out[rest] += np.log((count[rest] + 1) / (words.rest_n + words.rest_v + 1)[ids[rest]])
    return out / np.log(10)
