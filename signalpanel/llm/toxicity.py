"""Toxic passages by maximum-scoring segments.

1. Token log-odds. In a bounded sample of labelled documents, each token's share of
   documents marked toxic is taken with a Dirichlet (for two classes: beta) prior
   centred on the share of its first bytes, which in turn is centred on the share of
   all tokens. Its log-odds against that base, less a drift, is its score; tokens
   without evidence score the negative drift.
2. Segments. One linear scan finds every maximal-scoring segment of a text (Ruzzo and
   Tompa). Only tokens with evidence are visited; the gap before each counts at once.
3. Extreme values. The best segment of a clean text of m tokens exceeds x with
   probability 1 - exp(-K m exp(-lambda x)) (Karlin and Altschul). lambda solves
   E[exp(lambda s)] = 1 over tokens of clean texts, K is its maximum-likelihood
   estimate; both, and a logistic curve over the best normalised score and the logarithm of
   the sum over significant segments, come from labelled documents that the log-odds did not see.

Scores depend on text alone. The model is fitted on at most `max_labelled` labelled
documents, chosen by a hash of the id, and keeps every term of theirs that scores or that
keeps its beginning from scoring; so what is broadcast is bounded by that sample. All
documents are scored in one pass without a shuffle, very long texts in linear time.

Null and empty texts have no segment; rows without an id are never fitted on; a label
table without rows of both classes gives every text the score of its base rate, at
most 0.49; several labels of one id count as toxic if any does; further columns are
ignored and repeated rows stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of a token: digits, letters and everything beyond ASCII.
IN_TOKEN = np.zeros(256, bool)
IN_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
PREFIX = 5
PRIOR = 4.0
#: Standard errors taken off a log-odds, so that a few documents alone say little.
CAUTION = 2.5
DRIFT = 0.25
#: Segments with an expectation below this in a clean text of the same length are significant.
SIGNIFICANT = 0.5
#: Normalised scores count up to this in the calibration.
MOST = 30.0


class Tokens:
    """Tokens of an Arrow column of texts: document number, hash of the token and of its first bytes."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = C.LOWER_NP[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]]
        off = off - off[0]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = IN_TOKEN[raw]
        starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        joined = cuts[inside[cuts] & inside[cuts + 1]]
        starts[joined] = ends[joined] = True
        start, end = np.flatnonzero(starts), np.flatnonzero(ends)
        values = C.BYTE[raw]
        zero = np.zeros(0, C.U64)
        self.word = C.span_hashes(values, start, end) if len(start) else zero
        short = np.minimum(end, start + PREFIX)
        self.prefix = C.mix(C.span_hashes(values, start, short) ^ C.U64(5)) if len(start) else zero
        self.first = np.searchsorted(start, off)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def slices(batches, limit: int = 1 << 20):
    """Batches cut so that each holds about `limit` bytes of text in its last column."""
    for batch in batches:
        text = batch.column(batch.num_columns - 1).cast(pa.large_string())
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment (first token, last token, score) of a text whose other tokens score -drift.

    Each candidate keeps the place of the last candidate before it whose left sum is smaller. A search follows these links,
    and never again meets what it has passed, so the scan is linear in the tokens given."""
    first, last, left, right, link = [], [], [], [], []  # of the candidates: tokens, sums before and through them, links
    total, before = 0.0, -1
    for p, s in zip(at, score):
        total -= drift * (p - before - 1)
        before = p
        if s <= 0:
            total += s
            continue
        a, low = p, total
        total += s
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= total:
                break
            a, low = first[j], left[j]  # the candidate and all after it become one with the new one
            k, j = j, link[j]
            del first[k:], last[k:], left[k:], right[k:], link[k:]
        for column, value in zip((first, last, left, right, link), (a, p, low, total, j)):
            column.append(value)
    return [(a, b, r - x) for a, b, x, r in zip(first, last, left, right)]


class Model:
    """Scored terms, the constants of the extreme-value law and the calibration."""

    def __init__(self, base: float):
        self.base = base
        self.word = self.prefix = np.zeros(0, C.U64)
        self.word_score = self.prefix_score = np.zeros(0)
        self.lam, self.k = 1.0, 1.0
        self.curve = (math.log(min(base, 0.49) / (1 - min(base, 0.49))), 0.0, 0.0)

    def token_scores(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the tokens with evidence, and their scores."""

        def look(keys, values, wanted):
            if not len(keys):
                return np.full(len(wanted), np.nan)
            slot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[slot] == wanted, values[slot], np.nan)

        score = look(self.word, self.word_score, t.word)
        rest = np.flatnonzero(np.isnan(score))
        score[rest] = look(self.prefix, self.prefix_score, t.prefix[rest])
        at = np.flatnonzero(~np.isnan(score))
        return at, score[at]

    def found(self, texts: pa.Array):
        """For each text: tokens, best segment score, significant segments, and two figures of those: the best normalised score and the
        logarithm of their sum."""
        t = Tokens(texts)
        at, score = self.token_scores(t)
        cut = np.searchsorted(at, t.first)
        at_list, score_list = at.tolist(), score.tolist()
        for i in range(len(texts)):
            m, a, b = int(t.first[i + 1] - t.first[i]), cut[i], cut[i + 1]
            segs = segments([p - int(t.first[i]) for p in at_list[a:b]], score_list[a:b], DRIFT) if b > a else []
            best = max((s for *_, s in segs), default=0.0)
            floor = math.log(self.k * max(m, 1))
            norm = [(x, y, self.lam * s - floor) for x, y, s in segs]
            hit = [(x, y, v) for x, y, v in norm if math.exp(min(50.0, -v)) < SIGNIFICANT]
            yield m, best, hit, (max((min(v + 1, MOST) for *_, v in hit), default=0.0), math.log1p(sum(v + 1 for *_, v in hit)))

    def score(self, figures: tuple[float, float]) -> float:
        z = sum(w * x for w, x in zip(self.curve, (1.0, *figures)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def evidence(n: str, t: str, prior: Column, base: float) -> Column:
    """Posterior log-odds of a term that t of n texts marked toxic hold, against the base, less CAUTION standard errors and the drift."""
    hits, misses = F.col(t) + PRIOR * prior, F.col(n) - F.col(t) + PRIOR * (1 - prior)
    return F.log(hits / misses) - math.log(base / (1 - base)) - CAUTION * F.sqrt(1 / hits + 1 / misses) - DRIFT


def table(terms: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of term, value: as many as the bounded sample of labelled texts holds."""
    got = terms.toPandas()
    keys, value = got.term.to_numpy(np.int64).view(C.U64), got.value.to_numpy(float)
    order = np.argsort(keys)
    return keys[order], value[order]


def decay(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive solution lambda of sum(weight exp(lambda score)) = sum(weight), between 0.001 and 20."""
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (weight * np.expm1(np.minimum(mid * score, 600))).sum() < 0 else (lo, mid)
    return lo


def extent(lam: float, size: np.ndarray, best: np.ndarray, weight: np.ndarray) -> float:
    """The maximum-likelihood K of texts of these sizes and best scores, each `weight` times."""
    return float(weight.sum()) / max(1e-9, float((weight * np.maximum(size, 1) * np.exp(-lam * best)).sum()))


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows given; `labels` has doc_id and toxic."""
    C.bound_batches(documents.sparkSession)
    ids = F.col("doc_id").cast("long")
    picked = (
        labels.select(ids.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("draw", F.xxhash64("doc_id", F.lit(17))).orderBy("draw", "doc_id").limit(max_labelled)
        .select("doc_id", "toxic", (F.pmod("draw", F.lit(10)) < 7).alias("counted"))
    )
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(picked), "doc_id").select("toxic", "counted", "text")

    def count(batches):
        """Documents and toxic documents of each term of this task, and of all documents under kind 2."""
        for batch in slices(batches):
            t, toxic = Tokens(batch.column(2)), np.array(batch.column(0).to_pylist(), np.int64)
            out = []
            for kind, keys in ((0, t.word), (1, t.prefix)):
                pairs = np.unique(np.stack([keys, t.doc.astype(C.U64)]), axis=1) if len(keys) else np.zeros((2, 0), C.U64)
                key, first, n = np.unique(pairs[0], return_index=True, return_counts=True)
                hits = np.add.reduceat(toxic[pairs[1].astype(np.int64)], first) if len(first) else np.zeros(0, np.int64)
                # a word's prefix: of any of its places
                parent = np.zeros(len(key), C.U64)
                if kind == 0 and len(key):
                    _, place = np.unique(keys, return_index=True)
                    parent = t.prefix[place]
                out.append((np.full(len(key), kind), key, parent, n, hits))
            out.append((np.array([2]), np.zeros(1, C.U64), np.zeros(1, C.U64), np.array([len(toxic)]), np.array([toxic.sum()])))
            cols = [np.concatenate(x) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if i == 0 else x.view(np.int64) if x.dtype == C.U64 else x.astype(np.int64)) for i, x in enumerate(cols)], ["kind", "term", "parent", "n", "t"])

    counts = joined.where("counted").mapInArrow(count, "kind int, term long, parent long, n long, t long")
    counts = C.saved(counts.groupBy("kind", "term", "parent").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))
    total = counts.where("kind = 2").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    n_all, t_all = total.n or 0, total.t or 0
    base = (t_all + 0.5) / (n_all + 1.0)
    model = Model(base)
    if not 0 < t_all < n_all:
        return model
    # a word that a toxic text holds begins as one does, so words of other beginnings say nothing and have no prefix that does
    pre = counts.where("kind = 1 AND t > 0").select(F.col("term").alias("parent"), evidence("n", "t", F.lit(base), base).alias("by_prefix"), ((F.col("t") + PRIOR * base) / (F.col("n") + PRIOR)).alias("prior"))
    # a prior near certainty would leave a few documents nothing to say
    words = counts.where("kind = 0").join(pre, "parent").withColumn("value", evidence("n", "t", F.least("prior", F.lit(0.9)), base))
    # words that say less than the base are left to count as drift, and keep their prefix from speaking for them
    words = words.where((F.col("value") > -DRIFT) | (F.col("by_prefix") > 0)).select("term", F.greatest("value", F.lit(-DRIFT)).alias("value"))
    model.word, model.word_score = table(words)
    model.prefix, model.prefix_score = table(pre.where("by_prefix > 0").select(F.col("parent").alias("term"), F.col("by_prefix").alias("value")))

    def features(batches, m=model):
        """Token scores of clean texts as a histogram (kind 0), best segment of each text (kind 1)."""
        for batch in slices(batches):
            toxic = np.array(batch.column(0).to_pylist())
            t = Tokens(batch.column(2))
            at, score = m.token_scores(t)
            clean = toxic[t.doc] == 0
            value, n = np.unique(np.round(score[clean[at]], 1), return_counts=True)
            rest = int(clean.sum() - clean[at].sum())
            rows = [(0, float(v), float(k), 0.0) for v, k in zip([-DRIFT, *value], [rest, *n])]
            rows += [(1, float(size), best, float(y)) for (size, best, *_), y in zip(m.found(batch.column(2)), toxic)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.float64()) for i in (1, 2, 3))], ["kind", "a", "b", "y"])

    apart = joined.where("NOT counted")
    seen = C.saved(apart.mapInArrow(features, "kind int, a double, b double, y double").groupBy("kind", "a", F.when(F.col("kind") == 1, F.col("b")).alias("best"), "y").agg(F.sum("b").alias("b"), F.count("*").alias("n")))
    tokens = seen.where("kind = 0").toPandas()  # scores to one decimal: a few hundred rows
    best = seen.where("kind = 1").toPandas()  # equal texts are one row, so at most as many as labelled texts
    if not len(best) or best.y.nunique() < 2:
        return model
    # one pseudo-token at each positive level, so that lambda is finite where clean texts show none
    model.lam = decay(np.concatenate([tokens.a, np.arange(0.5, 6, 0.5)]), np.concatenate([tokens.b, np.full(11, 0.5)]))
    clean = best[best.y == 0]
    model.k = extent(model.lam, clean.a.to_numpy(), clean.best.to_numpy(), clean.n.to_numpy())

    def figures(batches, m=model):
        for batch in slices(batches):
            y = batch.column(0).to_pylist()
            best, total = zip(*(x[3] for x in m.found(batch.column(2))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (best, total, y)], ["best", "total", "y"])

    at = apart.mapInArrow(figures, "best double, total double, y double").groupBy("best", "total", "y").count().toPandas()  # of the sample
    at = at.sort_values(["best", "total", "y"])  # sums in one order whatever the partitions
    model.curve = logistic(at[["best", "total"]].to_numpy(), at.y.to_numpy(), at["count"].to_numpy())
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Intercept and slopes of weighted rows by Newton steps; the ridge keeps separable data finite."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
    return tuple(map(float, w))


SCORED = "doc_id long, score double, predicted int, n_segments long, best_start long, best_end long"


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, number of significant passages, and the best one's token span."""
    C.bound_batches(df.sparkSession)

    def run(batches):
        for batch in slices(batches):
            rows = []
            for _, _, hit, total in model.found(batch.column(1)):
                p = model.score(total)
                a, b, _ = max(hit, key=lambda h: h[2]) if hit else (None, None, 0)
                rows.append((p, int(p >= 0.5), len(hit), a, b))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())))], [c.split()[0] for c in SCORED.split(", ")])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCORED)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df whose text is not predicted toxic, as they are."""
    C.bound_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            # the text comes last, as slices() wants it
            for part in slices([pa.RecordBatch.from_arrays([*batch.columns, batch.column(at)], [*batch.schema.names, "_text"])]):
                clean = [model.score(total) < 0.5 for *_, total in model.found(part.column(part.num_columns - 1))]
                yield part.select(range(part.num_columns - 1)).filter(pa.array(clean, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def passages(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first token, last token, normalised score of every significant passage."""

    def run(batches):
        for batch in slices(batches):
            rows = [(i, a, b, v) for i, (_, _, hit, _) in zip(batch.column(0).to_pylist(), model.found(batch.column(1))) for a, b, v in hit]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "first_token", "last_token", "score"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, first_token long, last_token long, score double")
