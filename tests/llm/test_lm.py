import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from signalpanel.llm import common as C
from signalpanel.llm import lm, queries

from .helpers import corpus, docs


def test_counts_equal_brute_force(spark):
    rows = corpus()
    got = lm.score_documents(docs(spark, rows), share=0.02, dim=4, least=3).collect()
    words = [((t or "").encode().lower()).split() for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter()
    for w, h in zip(words, held):
        if not h:
            count.update([*w, None])
    n, v = sum(count.values()), len(count)
    want = []
    for (i, _), w, h in zip(rows, words, held):
        c = [count[x] for x in [*w, None]]
        want.append((i is None, i or 0, h, len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 1) / (n + v + 1)) for x in c), 6)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def vocabulary(rng, size=300):
    """A vocabulary of random words with counts, the most frequent as classes of their own; the words left to the groups, and their counts."""
    keys = np.unique(rng.integers(1, 2**62, size).astype(np.uint64))
    count = rng.integers(1, 30, len(keys))
    group = (keys & np.uint64(lm.GROUPS - 1)).astype(int)
    top = [(int(k), int(c)) for k, c in zip(keys[:9], count[:9])]
    group_n, group_v = np.bincount(group, count, lm.GROUPS), np.bincount(group, minlength=lm.GROUPS)
    return lm.Vocabulary(top, int(count.sum()) + 5, len(keys) + 1, 5, group_n, group_v), keys, count


def test_probabilities_add_up_to_one():
    """Of all words, the unseen of each group, and the end, after classes, words with a representation of their own, and the begin."""
    rng = np.random.default_rng(4)
    words, keys, count = vocabulary(rng)
    model = lm.LogBilinear(words.size, 4, np.maximum(words.counts, 0.5))
    unseen = np.arange(lm.GROUPS, dtype=np.uint64)  # a word of count 0 stands for all unseen ones of its group
    every, c = np.concatenate([keys, unseen, [lm.END]]), np.concatenate([count, np.zeros(lm.GROUPS), [5]])
    ids, own = words.ids(every), np.flatnonzero(words.ids(every) < lm.GROUPS)[:40]
    number = np.full(len(every), len(own))
    number[own] = np.arange(len(own))
    vectors = np.concatenate([rng.normal(0, 0.5, (len(own), 4)), np.zeros((1, 4))]).astype(np.float32)
    for before in ([], [3], [own[0]], [own[1], 2], [own[2], own[3]]):
        total = 0.0
        for k in range(len(every)):
            at = [*before, k]
            got = lm.token_log10(model, words, ids[at], np.arange(len(at)), c[at], number[at], vectors)[-1]
            total += 10.0**got
        assert abs(total - 1) < 1e-4


def test_scores_equal_plain_loops():
    """Token probabilities by the definition, one token and class at a time."""
    rng = np.random.default_rng(5)
    words, keys, count = vocabulary(rng, 60)
    model = lm.LogBilinear(words.size, 3, np.maximum(words.counts, 0.5))
    ids, number = words.ids(keys), np.where(words.ids(keys) < lm.GROUPS, np.arange(len(keys)), len(keys))
    vectors = np.concatenate([rng.normal(0, 0.5, (len(keys), 3)), np.zeros((1, 3))]).astype(np.float32)
    got = lm.token_log10(model, words, ids, np.arange(len(keys)), count, number, vectors, step=7)
    for i in range(len(keys)):
        hat = np.zeros(3)
        for k in range(lm.ORDER):
            j = i - k - 1
            hat += (model.r[words.size] if j < 0 else model.r[ids[j]] + vectors[number[j]]) @ model.c[k]
        score = [float(hat @ model.q[y] + model.b[y]) for y in range(words.size)]
        p = math.exp(score[ids[i]]) / sum(map(math.exp, score))
        if ids[i] < lm.GROUPS:
            p *= (count[i] + 1) / (words.rest_n[ids[i]] + words.rest_v[ids[i]] + 1)
        assert abs(got[i] - math.log10(p)) < 1e-4


def test_scores_far_apart_stay_finite():
    """Contexts of one batch whose scores lie hundreds apart, which one common shift turned into a logarithm of zero."""
    rng = np.random.default_rng(8)
    words, keys, count = vocabulary(rng, 60)
    ids, none = words.ids(keys), np.zeros((1, 3), np.float32)
    for far in (0, 30, 200):
        model = lm.LogBilinear(words.size, 3, np.maximum(words.counts, 0.5))
        model.q[:, 0] = 1
        model.r[:, 0] = np.linspace(-far, far, words.size + 1)
        got = lm.token_log10(model, words, ids, np.arange(len(keys)), count, np.zeros(len(keys), int), none)
        hat = sum(model.r[lm.contexts(ids, np.arange(len(keys)), words.size)[:, k]] @ model.c[k] for k in range(lm.ORDER))
        s = hat @ model.q.T + model.b
        s -= s.max(1, keepdims=True)
        want = s[np.arange(len(keys)), ids] - np.log(np.exp(s).sum(1))
        want += np.where(ids < lm.GROUPS, np.log((count + 1) / (words.rest_n + words.rest_v + 1)[np.minimum(ids, lm.GROUPS - 1)]), 0)
        assert np.allclose(got, want / np.log(10), atol=1e-3)


def test_a_step_of_training_equals_adam():
    """Parameters after some batches, with gradients that add up repeated classes, against Adam by its definition."""
    rng = np.random.default_rng(9)
    noise, n = rng.random(7) + 0.1, 40
    ctx, target = rng.integers(0, 8, (n, 2)), rng.integers(0, 7, n)
    model, plain = lm.LogBilinear(7, 3, noise), lm.LogBilinear(7, 3, noise)
    lm.Trainer(model, 0.05, 16, 5, 11).feed(ctx, target)
    draw, m, v = np.random.default_rng(11), 0, 0
    order = draw.permutation(n)
    for t, lo in enumerate(range(0, n, 16), 1):
        at = order[lo : lo + 16]
        g, _ = plain.gradient(ctx[at], target[at], draw.choice(7, 5, p=plain.noise))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        plain.flat -= 0.05 / (1 + t / 200) ** 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    assert np.allclose(model.flat, plain.flat, atol=1e-9)


def test_vocabulary_of_words_grows_with_the_corpus(spark):
    """Every word above the count threshold has a representation of its own: the Newton step from all of its places."""
    grad = lambda *rows: lm.packed_rows(np.array(rows, float))
    key = lambda *k: np.array(k, np.uint64).tobytes()
    rows = [(0, 0, key(3, 9), grad([1, 2], [4, 0]), C.packed_counts(np.array([2, 300]))), (7, 0, key(9, 11), grad([-2, 2], [0, 0]), C.packed_counts(np.array([1, 0]))), (7, 5, key(77), grad([1, 1]), C.packed_counts(np.array([1])))]
    bend = np.array([[2.0, 0.5], [0.5, 1.0]])
    got = {(r.chunk, r.bucket): lm.unpacked_rows(r.reply, 1 if r.bucket or r.chunk == 9 else 2) for r in lm.representations(spark.createDataFrame(rows, lm.EVIDENCE), bend).collect()}
    step = lambda g, n: -np.linalg.solve(n * bend + lm.PRECISION * np.eye(2), g)
    want = {(0, 0): [step([1, 2], 2), step([2, 2], 301)], (7, 0): [step([2, 2], 301), step([0, 0], 0)], (7, 5): [step([1, 1], 1)]}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=5e-3) for k in want)
    for n in (50, 3000):
        rng = np.random.default_rng(n)
        text = [" ".join(f"w{x}" for x in rng.integers(0, n, 40)) for _ in range(n // 4)]
        chunk = C.pack(docs(spark, list(enumerate(text))).coalesce(1)).toArrow()
        c = C.Chunk(chunk)
        s = lm.Sequence(c, 7, 2)
        keys, counts = s.request()
        replies = pa.table({"bucket": [0], "reply": [C.packed_totals(counts)]})
        group = (keys & np.uint64(lm.GROUPS - 1)).astype(int)
        words = lm.Vocabulary([], int(counts.sum()), len(keys), 0, np.bincount(group, counts * (keys != lm.END), lm.GROUPS), np.bincount(group, minlength=lm.GROUPS))
        k = lm.Known(c, replies, words, 3, 1, 7, 2)
        assert len(k.keys) == (counts[keys != lm.END] >= 3).sum() > n * 0.9
        # gradients and places of all training tokens before others, by one loop over them
        model = lm.LogBilinear(words.size, 4, np.maximum(words.counts, 0.5))
        t = lm.evidence_rows(c, k, model, words, 10**9, 6, 1)
        use = np.flatnonzero(~s.held[s.doc])
        drawn = np.random.default_rng(c.chunk + 1).choice(words.size, 6, p=model.noise)
        backs = model.backs(lm.contexts(k.ids, s.at, words.size)[use], k.ids[use], drawn)
        want, places = np.zeros((len(k.keys), 4)), np.zeros(len(k.keys), int)
        for j, at in enumerate(use):
            for i in range(lm.ORDER):
                if s.at[at] > i and k.number[at - i - 1] < len(k.keys):
                    want[k.number[at - i - 1]] += backs[i][j]
                    places[k.number[at - i - 1]] += 1
        assert (np.abs(lm.unpacked_rows(t.column("grad")[0].as_py(), len(want)) - want) <= np.abs(want).max(1)[:, None] / 200 + 1e-4).all()
        assert C.unpacked_counts(t.column("places")[0].as_py(), len(places)).tolist() == places.tolist()


def test_backs_equal_differences():
    """The gradient by a token before, and the mean curvature by second differences."""
    rng = np.random.default_rng(6)
    noise = rng.random(9) + 0.1
    model = lm.LogBilinear(9, 3, noise)
    ctx, target, drawn = rng.integers(0, 10, (4, 2)), rng.integers(0, 9, 4), rng.integers(0, 9, 5)

    def loss(own):
        hat = model.predicted(ctx, own)
        shift = np.log(5 * model.noise)
        pos, neg = (hat * model.q[target]).sum(1) + (model.b - shift)[target], hat @ model.q[drawn].T + (model.b - shift)[drawn]
        return np.log1p(np.exp(-pos)) + np.log1p(np.exp(neg)).sum(1)

    backs, bend = model.backs(ctx, target, drawn), np.zeros((3, 3))
    unit = lambda k, j, e: np.eye(6)[3 * k + j].reshape(1, 2, 3).repeat(4, 0) * e
    for k in range(2):
        for j in range(3):
            e = 1e-4
            assert np.allclose((loss(unit(k, j, e)) - loss(unit(k, j, -e))) / (2 * e), backs[k][:, j], atol=1e-4)
            for i in range(3):
                two = lambda a, b: loss(unit(k, j, a) + unit(k, i, b)).mean()  # noqa: B023, E731
                e = 1e-3
                bend[j, i] += (two(e, e) - two(e, -e) - two(-e, e) + two(-e, -e)) / (4 * e * e) / 2
    assert np.allclose(model.gradient(ctx, target, drawn)[1], bend, atol=1e-4)


def test_totals_beyond_32_bits():
    for x in ([], [1, 2**32 - 1], [3, 2**32 + 5, 2**45]):
        assert C.unpacked_totals(C.packed_totals(np.array(x, np.int64)), len(x)).tolist() == x


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    noise = rng.random(6) + 0.1
    model = lm.LogBilinear(6, 3, noise)
    ctx, target, drawn = rng.integers(0, 7, (5, 2)), rng.integers(0, 6, 5), rng.integers(0, 6, 4)

    def loss(flat):
        m = lm.LogBilinear(6, 3, noise, flat)
        shift, hat = np.log(4 * m.noise), m.predicted(ctx)
        pos = (hat * m.q[target]).sum(1) + m.b[target] - shift[target]
        neg = hat @ m.q[drawn].T + (m.b - shift)[drawn]
        return np.mean(np.log1p(np.exp(-pos)) + np.log1p(np.exp(neg)).sum(1))

    g, _ = model.gradient(ctx, target, drawn)
    for i in range(0, len(g), 3):
        step = np.zeros_like(g)
        step[i] = 1e-5
        assert abs((loss(model.flat + step) - loss(model.flat - step)) / 2e-5 - g[i]) < 1e-6


def test_better_than_the_base_on_held_out_documents(spark):
    rows = queries.op6_lm_score(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert rows.s > rows.b
    assert lm.score_documents(docs(spark, [])).count() == 0


def chunk_of_many_contexts(rng):
    """A vocabulary, a trained-looking model, tokens of few words in many contexts, and some words' own representations."""
    words, keys, count = vocabulary(rng)
    model = lm.LogBilinear(words.size, 4, np.maximum(words.counts, 0.5))
    pick = rng.integers(0, 60, 4000)
    ids = words.ids(keys)
    number = np.where(ids < lm.GROUPS, np.arange(len(keys)), len(keys)).clip(max=40)
    vectors = np.concatenate([rng.normal(0, 0.5, (40, 4)), np.zeros((1, 4))]).astype(np.float32)
    return words, model, ids[pick], number[pick], count[pick], vectors


def test_exponentials_are_taken_once_a_word(monkeypatch):
    """Not once a context: 4000 tokens make some 2400 contexts of 60 words."""
    words, model, ids, number, count, vectors = chunk_of_many_contexts(np.random.default_rng(12))
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: (taken.append(np.size(x)), exp(x, *a, **k))[1])
    got = lm.token_log10(model, words, ids, np.arange(len(ids)), count, number, vectors)
    assert sum(taken) <= lm.ORDER * (words.size + 1 + 40) * words.size < len(ids) / 3 * words.size
    assert np.isfinite(got).all()


def test_sums_by_factors_equal_sums_of_scores():
    """Also where some words' scores lie too far apart for factors in single precision, alone or with others."""
    rng = np.random.default_rng(13)
    for far in (0, 60, 1000):
        for classes in (5, lm.CLASSES, 2 * lm.CLASSES + 1):
            each = [rng.normal(0, 1, (30, 4)).astype(np.float32) for _ in range(lm.ORDER)]
            each[0][:5] *= far
            each[1][3:9, 2] += far
            q, b = rng.normal(0, 1, (classes, 4)).astype(np.float32), rng.normal(-4, 2, classes).astype(np.float32)
            pairs = rng.integers(0, 30, (lm.ORDER, 500))
            got = lm.log_normalisers(each, pairs, q, b, 64)
            s = sum(x[p].astype(float) for x, p in zip(each, pairs)) @ q.T.astype(float) + b
            assert np.allclose(got, s.max(1) + np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)), rtol=1e-6, atol=1e-4)
    assert lm.log_normalisers(each, pairs[:, :0], q, b, 64).shape == (0,)


def test_odds_by_class_give_the_gradient_of_whole_scores():
    """With odds of all classes, with those of the drawn ones, and where odds would leave single precision."""
    rng = np.random.default_rng(14)
    noise = rng.random(9) + 0.1
    ctx, target, drawn = rng.integers(0, 10, (50, lm.ORDER)), rng.integers(0, 9, 50), rng.integers(0, 9, 6)
    for far in (1, 10, 1000):
        model = lm.LogBilinear(9, 3, noise, kind=np.float32)
        model.r[:] *= far
        hat = model.predicted(ctx).astype(float)
        shift = (model.b - np.log(6 * model.noise)).astype(float)
        with np.errstate(over="ignore"):
            much = 1 / (1 + np.exp(-(hat @ model.q[drawn].T + shift[drawn])))
            miss = 1 / (1 + np.exp((hat * model.q[target]).sum(1) + shift[target]))
        want = much @ model.q[drawn] - miss[:, None] * model.q[target]
        odds = model.odds(model.q, model.shift(6))
        assert (odds is None) == (far == 1000)
        for n in (50, 20):  # 20 tokens are fewer than the classes at both places
            for o in (None, odds):
                assert np.allclose(model.noise_contrast(ctx[:n], target[:n], drawn, o)[-1], want[:n], atol=1e-4)


def test_rows_add_up_by_place():
    out, at, rows = np.ones((2, 3)), np.array([2, 0, 3, 2]), np.array([[1, 2], [3, 4], [5, 6], [7, 8]], np.float32)
    lm.add_rows(out, at, rows)
    assert out.tolist() == [[4, 1, 9], [5, 1, 11]]


def test_class_ids_and_contexts_by_their_definitions():
    """Also for keys that share their first bits with listed ones, and documents shorter than a context."""
    listed = [(5 << 48) + 9, (5 << 48) + 300, (7 << 48) + 1]
    words = lm.Vocabulary([(x, 3) for x in listed], 20, 9, 2, np.full(lm.GROUPS, 3.0), np.full(lm.GROUPS, 2))
    keys = np.array([*listed, listed[0] + 1, (1 << 64) - 1, 0, (6 << 48) + 9, int(lm.END)], np.uint64)
    assert words.ids(keys).tolist() == [lm.GROUPS + 1, lm.GROUPS + 2, lm.GROUPS + 3, 10, 127, 0, 9, lm.STOP]
    assert lm.Vocabulary([], 20, 9, 2, np.ones(lm.GROUPS), np.ones(lm.GROUPS)).ids(keys[:4]).tolist() == [9, 44, 1, 10]
    ids, at = np.arange(6) + 50, np.array([0, 0, 1, 2, 3, 0])
    assert lm.contexts(ids, at, 99).tolist() == [[99, 99], [99, 99], [51, 99], [52, 51], [53, 52], [99, 99]]
    assert lm.contexts(ids[:1], at[:1], 99).tolist() == [[99, 99]] and lm.contexts(ids[:0], at[:0], 99).shape == (0, lm.ORDER)
