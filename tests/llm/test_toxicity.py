import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa

from signalpanel.llm import queries, toxicity

from .helpers import docs


def brute_segments(scores):
    """Maximal-scoring segments by their definition: take a best one, then look left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    n = len(scores)
    total = [0.0, *itertools.accumulate(scores)]
    a, b = max(((i, j) for i in range(n) for j in range(i + 1, n + 1)), key=lambda p: (round(total[p[1]] - total[p[0]], 9), p[0] - p[1]))
    return [*brute_segments(scores[:a]), (a, b - 1, total[b] - total[a]), *((x + b, y + b, s) for x, y, s in brute_segments(scores[b:]))]


def test_segments_equal_the_definition():
    r = random.Random(3)
    for _ in range(300):
        scores = [r.choice([-1.0, -1.0, r.uniform(0.1, 4), r.uniform(-3, 0)]) for _ in range(r.randrange(0, 30))]
        at = [i for i, s in enumerate(scores) if s != -1.0]
        got = toxicity.segments(at, [scores[i] for i in at], 1.0)
        assert [x[:2] for x in got] == [x[:2] for x in brute_segments(scores)]


def test_learns_and_takes_odd_rows(spark):
    r = random.Random(1)
    words = ["w%d" % i for i in range(300)]
    rows, marks = [], []
    for i in range(400):
        text = [r.choice(words) for _ in range(r.randrange(5, 60))]
        if i % 5 == 0:
            text.insert(r.randrange(len(text)), r.choice(["vilest", "vileness", "Grubby"]))
        rows.append((i, " ".join(text)))
        marks.append((i, int(i % 5 == 0)))
    marks += [(None, 1), (3, None), (5, 1), (5, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    table = docs(spark, rows)
    model = toxicity.fit(table, labels)
    odd = docs(spark, [(1, None), (2, ""), (3, "you GRUBBY, grubby thing"), (3, "you GRUBBY, grubby thing"), (None, "w1 w2 w3"), (4, "w1 " * 5000)])
    got = [(x.doc_id, x.predicted) for x in toxicity.score_documents(odd, model).collect()]
    assert got == [(1, 0), (2, 0), (3, 1), (3, 1), (None, 0), (4, 0)]
    right = toxicity.score_documents(table, model).join(labels.where("toxic is not null and doc_id <> 5"), "doc_id").where("predicted = toxic").count()
    assert right >= 390
    assert toxicity.passages(odd, model).count() == 2


def test_no_labels(spark):
    model = toxicity.fit(docs(spark, [(1, "a b")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [x.predicted for x in toxicity.score_documents(docs(spark, [(1, "a b"), (2, None)]), model).collect()] == [0, 0]
    assert toxicity.score_documents(docs(spark, []), model).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    toxic, found, wrong = got.selectExpr("sum(toxic)", "sum(toxic * predicted)", "sum((1 - toxic) * predicted)").first()
    # about a tenth of the toxic labels are on texts without any telling word
    assert toxic > 50 and found / toxic > 0.8 and wrong <= 0.02 * got.count()


def test_scores_do_not_depend_on_slices(spark):
    """A term of many documents is found in every slice of a batch."""
    rows = [(i, ("grim " if i % 3 == 0 else "") + "plain text " * 40) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows).coalesce(1), labels)
    got = toxicity.score_documents(docs(spark, rows), model).join(labels, "doc_id")
    assert got.where("predicted <> toxic").count() == 0


def test_scan_is_linear():
    """A very long text whose sums fall with every hit, and one whose sums rise and fall."""
    n = 200_000
    began = time.process_time()
    assert len(toxicity.segments(list(range(0, 20 * n, 20)), [1.0] * n, 0.25)) == n
    assert len(toxicity.segments(list(range(n)), [1.0 if i % 2 else -2.0 for i in range(n)], 0.25)) == n // 2
    assert time.process_time() - began < 10


def test_every_telling_term_scores(spark):
    """More terms than any fixed list would hold: each of 60,000 words of toxic texts alone marks a text."""
    n, each = 60_000, 1000
    word = lambda k: f"{k % 90_007:05d}x{k}"
    rows = [(i, " ".join(word(k) for k in range(i * each % n, i * each % n + each))) for i in range(0, 12 * n // each)] + [(10**6 + i, f"plain{i % 50} text") for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i < 10**6)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    assert sum(model.token_scores(toxicity.Tokens(pa.array([word(k)])))[1].sum() > 0 for k in range(0, n, 7)) == len(range(0, n, 7))


def test_repeated_rows_of_a_labelled_id_count(spark):
    """Rows of one id are texts of their own; equal ones are one row where the calibration is collected."""
    rows = [(i % 40, ("grim " if i % 40 < 10 else "") + "plain text") for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    assert [x.predicted for x in toxicity.score_documents(docs(spark, [(1, "grim tale"), (2, "plain tale")]), model).orderBy("doc_id").collect()] == [1, 0]


def test_extreme_value_constants():
    """lambda by its equation; K makes the law's likelihood of the best scores largest, by a fine search."""
    score, weight = np.array([-0.25, 0.5, 2.0, 4.0]), np.array([900.0, 20.0, 5.0, 1.0])
    lam = toxicity.decay(score, weight)
    assert lam > 0.01 and abs((weight * np.exp(lam * score)).sum() / weight.sum() - 1) < 1e-9
    size, best, times = np.array([10.0, 200.0, 40.0]), np.array([1.0, 6.0, 0.0]), np.array([3.0, 1.0, 2.0])
    k = toxicity.extent(lam, size, best, times)
    # density of exp(-k m exp(-lam x)) in x, up to what does not depend on k
    like = lambda k: (times * (math.log(k) - k * size * np.exp(-lam * best))).sum()
    assert like(k) >= max(like(k * f) for f in np.linspace(0.2, 5, 997)) - 1e-9


def test_curve_equals_a_plain_search():
    x, y = np.array([[0.0, 0.0], [1.0, 0.5], [3.0, 2.0], [4.0, 1.0]]), np.array([0.0, 1.0, 0.0, 1.0])
    weight = np.array([50.0, 3.0, 2.0, 9.0])
    cost = lambda w: sum(n * math.log1p(math.exp(-(2 * t - 1) * (w[0] + w[1] * a + w[2] * b))) for (a, b), t, n in zip(x, y, weight)) + 0.005 * sum(v * v for v in w)
    w = list(toxicity.logistic(x, y, weight))
    assert all(cost(w) <= cost([v + (d if i == j else 0) for j, v in enumerate(w)]) for i in range(3) for d in (-1e-3, 1e-3))
