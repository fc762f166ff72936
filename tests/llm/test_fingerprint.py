import functools
import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from signalpanel.llm import fingerprint

from .helpers import corpus, docs


def sketch(text, k):
    chain = lambda values: functools.reduce(lambda seed, v: xxhash.xxh64_intdigest(v, seed), values, 42)
    h = [xxhash.xxh64_intdigest(w, 42).to_bytes(8, "little") for w in text.lower().encode().split()]
    found = {chain(h[i : i + 5]) for i in range(len(h) - 4)} if len(h) >= 5 else {chain(h)} if h else set()
    return sorted(x - (1 << 64) if x >> 63 else x for x in found)[:k]


def near(a, b, k):
    both = sorted({*a, *b})[:k]
    return len({*both} & {*a} & {*b}) / len(both) if both else 1.0


@pytest.mark.parametrize("k", [128, 8])
def test_equals_brute_force(spark, k):
    rows = corpus()
    got = fingerprint.edited_fingerprints(docs(spark, rows), k=k).collect()
    text = lambda t: t or ""
    hexed = lambda a: "".join(f"{x & (1 << 64) - 1:016x}" for x in a)
    line = sorted(((i is not None, i or 0, text(t), sketch(text(t), k)) for i, t in rows))
    want = []
    for at, (known, i, t, own) in enumerate(line):
        _, _, after, other = line[(at + 1) % len(line)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        new = sketch(edited, k)
        want.append((i if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(new), near(own, new, k), near(own, other, k)))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted((tuple(r)[:7] for r in got), key=order) == sorted(want, key=order)


def test_single_row_and_empty_table(spark):
    one = fingerprint.edited_fingerprints(docs(spark, [(4, "a b c d e f g")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c d" + b"a b c ").hexdigest()
    assert fingerprint.edited_fingerprints(docs(spark, [])).count() == 0


def test_merge_and_estimates(spark):
    words = [f"w{i}" for i in range(3000)]
    parts = [(1, " ".join(words[:2000])), (2, " ".join(words[1000:])), (3, " ".join(words))]
    df = fingerprint.with_fingerprint(docs(spark, parts), "text", "f")
    f = {r.doc_id: r.f for r in df.select("doc_id", "f").collect()}
    whole = fingerprint.merged_by(df.where("doc_id < 3"), "lang", "f", fan_in=2).first().f
    # the shingles across the cut are in the second part too, so the union is the whole text's set
    assert whole == f[3]
    pair = spark.createDataFrame([(f[1], f[2], f[3])], "a array<long>, b array<long>, c array<long>")
    r, c, n = pair.select(fingerprint.resemblance(F.col("a"), F.col("b")), fingerprint.containment(F.col("a"), F.col("c")), fingerprint.distinct_shingles(F.col("c"))).first()
    assert abs(r - 1 / 3) < 0.15 and c > 0.85 and abs(n / 2996 - 1) < 0.3


def test_columns_of_the_caller_stay(spark):
    rows = spark.createDataFrame([(i, f"a b c d e f {i}", i, f"h{i}") for i in range(9)], "doc_id long, text string, _k int, _h string")
    got = fingerprint.with_next(fingerprint.with_fingerprint(rows, "text", "own"), "doc_id", ["_h"], 3).orderBy("doc_id").collect()
    assert [(r._k, r._h, r.next__h) for r in got] == [(i, f"h{i}", f"h{(i + 1) % 9}") for i in range(9)]
