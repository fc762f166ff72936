import base64
import random

import pytest
import tiktoken

import corpus_pipeline
from signalpanel.llm import mixing, queries, toxicity

from .helpers import corpus
from .test_jaccard import brute as components
from .test_jaccard import near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small documents table with copies, passages and toxic texts, and its labels."""
    at, r = str(tmp_path_factory.mktemp("sf")), random.Random(6)
    rows = [(i, t) for i, t in {i: t for i, t in corpus() + near_copies(2, 120) if i is not None}.items()]
    plain = [f"word{i}" for i in range(200)]
    for i in range(200):
        text = [r.choice(plain) for _ in range(r.randrange(30, 60))]
        if i % 4 == 0:
            for at_word in (3, 9, 20):
                text.insert(at_word, r.choice(["vilest", "vileness"]))
        rows.append((2_000_000 + i, " ".join(text)))
    frame = [(i, t, r.choice(["en", "fr"]), f"s{r.randrange(4)}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(frame, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(2_000_000 + i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def repeated(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for t, w in zip(texts, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else t)
    return out


def test_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.toxicity_model(spark, folder, docs)
    toxic = {r.doc_id for r in toxicity.score_documents(docs, model).where("predicted = 1").collect()}
    assert sum(i >= 2_000_000 and i % 4 == 0 for i in toxic) >= 45 and sum(i % 4 > 0 for i in toxic if i >= 2_000_000) <= 3
    rows = [r for r in docs.collect() if r.doc_id not in toxic]
    of = {i: (c, n) for i, n, c in components([(r.doc_id, r.text) for r in rows], 5, 75)}
    rows = [r for r in rows if not of[r.doc_id][1] or of[r.doc_id][0] == r.doc_id]
    texts = repeated([r.text for r in rows], 35)
    rows = [(r.doc_id, t, r.lang, r.source, len(t) if t != r.text else r.n_chars) for r, t in zip(rows, texts)]
    kept = {r.doc_id for r in mixing.plan(spark.createDataFrame(rows, COLUMNS), **corpus_pipeline.MIX).where("kept").collect()}

    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    codec = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (lang, source, n, codec.encode_ordinary(t or "")) for i, t, lang, source, n in rows if i in kept}
    got = {r.doc_id: (r.lang, r.source, r.n_chars, r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want and 0 < len(got) < len(of)


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema == docs.schema
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_odd_rows_and_clashing_columns(spark, folder):
    """Nulls in any column, an empty and a very long text, ties, repeated rows, and columns that stages use inside."""
    schema = COLUMNS + ", tokens long, factor double, chunk long, keys string, key long, grp long, ids string, n_tokens int, topic string"
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(9, "one two three four five six", "en", "s1", 27), (9, "one two three four five six", "en", "s1", 27), (8, None, None, None, None), (7, "", "en", "s1", 0), (None, "some words of no id at all", "fr", None, 26), (6, long, "fr", "s2", len(long))]
    docs = spark.createDataFrame([(*r, 1, 0.5, 3, "k", 4, 5, "i", 6, None) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        ids = [r.doc_id for r in got.select("doc_id").collect()]
        if name == "byte_bpe":
            assert sorted(got.columns) == sorted(set(docs.columns) - {"text"}) and len(ids) == 6
            continue
        assert got.schema == docs.schema
        if name != "mixing":  # which draws
            assert sorted(map(str, ids)) == sorted(map(str, [9, 8, 7, None, 6] + [9] * (name != "near_duplicates")))
    assert got.where("doc_id = 6").first().n_tokens > 300_000
