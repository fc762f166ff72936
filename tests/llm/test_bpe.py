import base64
import hashlib
import random

import pytest
import tiktoken

from signalpanel.llm import bpe

from .helpers import corpus, docs

p = pytest.importorskip("public_tokenizers")
PATH = p.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_tiktoken(reference):
    codec, r = bpe.Codec(PATH, p.PATTERN), random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "é", "ß", "1", "²", "'s", "'LL", "!", "😀", "中文", "\x00", "<|endoftext|>", "word", "Ünicode"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(3000)] + [t or "" for _, t in corpus()] + ["a" * 20_000, " " * 5000]
    for t in texts:
        assert codec.encode(t) == reference.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


def test_digests_and_odd_rows(spark, reference):
    rows = corpus()
    got = sorted(map(tuple, bpe.roundtrip_digests(docs(spark, rows), PATH, p.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.roundtrip_digests(docs(spark, []), PATH, p.PATTERN).count() == 0


def test_encode_and_decode_frames(spark):
    rows = [(1, "hello  world"), (2, None), (3, "")]
    ids = bpe.encode_documents(docs(spark, rows), PATH, p.PATTERN)
    back = {r.doc_id: bytes(r.data) for r in bpe.decode_documents(ids, PATH, p.PATTERN).collect()}
    assert back == {1: b"hello  world", 2: b"", 3: b""}
    df = docs(spark, rows)
    assert bpe.with_ids(df, PATH, p.PATTERN).columns == [*(c for c in df.columns if c != "text"), "n_tokens", "ids"]


def test_store_starts_anew(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE", 3)
    codec = bpe.Codec(PATH, p.PATTERN)
    for t in ("a b c d e f", "g h i a b", "c d e"):
        assert codec.encode(t) == reference.encode_ordinary(t)


def test_columns_of_the_same_names_are_replaced(spark):
    import public_tokenizers as p

    df = spark.createDataFrame([(1, "hello world", "old", 5), (2, None, None, None)], "doc_id long, text string, ids string, n_tokens int")
    got = bpe.with_ids(df, p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and [(r.doc_id, r.n_tokens, len(r.ids)) for r in got.orderBy("doc_id").collect()] == [(1, 2, 2), (2, 0, 0)]
