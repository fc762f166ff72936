import hashlib
from collections import Counter

import pytest

from signalpanel.llm import substring

from .helpers import corpus, docs


def brute(rows, window):
    seen, texts = Counter(), [[] if t is None else t.encode().split() for _, t in rows]
    for words in texts:
        seen.update(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    out = []
    for (doc_id, _), words in zip(rows, texts):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        left = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(left).hexdigest()))
    return out


key = lambda r: (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("window", [35, 7])
def test_equals_brute_force(spark, window, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(substring.C, "CHUNK_BYTES", 4000)
    got = substring.dedup_digests(docs(spark, rows), window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, window), key=key)


def test_texts_and_empty_table(spark):
    rows = [(1, "x  " + "a b c d " * 20), (2, "keep\tthis  as it is"), (3, None)]
    df = docs(spark, rows)
    got = substring.dedup_texts(df, 8)
    assert got.schema == df.schema
    assert {r.doc_id: (r.text, r.n_chars, r.lang, r.keys) for r in got.collect()} == {1: ("x", 1, "en", "k"), 2: ("keep\tthis  as it is", 19, "en", "k"), 3: (None, None, "en", "k")}
    assert substring.dedup_digests(docs(spark, []), 8).count() == 0
