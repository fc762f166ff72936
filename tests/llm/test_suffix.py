import hashlib

import pytest

from signalpanel.llm import suffix

from .helpers import corpus, docs


def brute(rows, window):
    """Rows in the order of the table; nulls first, then by id."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - window + 1):
            w = data[i : i + window]
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


key = lambda r: (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("window,gram,limit", [(100, 64, 64), (100, 64, 1), (20, 8, 2), (12, 12, 64)])
def test_equals_brute_force(spark, window, gram, limit, monkeypatch):
    rows = corpus()
    hot = "one line that is in very many of all the documents here "
    rows += [(5000 + i, f"{i * 7919} {hot}{i * 104729}" + hot * (i % 3)) for i in range(60)]
    monkeypatch.setattr(suffix.C, "CHUNK_BYTES", 3000)
    got = [tuple(x) for x in suffix.dedup_digests(docs(spark, rows), window, gram, limit).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, window), key=key)


def test_texts_and_empty_table(spark):
    got = {r.doc_id: (bytes(r.kept), r.n_removed) for r in suffix.dedup_bytes(docs(spark, [(2, "xé" * 9), (1, "xé" * 9 + "y"), (3, None)]), 6, 3).collect()}
    assert got == {1: ("xéy".encode(), 24), 2: (b"", 27), 3: (b"", 0)}
    assert suffix.dedup_digests(docs(spark, [])).count() == 0


def test_windows_beyond_the_columns_are_refused():
    for window, gram in ((200, 64), (252, 252)):
        for dedup in (suffix.dedup_bytes, suffix.dedup_digests):
            with pytest.raises(ValueError):
                dedup(None, window, gram)
