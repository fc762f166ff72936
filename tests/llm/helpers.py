"""Fixtures for the operators: odd rows that every one of them must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk long, keys string, bucket long"


def docs(spark, rows):
    """Rows (doc_id, text) as a documents table with more columns, some of clashing names."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "k", 1) for i, t in rows], DOCS)


def corpus(seed=5, n=60, vocab=400):
    """Texts with passages that repeat, near copies, odd white space, nulls and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgéß") for _ in range(r.randrange(1, 7)))
    words = [word() for _ in range(vocab)]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [line(k) for k in (34, 35, 36, 60, 90)]
    rows = []
    for i in range(n):
        parts = [line(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            parts += [r.choice(passages), line(r.randrange(0, 20))]
        rows.append((i * 3, r.choice([" ", "\n", "  \t", "  ", "\r\n"]).join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(5)]
    rows += [(1010, rows[3][1].replace(" ", " x ", 1)), (1011, line(1) + " " + rows[8][1]), (1012, passages[4] + " " + passages[4]), (1013, "a " * 80), (1014, "a a")]
    rows += [(2000, None), (2001, ""), (2002, "   \n"), (2003, "word"), (2003, "word"), (None, rows[1][1]), (2004, line(3000))]
    return rows
