import random

import pytest

from signalpanel.llm import jaccard

from .helpers import corpus, docs


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), ids.get(find(i))) for i, (doc_id, _) in enumerate(rows)]


def near_copies(seed, n):
    """Families of texts that differ by a few words, chains of them, and texts around the threshold."""
    r = random.Random(seed)
    rows, words = [], [f"W{i}" for i in range(300)]
    while len(rows) < n:
        base = [r.choice(words) for _ in range(r.randrange(3, 80))]
        for _ in range(r.randrange(1, 14)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 20)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((r.randrange(10**6), " ".join(copy)))
            if r.random() < 0.4:
                base = copy
    return rows


order = lambda x: tuple((v is None, v or 0) for v in x)


@pytest.mark.parametrize("limit,n", [(1000, 5), (4, 5), (4, 1)])
def test_equals_brute_force(spark, limit, n, monkeypatch):
    rows = corpus() + near_copies(3, 250)
    monkeypatch.setattr(jaccard.C, "CHUNK_BYTES", 4000)
    got = [tuple(x) for x in jaccard.near_duplicates(docs(spark, rows), n=n, limit=limit).collect()]
    assert sorted(got, key=order) == sorted(brute(rows, n, 75), key=order)


def test_tree_finds_every_component():
    r = random.Random(8)
    for _ in range(150):
        percent = r.choice([50, 75, 90])
        sets = [sorted(r.sample(range(14), r.randrange(1, 10))) for _ in range(25)]
        tree = jaccard.Tree(percent)
        for i, s in enumerate(sets):
            tree.parent[i] = i
            list(tree.links(i, s, len(s)))
            tree.insert(i, s, len(s))
        want = jaccard.Tree(percent)
        want.parent = dict(enumerate(range(25)))
        for i in range(25):
            for j in range(i):
                if 100 * len({*sets[i]} & {*sets[j]}) >= percent * len({*sets[i]} | {*sets[j]}):
                    want.link(i, j)
        assert [tree.find(i) for i in range(25)] == [want.find(i) for i in range(25)]


def test_empty(spark):
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows = corpus() + near_copies(4, 100)
    df = docs(spark, rows)
    got = jaccard.keep_one(df)
    assert got.schema == df.schema
    texts = {(i, t) for i, t in rows}
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= texts
    member = {}
    for (i, t), (_, size, c) in zip(rows, brute(rows, 5, 75)):
        member[(i, t)] = c if size else (i, t)
    assert sorted(map(str, {member[k] for k in kept})) == sorted(map(str, set(member.values())))
    assert len({member[k] for k in kept}) == len(kept)
