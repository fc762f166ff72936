import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from signalpanel.llm import mixing

from .helpers import docs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens long, factor double, _draw int"


def table(spark):
    rows, r = [], random.Random(4)  # drawn apart, so that every cell has tokens and the targets can be met
    for i in range(1500):
        source = r.choice([None, "s1", "s1", "s1", "s2", "s3"])
        lang = r.choice(["en", "en", "fr"])
        text = r.choice(["word " * r.randrange(1, 40), "1 22 333 " * r.randrange(1, 9), "a | b | c |", "#!%& x", "", None])
        rows.append((i, text, lang, source, 1, 9, 1.5, 2))
    return spark.createDataFrame(rows + [(None, "no id", "en", "s1", 1, 9, 1.0, 1), (5, "again", None, "s2", 1, 9, 1.0, 1), (5, "again", None, "s2", 1, 9, 1.0, 1)], SCHEMA)


def test_margins_meet_targets(spark):
    rows = [r.asDict() for r in mixing.plan(table(spark), keep=0.02, rounds=40).collect()]
    total = sum(r["n_tokens"] for r in rows)
    for m in mixing.MARGINS:
        own, raked = defaultdict(float), defaultdict(float)
        for r in rows:
            own[r[m]] += r["n_tokens"] / total
            raked[r[m]] += r["n_tokens"] * r["weight"] / total
        target = {k: v ** mixing.POWERS[m] for k, v in own.items() if v}
        for k, v in target.items():
            assert raked[k] == pytest.approx(v / sum(target.values()), rel=2e-3)
    half = [r.asDict() for r in mixing.plan(table(spark), keep=0.5, rounds=40).collect()]
    kept, expected = (sum(r["n_tokens"] * r[k] for r in half) for k in ("kept", "probability"))
    assert abs(kept / expected - 1) < 0.15 and abs(expected / total - 0.5) < 0.1


def test_bound_rows_and_columns(spark):
    df = table(spark)
    got = mixing.plan(df, keep=0.9)
    assert got.count() == df.count() and got.where("probability > 1 or probability is null or kept is null").count() == 0
    sample = mixing.sample(df, keep=0.9)
    assert sample.columns == df.columns and sample.count() == got.where("kept").count()
    assert got.where("doc_id = 5").select("kept").distinct().count() <= 2
    assert mixing.plan(docs(spark, [])).count() == 0
    topics = {r.topic: r.n for r in got.groupBy("topic").agg(F.count("*").alias("n")).collect()}
    assert set(topics) == {"prose", "numeric", "tabular", "marked"}


def test_many_cells_are_raked_alike(spark):
    """The plan for more cells than one task takes, and very long texts."""
    df = table(spark).unionByName(spark.createDataFrame([(9000, "long " * 400_000, "en", "s1", 1, 9, 1.0, 1)], SCHEMA))
    rows = lambda got: sorted(map(str, got.collect()))
    assert rows(mixing.plan(df, keep=0.7)) == rows(mixing.plan(df, keep=0.7, task_cells=0))
    assert mixing.plan(df).where("doc_id = 9000").first().n_tokens == 400_000


def test_raking_ends_when_settled(spark):
    df = mixing.features(table(spark))
    a, b = (sorted((str(r[:4]), round(r.factor, 12)) for r in mixing.rake(cells, mixing.POWERS, 2.0, n).collect()) for n in (60, 400) for cells in [df.groupBy(*(F.col(f"__mix_{m}").alias(m) for m in mixing.MARGINS)).agg(F.sum("__mix_tokens").alias("tokens")).where("tokens > 0").coalesce(1)])
    assert a == b


def test_rounds_of_few_cells_take_no_shuffle_and_no_join(spark, monkeypatch):
    """The driver keeps a thread for each shuffle and broadcast of the last minute."""
    saved, rounds = mixing.saved, []

    def noted(df):
        if "before" in df.columns:
            rounds.append(df._jdf.queryExecution().executedPlan().toString())
        return saved(df)

    monkeypatch.setattr(mixing, "saved", noted)
    mixing.plan(table(spark), keep=0.7, rounds=3).count()
    assert rounds and not [p for p in rounds if "Exchange" in p or "Join" in p]
