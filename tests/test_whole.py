"""Operators at the size of the whole job, against brute force on small rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from signalpanel.functions.draws import uniform
from signalpanel.operators import economics, metrics, panel, quality
from signalpanel.plans import catalog, study_queries
from signalpanel.sources import world


def test_class_sample_keeps_negatives_when_positives_exceed_the_size(spark):
    rows = spark.range(3000).selectExpr("cast(id as string) vehicle_id", "date'2025-01-01' date", "cast(id < 700 as int) y")
    got = {r.y: (r.n, r.w) for r in panel.class_sample(rows, 2, 600).groupBy("y").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert got[1] == (700, pytest.approx(700)) and got[0] == (1, pytest.approx(2300))
    whole = {r.y: (r.n, r.w) for r in panel.class_sample(rows).groupBy("y").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert whole == {1: (700, pytest.approx(700)), 0: (2300, pytest.approx(2300))}


def test_class_sample_takes_the_smallest_draws(spark):
    rows = spark.range(4000).selectExpr("cast(id as string) vehicle_id", "date'2025-01-01' date", "cast(id % 20 = 0 as int) y")
    got = {r.vehicle_id for r in panel.class_sample(rows, 2, 300).collect()}
    drawn = sorted((r.u, r.y, r.vehicle_id) for r in rows.withColumn("u", uniform(42, "vehicle_id", "date")).collect())
    want = {i for y, n in ((1, 200), (0, 100)) for i in [v for _, c, v in drawn if c == y][:n]}
    assert got == want and panel.class_sample(rows.limit(0)).count() == 0


SF = "/root/testdata/sf0.001"


def test_queries_draw_the_whole_numbers(spark, monkeypatch):
    seen = []
    real_counts, real_drawn = metrics.resample_counts, economics.drawn
    monkeypatch.setattr(metrics, "resample_counts", lambda rows, n, *a, **b: seen.append(n) or real_counts(rows, n, *a, **b))
    monkeypatch.setattr(economics, "drawn", lambda cases, n, *a, **b: seen.append(n) or real_drawn(cases, n, *a, **b))
    for name in ("bootstrap_auc_ci", "paired_delta_auc", "event_recall_ci", "roi_distribution", "tornado", "operating_point_choice"):
        catalog.QUERIES[name](spark, SF)
    assert seen == [300, 300, 300, 10_000, 2_000, 3_000]


def test_roi_of_all_draws_against_brute_force(spark):
    got = catalog.QUERIES["roi_distribution"](spark, SF).first()
    rows = economics.value_terms(economics.drawn(economics.scenarios(spark, study_queries.BASE_CASE), 10_000, study_queries.SEED)).collect()
    roi = np.array([r.roi for r in rows])
    assert len(roi) == 10_000
    assert [got.p5, got.p50, got.p95, got.p_positive] == pytest.approx([*np.quantile(roi, [0.05, 0.5, 0.95]), (roi > 0).mean()], abs=2e-6)


def test_world_days_cover_the_smallest_profile(spark):
    rows = catalog.QUERIES["world_days"](spark, SF).collect()
    assert len(rows) == 600 and max(r.days for r in rows) > 60


def test_bootstrap_equals_brute_force(spark):
    """All replicates of the sort-once bootstrap against one plain weighted AUC a replicate, with ties and rows of several ranges."""
    rng = np.random.default_rng(3)
    n = 3000
    rows = [(f"v{int(v)}", float(s), float(t), int(y), float(w)) for v, s, t, y, w in zip(rng.integers(0, 40, n), rng.integers(0, 300, n), rng.integers(0, 9, n), rng.random(n) < 0.2, rng.uniform(0.5, 2, n))]
    df = spark.createDataFrame(rows, "vehicle_id string, score double, other double, y int, w double")
    counts = metrics.resample_counts(df, 25)
    drawn = {}
    for r in counts.collect():
        drawn.setdefault(r.replicate, {})[r.vehicle_id] = r.times
    assert len(drawn) == 25 and all(sum(d.values()) == 40 for d in drawn.values())

    def auc(column, times):
        pos = [(r[column], r[4] * times.get(r[0], 0)) for r in rows if r[3]]
        neg = [(r[column], r[4] * times.get(r[0], 0)) for r in rows if not r[3]]
        a, wa = np.array(pos).T
        b, wb = np.array(neg).T
        return (((a[:, None] > b) + 0.5 * (a[:, None] == b)) * wa[:, None] * wb).sum() / (wa.sum() * wb.sum())

    got = {(r.replicate, r.name): r.auc for r in metrics.bootstrap_aucs(df, ["score", "other"], "y", counts, "w").collect()}
    assert got == {(k, name): pytest.approx(auc(c, d)) for k, d in drawn.items() for name, c in (("score", 1), ("other", 2))}
    every = {f"v{i}": 1 for i in range(40)}
    assert metrics.weighted_auc(df, "score", "y", "w").first().auc == pytest.approx(auc(1, every))


def test_flag_is_what_is_not_the_mode(spark):
    """A flag that is 1 on most days and 0 before an event; rates count rows without a reading."""
    rows = [("s", 0.0 if i < 30 else 1.0 if i < 900 else None, int(i < 24 or i >= 996)) for i in range(1000)]
    got = quality.leakage_flag_lift(spark.createDataFrame(rows, "signal string, value double, y int")).first()
    assert (got.lift, got.recall) == (pytest.approx(24 / 30 / (28 / 1000)), pytest.approx(24 / 28))


def test_silent_vehicles_count_in_the_rate(spark):
    vehicles = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "vehicle_id string")
    panel_rows = spark.sql("SELECT 'a' vehicle_id, date'2025-01-01' date UNION ALL SELECT 'a', date'2025-12-31'")
    events = spark.sql("SELECT 'a' vehicle_id, date'2025-02-01' date UNION ALL SELECT 'z', date'2025-02-01'")
    got = quality.event_rate(vehicles, panel_rows, events, 30).first()
    assert (got.events, got.vehicles, got.years, got.rate) == (1, 4, 4.0, 0.25)


def test_drift_of_ties_at_edges(spark):
    """Counts that tie at the edges, against numpy's histogram."""
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 6, 300), rng.integers(0, 8, 300)]).astype(float)
    rows = [(f"2025-{1 + i // 28:02d}-{1 + i % 28:02d}" if i < 336 else f"2026-{1 + (i - 336) // 28:02d}-{1 + (i - 336) % 28:02d}", "v", "s", float(x)) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "date string, vehicle_id string, signal string, value double").withColumn("date", F.to_date("date"))
    q = len(values) // 4
    a, b = values[:q], values[-q:]
    edges = np.quantile(a, np.linspace(0, 1, 11))
    edges[0], edges[-1] = -np.inf, np.inf
    pa, pb = (np.clip(np.histogram(x, edges)[0] / q, 1e-6, None) for x in (a, b))
    assert quality.psi_drift(df).first().psi == pytest.approx(((pb - pa) * np.log(pb / pa)).sum())
    assert quality.psi_drift(df.limit(150)).first().psi == 0.0


def test_coverage_weekly_readings_and_batteries(spark):
    """Groups without a signal, late model years, weekly readings, lost readings, and batteries that fail once they have faded."""
    w = world.World.load('{"vehicles": 60, "days": 90, "decoys": 1, "noise": 3, "groups": 3, "missing": 0.0, "weights": {"ev": 0.6, "ice": 0.4}, "fade_rate": 0.004, "battery_hazard": 0.5, "coverage": {"hard_stops": {"oem_0": null, "oem_1": 2022}}, "lost": {"realtime": 0.5}}')
    _, signals, events = world.build(spark, w)
    rows = signals.groupBy("oem", "model_year").agg(*(F.count(c).alias(c) for c in ("hard_stops", "brake_temp", "pad_wear", "odometer")), F.sum(F.col("active").cast("int")).alias("days")).collect()
    for r in rows:
        assert (r.hard_stops == 0) == (r.oem == "oem_0" or r.oem == "oem_1" and r.model_year < 2022)
        assert 0.4 < r.brake_temp / r.days < 0.6 and r.pad_wear == r.days and r.odometer < r.days / 5
    matrix = {(r.signal_id, r.oem): (r.emits, r.from_year) for r in world.coverage_matrix(spark, w).collect()}
    assert matrix["hard_stops", "oem_0"] == (False, None) and matrix["hard_stops", "oem_1"] == (True, 2022) and matrix["pad_wear", "oem_0"] == (True, None)
    near = events.where("event_type = 'battery'").join(signals, ["vehicle_id", "date"])
    assert near.count() > 10 and near.where("cell_spread is null").count() == 0
    assert near.agg(F.avg("cell_spread")).first()[0] > signals.agg(F.avg("cell_spread")).first()[0] + 0.05
    assert signals.where("fuel is not null and battery_health is not null").count() == 0
    for bad in ('{"weights": {"ev": 0.6, "ice": 0.6}}', '{"coverage": {"no_signal": {}}}', '{"lost": {"hourly": 0.1}}'):
        with pytest.raises(ValueError):
            world.World.load(bad)


def test_scorecard_rounds_as_its_sql(spark, monkeypatch):
    """Scores of nine decimals that end in 500, which decimal digits and a product round apart."""
    scores = [s * (k * 1000 + 500) / 1e9 for k in range(0, 3_000_000, 997) for s in (1, -1)]
    made = spark.createDataFrame([(str(i), "2024-01-01", 0, s) for i, s in enumerate(scores)], "vehicle_id string, date string, y int, score double")
    monkeypatch.setattr(study_queries.studies, "out_of_fold", lambda long: made)
    got = {int(r.vehicle_id): r.score for r in catalog.QUERIES["scorecard_oof"](spark, SF).collect()}
    want = duckdb.execute("SELECT i, round(unnest($1::DOUBLE[]), 6) FROM (SELECT 0 AS i)", [scores]).fetchall()
    assert [got[i] for i in range(len(scores))] == [r[1] for r in want]
