"""Operators on small rows whose results are known, and a planted truth that a study must recover."""

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from signalpanel.operators import economics, metrics, panel, policy, quality
from signalpanel.plans import runs, study
from signalpanel.sources import fleet, world

DAY = date(2025, 1, 1)


def days(n):
    return [DAY + timedelta(i) for i in range(n)]


def test_grid_and_labels(spark):
    vehicles = spark.createDataFrame([("a", "x", 2020, "ice"), ("b", "x", 2021, "ev")], "vehicle_id string, oem string, model_year int, powertrain string")
    signals = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY + timedelta(9), 2.0), ("b", DAY + timedelta(3), 3.0)], "vehicle_id string, date date, s double")
    grid = panel.complete_grid(vehicles, signals, ["s", "absent"])
    assert grid.count() == 20 and grid.where("active").count() == 3 and grid.where("absent is not null").count() == 0
    events = spark.createDataFrame([("a", DAY + timedelta(5), "e"), ("a", DAY + timedelta(5), "e")], "vehicle_id string, date date, event_type string")
    got = {r.date: r.days_to_event for r in panel.next_event(grid, events).where("vehicle_id = 'a'").collect()}
    assert [got[d] for d in days(10)] == [5, 4, 3, 2, 1, None, None, None, None, None]
    same = {r.date: r.days_to_event for r in panel.next_event(grid, events, strict=False).where("vehicle_id = 'a'").collect()}
    assert same[DAY + timedelta(5)] == 0
    y = {r.date: r.y for r in panel.label_panel(grid.withColumn("active", F.lit(True)), events, 2).where("vehicle_id = 'a'").collect()}
    assert [y[d] for d in days(10)] == [0, 0, 0, 1, 1, 0, 0, 0, -1, -1]


def test_weighted_auc_against_pairs(spark):
    rows = [(i, float(i % 7), int(i % 3 == 0), 1.0 + i % 2) for i in range(60)]
    pos, neg = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    want = sum(p[3] * n[3] * (1 if p[1] > n[1] else 0.5 if p[1] == n[1] else 0) for p in pos for n in neg) / sum(p[3] for p in pos) / sum(n[3] for n in neg)
    df = spark.createDataFrame(rows, "row_id int, s double, y int, w double")
    assert metrics.weighted_auc(df, "s", "y", "w").first().auc == pytest.approx(want)
    assert metrics.weighted_auc(df.where("y = 1"), "s", "y").first().auc is None
    assert metrics.weighted_auc(df.limit(0), "s", "y").first().auc is None


def test_event_level(spark):
    rows = []
    for v, at in ((0, 10), (1, 20)):
        for i, d in enumerate(days(25)):
            ahead = at - i if i < at else None
            y = int(ahead is not None and ahead <= 7)
            rows.append((str(v), d, y, ahead, 0.9 if v == 0 and y else 0.1, f"{v}|{i:03d}"))
    df = spark.createDataFrame(rows, "vehicle_id string, date date, y int, days_to_event int, score double, row_id string")
    r = metrics.event_level(df, "score", 7, [7 / 50]).first()
    assert (r.events, r.caught, r.event_recall, r.median_lead, r.false_alerts) == (2, 1, 0.5, 7.0, 0.0)


def test_bootstrap_counts(spark):
    groups = spark.createDataFrame([(str(i),) for i in range(40)], "vehicle_id string")
    counts = metrics.resample_counts(groups, 10)
    assert {r.n for r in counts.groupBy("replicate").agg(F.sum("times").alias("n")).collect()} == {40}
    again = metrics.resample_counts(groups.repartition(7), 10)
    assert counts.exceptAll(again).count() == 0


def _long(spark, signals):
    rows = [("v" if len(vs) < 30 else "w", d, s, unit, "daily", "any", "ice", float(v)) for s, unit, vs in signals for d, v in vs]
    return spark.createDataFrame(rows, "vehicle_id string, date date, signal string, unit string, declared_frequency string, signal_powertrain string, powertrain string, value double")


def test_frozen_runs(spark):
    gap = [(d, 5.0) for d in days(10)] + [(d + timedelta(31), 5.0) for d in days(10)]
    long = _long(spark, [("stuck", "C", [(d, 37.2) for d in days(20)]), ("live", "C", [(d, 30 + i / 2) for i, d in enumerate(days(20))]), ("full", "pct", [(d, 100.0) for d in days(20)]), ("gap", "C", gap)])
    share = lambda n: {r.signal: r.frozen_share for r in quality.frozen_share(long, n).collect()}
    assert share(14) == {"stuck": 1.0, "live": 0.0, "full": 0.0, "gap": 0.0}
    assert share(8)["gap"] == 1.0


def test_implausible(spark):
    long = _long(spark, [("p", "pct", [(d, v) for d, v in zip(days(4), (50, 101, -1, 99))]), ("k", "kWh", [(DAY, -5), (DAY + timedelta(1), 3)]), ("i", "index", [(DAY, -9)])])
    assert {r.signal: r.implausible_share for r in quality.implausible_share(long).collect()} == {"p": 0.5, "k": 0.5, "i": 0.0}


def test_usable_precedence(spark):
    catalog = spark.createDataFrame([(s, "any") for s in "abc"] + [("d", "ev")], "signal_id string, powertrain string")
    flags = spark.createDataFrame([("a", "sparse"), ("b", "drift"), ("c", "sparse")], "signal string, flags string")
    leaks = spark.createDataFrame([("c", True)], "signal string, leaks boolean")
    got = {r.signal: r.reason for r in quality.usable_signals(catalog, flags, leaks, "ice").collect()}
    assert got == {"a": "sparse", "b": None, "c": "leakage", "d": "powertrain_ineligible"}


def test_verdict_and_steps(spark):
    good = {"fleet_share": 0.8, "auc_lift_lo": 0.15, "p_roi_positive": 0.9, "feasible_patterns": 1.0, "value_validated": 1.0, "roi_p5": 0.5, "history_months": 12.0}
    rows = policy.rules(spark)
    decide = lambda **x: study.decide(spark, rows, good | x)
    assert decide()["decision"] == "BUILD_READY"
    assert decide(fleet_share=0.6)["decision"] == "BUILD_READY" and decide(fleet_share=0.59)["failed"] == "data"
    assert decide(auc_lift_lo=0.0)["decision"] == "NOT_FEASIBLE" and decide(auc_lift_lo=None)["failed"] == "model"
    assert decide(value_validated=0.0) == {"decision": "PILOT", "failed": "", "raised": "value_unvalidated"}
    assert decide(cross_oem_gap=0.06)["raised"] == "cross_oem_variance"
    evidence = spark.createDataFrame(list((good | {"fleet_share": 0.62}).items()), "metric string, value double")
    assert {r["shift"]: r.decision for r in policy.sensitivity(rows, evidence).collect()} == {-1: "NOT_FEASIBLE", 0: "BUILD_READY", 1: "BUILD_READY"}


def test_pert_draws_do_not_depend_on_partitions(spark):
    cases = economics.scenarios(spark, [("a", economics.INPUTS, 1.0, 1.0), ("b", economics.INPUTS | {"recall": (0.5, 0.5, 0.5)}, 1.0, 1.0)])
    one = economics.drawn_pert(cases, 2500, 3)
    two = economics.drawn_pert(cases.repartition(5, "scenario"), 2500, 3)
    assert one.count() == 5000 and one.exceptAll(two.select(one.columns)).count() == 0
    assert one.where("scenario = 'b' AND recall <> 0.5").count() == 0
    m = one.where("scenario = 'a'").agg(F.avg("inspection").alias("m")).first().m
    assert m == pytest.approx((40 + 4 * 75 + 120) / 6, rel=0.02)


def test_ledger_appends_once(spark, tmp_path):
    rows = spark.createDataFrame([("r", n, "t", "{}", "d", 1, "{}") for n in ("a", "b")], "run_id string, name string, tool string, inputs string, dataset_hash string, seed long, outputs string")
    for _ in range(2):
        policy.append_evidence(rows, f"{tmp_path}/ledger")
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 2
    assert policy.canonical({"b": float("nan"), "a": [0.12345678, float("inf")]}) == '{"a":[0.123457,"inf"],"b":null}'


def test_warehouse_layouts(spark):
    vehicles = spark.createDataFrame([("a", "x", 2020, None), ("b", "x", 2020, "ev")], "VIN string, oem string, model_year int, powertrain string")
    long = spark.createDataFrame([("a", "2025-01-01", "s", 1.0), ("a", "2025-01-01", "s", 3.0), ("a", "2025-01-02", "t", 5.0), ("z", "2025-01-01", "s", 9.0)], "VIN string, day string, signal_id string, value double")
    tables = {"vehicles": vehicles, "signals_daily": long, "signal_catalog": spark.createDataFrame([("s", None)], "SIGNAL_ID string, POWERTRAIN string")}
    w = fleet.Warehouse(tables.__getitem__, fleet.Names(columns={"vehicle_id": "VIN", "date": "day"}, long_layout=True))
    got = {(r.vehicle_id, str(r.date)): (r.s, r.t) for r in w.signals(["s", "t"]).collect()}
    assert got == {("a", "2025-01-01"): (2.0, None), ("a", "2025-01-02"): (None, 5.0)}
    assert w.catalog().first().powertrain == "any"


def test_world_and_study_recover_the_truth(spark, tmp_path):
    w = world.World(vehicles=90, days=150, decoys=2, noise=2, hazard=0.2)
    world.write(spark, w, str(tmp_path))
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    vehicles, signals, events, catalog = (read(n) for n in ("vehicles", "signals_daily", "events", "signal_catalog"))
    assert quality.findings(vehicles, signals, events, "2030-01-01", ["pad_wear"]).where("level = 'error' AND count > 0").count() == 0
    some = catalog.where(F.col("signal_id").isin("pad_wear", "brake_temp", "noise_00", "service_flag"))
    result = study.run(vehicles, signals.drop("month"), events, some, study.Spec("brake", "brake", 7, replicates=20, draws=500), "fleet")
    dropped = result.ledger.items["usable"].outputs["dropped"]
    assert dropped.get("service_flag") == "leakage"
    assert {"pad_wear", "brake_temp"} & set(result.sufficient) and result.ledger.items["model"].outputs["point"] > 0.7
    assert result.decision in ("PILOT", "NOT_FEASIBLE")
    text = study.render(spark, result)
    assert result.ledger.items["verdict"].evidence_id in text
    assert result.ledger.frame(spark).count() == len(result.ledger.rows)
    assert {"learning_curve", "seed_stability", "redundancy", "baseline", "tornado", "operating_point", "runtime"} <= set(result.ledger.items)
    assert result.metrics["curve_gain"] is not None and result.metrics["seed_spread"] is not None and result.metrics["degradation_upper"] >= result.ledger.items["temporal"].outputs["degradation"] - 1e-9

    # what-if: economics anew, model evidence as it was, also from the stored run
    store = runs.Runs(spark, f"{tmp_path}/runs")
    store.say(result.run_id, capability="brake", kind="study", status="running")
    store.save(result)
    parent = store.load(result.run_id)
    assert parent.spec == result.spec and parent.metrics == pytest.approx(json.loads(policy.canonical(result.metrics)))
    assert study.whatif(spark, parent, min_coverage=1.01).decision == "NOT_FEASIBLE"
    rich = study.whatif(spark, parent, inputs={"usd_per_event": (9e6, 9e6, 9e6)}, delivery="streaming")
    old, new = (x.ledger.items for x in (parent, rich))
    assert new["roi"].outputs["p50"] > old["roi"].outputs["p50"] and new["cost"].outputs["marginal_total"] > old["cost"].outputs["marginal_total"]
    assert new["model"].evidence_id == old["model"].evidence_id and new["roi"].evidence_id != old["roi"].evidence_id
    store.save(rich, "whatif", parent.run_id)
    listed = store.listing().collect()
    assert [(r.run_id, r.kind, r.status, r.derived_from) for r in listed] == [(rich.run_id, "whatif", "done", result.run_id), (result.run_id, "study", "done", None)]
    assert set(store.evidence(rich.run_id)) == set(new) and "PILOT" in runs.summary(rich) or "NOT_FEASIBLE" in runs.summary(rich)
    with pytest.raises(KeyError):
        store.evidence("no such run")
    with pytest.raises(KeyError):
        study.whatif(spark, parent, nonsense=1)
    with pytest.raises(ValueError):
        study.replay(vehicles, signals, events, some, parent, "another fleet")
    again, diff = study.replay(vehicles, signals.drop("month").repartition(3), events, some, parent, "fleet")
    assert {r.status for r in diff.collect()} <= {"identical", "informational"} and again.decision == result.decision
    assert runs.datasets(str(tmp_path.parent)) and runs.datasets(str(tmp_path))[0] == str(tmp_path)
