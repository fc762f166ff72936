"""A study from three tables to a cited verdict: contract, coverage, quality, leakage, model, robustness, economics, policy.

Every stage is a set of lazy frames; what it concludes, a few numbers, is recorded as evidence with an id."""

from __future__ import annotations

import json
import platform
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalpanel.functions.saved import saved
from signalpanel.operators import economics, metrics, panel, policy, quality, studies


@dataclass(frozen=True)
class Spec:
    """What is asked: target, horizon, population, delivery, limits and value ranges (low, base, high)."""

    capability: str
    target_event: str
    horizon_days: int = 7
    population: str = "any"
    delivery: str = "batch_daily"
    max_latency_s: float | None = None
    min_coverage: float = 0.6
    max_run_cost: float | None = None
    value_validated: bool = False
    inputs: dict = field(default_factory=lambda: dict(economics.INPUTS))
    seed: int = 42
    replicates: int = 300
    draws: int = 10_000

    def __post_init__(self):
        if not 1 <= self.horizon_days <= 90:
            raise ValueError("the horizon is 1 to 90 days")
        for name, (lo, base, hi) in self.inputs.items():
            if not lo <= base <= hi:
                raise ValueError(f"{name}: low <= base <= high")


@dataclass
class Evidence:
    evidence_id: str
    name: str
    outputs: dict


class Ledger:
    """Evidence of one run, in order; `frame` is its table."""

    def __init__(self, run_id: str, dataset_hash: str):
        self.run_id, self.dataset_hash, self.items = run_id, dataset_hash, {}
        self.rows: list[tuple] = []

    def record(self, spark, name: str, tool: str, inputs: dict, outputs: dict, seed: int) -> Evidence:
        row = (self.run_id, name, tool, policy.canonical(inputs), self.dataset_hash, seed, policy.canonical(outputs))
        schema = "run_id string, name string, tool string, inputs string, dataset_hash string, seed long, outputs string"
        eid = policy.with_evidence_id(spark.createDataFrame([row], schema)).first().evidence_id
        self.rows.append(row)
        self.items[name] = Evidence(eid, name, json.loads(row[-1]))
        return self.items[name]

    def frame(self, spark) -> DataFrame:
        schema = "run_id string, name string, tool string, inputs string, dataset_hash string, seed long, outputs string"
        return policy.with_evidence_id(spark.createDataFrame(self.rows, schema))


@dataclass
class Result:
    run_id: str
    spec: Spec
    decision: str
    failed: str
    raised: str
    ledger: Ledger
    metrics: dict
    sufficient: list[str]
    replans: list[str] = field(default_factory=list)


#: A chance of a positive return this near to its gate is borderline, and these ranges are then widened.
BORDERLINE, WIDER = 0.1, (0.5, 1.5)
CATALOG = "signal_id string, category string, unit string, declared_frequency string, powertrain string"


def run(vehicles: DataFrame, signals: DataFrame, events: DataFrame, catalog: DataFrame, spec: Spec, dataset_hash: str = "unnamed", progress=lambda stage: None) -> Result:
    spark = vehicles.sparkSession
    ledger = Ledger(uuid.uuid4().hex[:12], dataset_hash)
    note = lambda name, tool, inputs, outputs: ledger.record(spark, name, tool, inputs, outputs, spec.seed)
    one = lambda df: {k: v for k, v in df.first().asDict().items()}

    progress("define")
    vehicles = quality.population(vehicles, vehicles, spec.population).select("vehicle_id", "oem", "model_year", "powertrain")
    events = events.where(F.col("event_type") == spec.target_event).select("vehicle_id", F.to_date("date").alias("date"), "event_type").dropDuplicates()
    meta = quality.candidates(catalog, spec.population)
    ids = [r.signal_id for r in meta.select("signal_id").orderBy("signal_id").collect()]
    reporting = signals.where("active") if "active" in signals.columns else signals
    grid = saved(panel.complete_grid(vehicles, reporting.join(vehicles.select("vehicle_id"), "vehicle_id", "left_semi"), ids))

    progress("feasibility")
    long = quality.unpivot(grid, ids, meta)
    coverage, years = quality.coverage_by_oem(long), quality.from_model_year(long)
    flags = saved(quality.quality_flags(long))
    labeled = saved(panel.label_panel(grid, events, spec.horizon_days))
    leaks = saved(quality.leakage_verdict(quality.unpivot(labeled, ids)))
    use = {r.signal: r.reason for r in quality.usable_signals(meta, flags, leaks, spec.population).collect()}
    kept = sorted(s for s, reason in use.items() if reason is None)
    note("event_rate", "event_rate", {"target": spec.target_event}, one(quality.event_rate(vehicles, grid, events, spec.horizon_days)))
    note("quality", "quality", {"signals": ids}, {r.signal: r.flags for r in flags.collect()})
    note("leakage", "leakage", {"signals": ids}, {r.signal: r.reasons for r in leaks.where("leaks").collect()})
    note("usable", "usable", {"signals": ids}, {"kept": kept, "dropped": {s: r for s, r in use.items() if r}})
    note("runtime", "runtime", {}, runtime(spark))
    if not kept:
        raise ValueError("no signal is usable")

    progress("experiment")
    rows = panel.trailing_features(labeled, kept)
    features = [f"{s}{suffix}" for s in kept for suffix in ("", "__m7", "__m30", "__d30")]
    sampled = panel.class_sample(rows, seed=spec.seed).select("vehicle_id", "date", "oem", "y", "days_to_event", "weight", *features)
    sampled = saved(studies.with_folds(saved(sampled), seed=spec.seed))
    binned = saved(studies.binned(sampled.drop("weight", "days_to_event"), features))
    counts = saved(metrics.resample_counts(sampled, spec.replicates, spec.seed))
    cost = {r.signal_id: r.cost for r in economics.signal_marginal_cost(meta, spec.inputs["fleet"][1], spec.delivery).collect()}
    trace = studies.ablation(sampled, binned, kept, cost, counts)
    gone = {t["signal"] for t in trace if t["accepted"]}
    sufficient = [s for s in kept if s not in gone]
    note("ablation", "ablation", {"signals": kept}, {"trace": trace, "sufficient": sufficient})
    own = binned.where(studies.signal_of(F.col("feature")).isin(sufficient))
    scored = saved(studies.out_of_fold(own).join(sampled.select("vehicle_id", "date", "days_to_event", "weight"), ["vehicle_id", "date"]).withColumn("row_id", F.concat_ws("|", "vehicle_id", F.col("date").cast("string"))))
    auc = one(metrics.auc_interval(scored, "score", "y", counts, "weight"))
    best = studies.top_signals(studies.single_signal_auc(binned)).collect()
    solo = (best[0].auc if best else None) or 0.5
    note("baseline", "single_signal", {"signals": kept}, {"best": [r.asDict() for r in best]})
    note("redundancy", "redundancy", {"signals": kept}, redundancy(labeled, kept))
    note("model", "scorecard", {"signals": sufficient}, {**auc, "best_single": solo})
    points = metrics.event_level(scored, "score", spec.horizon_days, [0.005, 0.02, 0.1], "weight").collect()
    note("operating_points", "event_level", {"signals": sufficient}, {str(r.fraction): r.asDict() for r in points})

    progress("robustness")
    full = quality.full_set(vehicles, coverage, years, meta.where(F.col("signal_id").isin(sufficient)))
    share = full.agg(F.avg(F.col("full").cast("double")).alias("s")).first().s or 0.0
    note("coverage_set", "coverage", {"signals": sufficient}, {"share": share})
    per_group = studies.transfer_notes(studies.leave_one_group_out(own)).join(studies.missing_share(sampled, [f for f in features if f.split("__")[0] in sufficient]), "oem", "left")
    per_group = saved(per_group)
    groups = per_group.agg(F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("sd"), F.min("auc").alias("worst"), F.min_by("oem", "auc").alias("worst_group")).first()
    note("cross_group", "leave_one_out", {"signals": sufficient}, {**groups.asDict(), "groups": {r.oem: r.asDict() for r in per_group.collect()}})
    replans = []
    if groups.sd is not None and (groups.sd > THRESHOLD["cross_oem_std"] or groups.mean - groups.worst > THRESHOLD["cross_oem_gap"]):
        replans.append("cross_group_gap")
        lacks = coverage.where((F.col("oem") == groups.worst_group) & ~F.col("emits") & F.col("signal").isin(sufficient)).select("signal").collect()
        note("cross_group_gap", "coverage", {"group": groups.worst_group}, {"lacks": sorted(r.signal for r in lacks)})
    ahead = saved(studies.forward_scores(own, spec.horizon_days))
    forward = one(metrics.auc_interval(ahead, "score", "y", counts))
    degradation = None if forward["point"] is None or auc["point"] is None else auc["point"] - forward["point"]
    upper = None if forward["lo"] is None or auc["point"] is None else auc["point"] - forward["lo"]
    note("temporal", "temporal", {"signals": sufficient}, {"forward": forward, "windows": [r.asDict() for r in studies.temporal(own, spec.horizon_days).orderBy("window").collect()], "degradation": degradation, "degradation_upper": upper})
    chosen_features = [f for f in features if f.split("__")[0] in sufficient]
    plain = sampled.drop("weight", "days_to_event")
    curve = studies.learning_curve(plain, chosen_features, [0.25, 0.5, 0.75, 1.0])
    curve = saved(curve)
    gain = one(studies.curve_gain(curve))
    note("learning_curve", "learning_curve", {"signals": sufficient}, {**gain, "points": [r.asDict() for r in curve.orderBy("share").collect()]})
    seeds = [spec.seed, spec.seed + 1000, spec.seed + 2000]
    spread = one(studies.spread(studies.seed_stability(plain, chosen_features, seeds)))
    note("seed_stability", "seed_stability", {"signals": sufficient, "seeds": seeds}, spread)
    months = quality.history_months(long).agg(F.min("dataset_months").alias("m")).first().m
    note("signals", "catalog", {"signals": sufficient}, {"rows": [list(r) for r in meta.where(F.col("signal_id").isin(sufficient)).select(*[c.split()[0] for c in CATALOG.split(", ")]).orderBy("signal_id").collect()]})

    progress("economics")
    money, more = economics_stage(spark, spec, ledger, note)
    replans += more

    progress("policy")
    suspicious = leaks.where(F.col("suspicious") & F.col("signal").isin(sufficient)).count()
    values_of = {
        "fleet_share": share, "auc_lift_lo": None if auc["lo"] is None else auc["lo"] - solo, "cross_oem_std": groups.sd, "cross_oem_gap": None if groups.worst is None else groups.mean - groups.worst, "degradation_upper": upper, "curve_gain": gain["gain"], "seed_spread": spread["spread"],
        "value_validated": float(spec.value_validated), "history_months": months, "underpowered": float(any(t["underpowered"] for t in trace)), "suspicious_in_set": float(suspicious), **money,
    }
    outcome = decide(spark, rules_of(spark, spec), values_of)
    note("verdict", "policy", {"version": policy.VERSION}, {**outcome, "values": values_of})
    return Result(ledger.run_id, spec, outcome["decision"], outcome["failed"], outcome["raised"], ledger, values_of, sufficient, replans)


THRESHOLD = {metric: limit for _, _, metric, _, limit, _ in policy.RULES}


def rules_of(spark, spec: Spec) -> DataFrame:
    return policy.rules(spark, spec.max_run_cost).withColumn("threshold", F.when(F.col("rule") == "data", F.lit(spec.min_coverage)).otherwise(F.col("threshold")))


def runtime(spark) -> dict:
    """What arithmetic depends on: equal for two runs whose figures must be equal."""
    import numpy as np
    import pyarrow as pa

    return {"spark": spark.version, "numpy": np.__version__, "pyarrow": pa.__version__, "python": platform.python_version(), "ansi": spark.conf.get("spark.sql.ansi.enabled")}


def redundancy(labeled: DataFrame, signals: list[str], most: int = 50) -> dict:
    """The pairs of most equal ranks, and how many groups of signals are tied to each other by none."""
    if len(signals) < 2:
        return {"pairs": [], "independent_groups": len(signals)}
    pairs = saved(metrics.spearman_pairs(labeled, signals, ["vehicle_id", "date"]))
    groups = metrics.redundancy_groups(pairs, signals).select("group").distinct().count()
    top = [r.asDict() for r in pairs.orderBy(F.abs("rho").desc(), "a", "b").limit(most).collect()]
    return {"pairs": top, "independent_groups": groups}


def economics_stage(spark, spec: Spec, ledger: Ledger, note, draw=economics.drawn_pert) -> tuple[dict, list[str]]:
    """Cost, operating point, return, tornado and delivery from the evidence that is there: the figures the policy asks for, and
    what was widened because its first answer was borderline."""
    e = {name: item.outputs for name, item in ledger.items.items()}
    one = lambda df: df.first().asDict()
    signals = spark.createDataFrame([tuple(r) for r in e["signals"]["rows"]], CATALOG)
    price = one(economics.run_cost(signals, spec.inputs["fleet"][1], spec.delivery))
    note("cost", "run_cost", {"signals": [r[0] for r in e["signals"]["rows"]], "delivery": spec.delivery}, price)
    rate, points = e["event_rate"], e["operating_points"]
    inputs = spec.inputs | ({"event_rate": (rate["lo"], rate["rate"], max(rate["hi"], rate["rate"]))} if rate["rate"] else {})
    around = lambda r: (r * 0.8, r, min(1.0, r * 1.2))
    # without events to catch, the share of them that a ranking of this AUC would
    fallback = max(0.0, 2 * (e["model"]["point"] or 0.5) - 1)
    cases = [(name, inputs | {"recall": around(fallback if p["event_recall"] is None else p["event_recall"])}, price["marginal_total"], p["false_alerts"] or 0.0) for name, p in sorted(points.items())]
    cases = cases or [("none", inputs | {"recall": around(fallback)}, price["marginal_total"], 0.0)]
    value = lambda rows, n: economics.roi_summary(economics.value_terms(draw(economics.scenarios(spark, rows), n, spec.seed)))
    best = economics.operating_point(value(cases, max(1, spec.draws * 3 // 10))).first()
    case = next(c for c in cases if c[0] == best.scenario)
    note("operating_point", "simulation", {"draws": max(1, spec.draws * 3 // 10)}, best.asDict())
    roi = one(value([case], spec.draws))
    note("roi", "simulation", {"draws": spec.draws, "inputs": {k: list(x) for k, x in case[1].items()}}, roi)
    swings = economics.tornado(economics.roi_summary(economics.value_terms(draw(economics.tornado_cases(spark, case[1], case[2], case[3]), max(1, spec.draws // 5), spec.seed))))
    note("tornado", "simulation", {"draws": max(1, spec.draws // 5)}, {"order": [r.input for r in swings.orderBy("place").collect()]})
    replans = []
    if roi["p_positive"] is not None and abs(roi["p_positive"] - THRESHOLD["p_roi_positive"]) <= BORDERLINE:
        replans.append("roi_borderline")
        wide = {k: (inputs[k][0] * WIDER[0], inputs[k][1], min(inputs[k][2] * WIDER[1], 1.0 if k == "preventable" else float("inf"))) for k in ("usd_per_event", "preventable")}
        note("roi_wide", "simulation", {"draws": spec.draws, "widened": sorted(wide)}, one(value([(case[0], case[1] | wide, case[2], case[3])], spec.draws)))
    fit = economics.deployment_fit(spark, spec.horizon_days, spec.max_latency_s, spec.delivery).collect()
    note("delivery", "deployment", {"requested": spec.delivery}, {r.pattern: r.feasible for r in fit})
    return {"p_roi_positive": roi["p_positive"], "roi_p5": roi["p5"], "feasible_patterns": float(sum(r.feasible for r in fit)), "false_alerts_100": case[3], "placeholders": float(len(economics.PLACEHOLDERS)), "marginal_cost": price["marginal_total"]}, replans


def decide(spark, rule_rows: DataFrame, values: dict) -> dict:
    rows = [(k, float(v)) for k, v in values.items() if v is not None]
    evidence = spark.createDataFrame(rows, "metric string, value double")
    return policy.verdict(policy.judged(rule_rows, evidence)).first().asDict()


#: Evidence that a what-if makes anew; all other evidence is the parent's.
RECOMPUTED = ("cost", "operating_point", "roi", "roi_wide", "tornado", "delivery", "verdict")


def whatif(spark, result: Result, **changes) -> Result:
    """A run derived from a finished one: cost, return, operating point, delivery and verdict with other limits, inputs or
    delivery (fields of Spec), on the evidence of the model that is there. `inputs` may name some inputs only."""
    unknown = set(changes) - set(Spec.__dataclass_fields__)
    if unknown:
        raise KeyError(f"no such field: {sorted(unknown)}")
    if "inputs" in changes:
        changes["inputs"] = result.spec.inputs | changes["inputs"]
    spec = replace(result.spec, **changes)
    ledger = Ledger(uuid.uuid4().hex[:12], result.ledger.dataset_hash)
    ledger.items = {k: v for k, v in result.ledger.items.items() if k not in RECOMPUTED}
    note = lambda name, tool, inputs, outputs: ledger.record(spark, name, tool, inputs, outputs, spec.seed)
    money, replans = economics_stage(spark, spec, ledger, note)
    values = result.metrics | money | {"value_validated": float(spec.value_validated)}
    outcome = decide(spark, rules_of(spark, spec), values)
    note("verdict", "policy", {"version": policy.VERSION, "derived_from": result.run_id}, {**outcome, "values": values})
    return Result(ledger.run_id, spec, outcome["decision"], outcome["failed"], outcome["raised"], ledger, values, result.sufficient, replans)


def replay(vehicles: DataFrame, signals: DataFrame, events: DataFrame, catalog: DataFrame, result: Result, dataset_hash: str) -> tuple[Result, DataFrame]:
    """The study run again from its own spec, and the status of every piece of evidence; only for the data it was made from."""
    if dataset_hash != result.ledger.dataset_hash:
        raise ValueError(f"replay needs dataset {result.ledger.dataset_hash}, not {dataset_hash}")
    again = run(vehicles, signals, events, catalog, result.spec, dataset_hash)
    spark = vehicles.sparkSession
    side = lambda r: spark.createDataFrame([(k, policy.canonical(v.outputs)) for k, v in r.ledger.items.items()], "name string, outputs string")
    return again, policy.replay_diff(side(result), side(again), ("runtime",))


def brief(result: Result) -> list[str]:
    """Markdown lines; every line with a figure cites its evidence."""
    e, out = result.ledger.items, [f"# {result.spec.capability}", f"Policy version {policy.VERSION}"]
    say = lambda name, text: out.append(f"{text} ({e[name].evidence_id})")
    say("verdict", f"**{result.decision}**. Failed gates: {result.failed or 'none'}. Raised flags: {result.raised or 'none'}.")
    rate = e["event_rate"].outputs
    say("event_rate", f"{rate['events']} events, {rate['rate']} a vehicle-year [{rate['lo']}, {rate['hi']}].")
    say("model", f"AUC {e['model'].outputs['point']} [{e['model'].outputs['lo']}, {e['model'].outputs['hi']}], best single signal {e['model'].outputs['best_single']}.")
    say("coverage_set", f"Share of vehicles with every signal of the set: {e['coverage_set'].outputs['share']}.")
    say("ablation", f"{len(result.sufficient)} signals suffice: {', '.join(result.sufficient)}.")
    say("cost", f"Run cost {e['cost'].outputs['marginal_total']} a month.")
    say("roi", f"Return: {json.dumps(e['roi'].outputs, sort_keys=True)}.")
    return out


def render(spark, result: Result, kind: str = "markdown") -> str:
    """The brief as markdown or JSON; a line with a figure and no evidence is an error."""
    lines = brief(result)
    bad = policy.uncited_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    if bad:
        raise ValueError(f"no evidence for: {bad[0].line}")
    if kind == "json":
        return json.dumps({"run_id": result.run_id, "decision": result.decision, "spec": asdict(result.spec), "lines": lines}, sort_keys=True)
    return "\n\n".join(lines) + "\n"
