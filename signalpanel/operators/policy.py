"""Gates and flags as rows: thresholds, verdict, sensitivity; ledger, replay diff and portfolio."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = "1.4"
#: kind, rule, metric, which values are good (above or below the threshold; "at" ends count as good), threshold, step.
#: Fixed values. A gate without evidence fails; a flag without evidence is not raised.
RULES = [
    ("gate", "data", "fleet_share", ">=", 0.6, 0.05),
    ("gate", "model", "auc_lift_lo", ">", 0.0, 0.01),
    ("gate", "economics", "p_roi_positive", ">=", 0.5, 0.05),
    ("gate", "delivery", "feasible_patterns", ">=", 1.0, 0.0),
    ("flag", "cross_oem_variance", "cross_oem_std", "<=", 0.03, 0.01),
    ("flag", "cross_oem_variance", "cross_oem_gap", "<=", 0.05, 0.01),
    ("flag", "temporal_degradation", "degradation_upper", "<=", 0.03, 0.01),
    ("flag", "roi_spans_negative", "roi_p5", ">=", 0.0, 0.10),
    ("flag", "value_unvalidated", "value_validated", ">=", 1.0, 0.0),
    ("flag", "short_history", "history_months", ">=", 6.0, 1.0),
    ("flag", "ablation_underpowered", "underpowered", "<=", 0.0, 0.0),
    ("flag", "data_still_improving", "curve_gain", "<=", 0.01, 0.005),
    ("flag", "seed_sensitive", "seed_spread", "<=", 0.005, 0.0025),
    ("flag", "suspicious_signals", "suspicious_in_set", "<=", 0.0, 0.0),
    ("flag", "alert_burden", "false_alerts_100", "<=", 25.0, 5.0),
    ("flag", "cost_placeholders", "placeholders", "<=", 0.0, 0.0),
]
RULE_SCHEMA = "kind string, rule string, metric string, good string, threshold double, step double"


def rules(spark: SparkSession, max_cost: float | None = None) -> DataFrame:
    """The rules; with a ceiling on the run cost, a gate for it whose step is a tenth of the ceiling."""
    extra = [("gate", "cost", "marginal_cost", "<=", float(max_cost), 0.1 * max_cost)] if max_cost is not None else []
    return spark.createDataFrame(RULES + extra, RULE_SCHEMA)


def _good(value: Column, threshold: Column) -> Column:
    g = F.col("good")
    return F.when(g == ">=", value >= threshold).when(g == ">", value > threshold).otherwise(value <= threshold)


def judged(rule_rows: DataFrame, evidence: DataFrame, shift: float = 0.0) -> DataFrame:
    """Each rule with its value, whether it is good, and its margin in the good direction; evidence has metric, value.

    shift moves every threshold by as many steps in the capability's favour."""
    toward = F.when(F.col("good") == "<=", F.lit(1.0)).otherwise(F.lit(-1.0))
    rows = rule_rows.join(F.broadcast(evidence), "metric", "left").withColumn("threshold", F.col("threshold") + toward * F.col("step") * F.lit(shift))
    ok = F.coalesce(_good(F.col("value"), F.col("threshold")), F.col("kind") == "flag")
    margin = F.when(F.col("good") == "<=", F.col("threshold") - F.col("value")).otherwise(F.col("value") - F.col("threshold"))
    return rows.withColumns({"ok": ok, "margin": margin})


def verdict(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """NOT_FEASIBLE if a gate fails, else PILOT if a flag is up, else BUILD_READY; with the names of both."""
    bad = lambda kind: F.array_sort(F.collect_set(F.when((F.col("kind") == kind) & ~F.col("ok"), F.col("rule"))))
    out = rows.groupBy(*by).agg(bad("gate").alias("failed"), bad("flag").alias("raised"))
    decision = F.when(F.size("failed") > 0, "NOT_FEASIBLE").when(F.size("raised") > 0, "PILOT").otherwise("BUILD_READY")
    return out.select(*by, decision.alias("decision"), F.concat_ws(",", "failed").alias("failed"), F.concat_ws(",", "raised").alias("raised"))


def sensitivity(rule_rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """shift, decision: with every threshold one step against the capability, as it is, and one step in its favour."""
    parts = [judged(rule_rows, evidence, s).withColumn("shift", F.lit(int(s))) for s in (-1.0, 0.0, 1.0)]
    return verdict(parts[0].unionByName(parts[1]).unionByName(parts[2]), ("shift",)).select("shift", "decision")


def binding_gate(rows: DataFrame) -> DataFrame:
    """The passed gate with the smallest margin in its own steps."""
    passed = rows.where("kind = 'gate' AND ok AND step > 0").withColumn("steps", F.col("margin") / F.col("step"))
    return passed.agg(F.min_by(F.struct("rule", "steps"), F.struct("steps", "rule")).alias("b")).select("b.*")


# ---------------------------------------------------------------- ledger

LEDGER = "evidence_id string, run_id string, name string, tool string, inputs string, inputs_hash string, dataset_hash string, seed long, outputs string"


def canonical(value) -> str:
    """JSON with sorted keys and floats of six decimals; not-a-number is null, infinities are text."""

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else str(v) if math.isinf(v) else round(v, 6)
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple, set)) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"))


def with_evidence_id(records: DataFrame) -> DataFrame:
    """records (run_id, name, tool, inputs, dataset_hash, seed, outputs) with the hash of what went in and the id: equal
    inputs of equal name in a run are one piece of evidence."""
    text = F.concat_ws("|", "tool", "inputs", "dataset_hash", F.col("seed").cast("string"))
    rows = records.withColumn("inputs_hash", F.sha2(text.cast("binary"), 256))
    eid = F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", "run_id", "name", "tool", "inputs_hash").cast("binary"), 256), 1, 12))
    return rows.withColumn("evidence_id", eid)


def append_evidence(records: DataFrame, path: str) -> None:
    """Adds evidence that the ledger does not hold yet."""
    spark, new = records.sparkSession, with_evidence_id(records).dropDuplicates(["evidence_id"])
    try:
        new = new.join(spark.read.parquet(path).select("evidence_id"), "evidence_id", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").option("mergeSchema", "true").parquet(path)


def run_state(log: DataFrame) -> DataFrame:
    """run_id, capability, kind, status, verdict: each run's log of events folded to its last state."""
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at")))
    return log.groupBy("run_id").agg(*(last(c).alias(c) for c in ("capability", "kind", "status", "verdict")))


def replay_diff(original: DataFrame, replayed: DataFrame, informational: tuple[str, ...] = ()) -> DataFrame:
    """name, status of both runs' evidence by name: identical, differs, informational, or missing on a side."""
    a, b = original.select("name", F.col("outputs").alias("a")), replayed.select("name", F.col("outputs").alias("b"))
    status = F.when(F.col("b").isNull(), "missing_in_replay").when(F.col("a").isNull(), "missing_in_original").when(F.col("a") == F.col("b"), "identical")
    status = status.when(F.col("name").isin(*informational), "informational") if informational else status
    return a.join(b, "name", "full").select("name", status.otherwise("differs").alias("status"))


def latest_studies(runs: DataFrame) -> DataFrame:
    """Each capability's newest finished study."""
    w = Window.partitionBy("capability").orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    return runs.where("kind = 'study' AND status = 'done'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def required_signals(latest: DataFrame, sets: DataFrame) -> DataFrame:
    """signal_id, required_by (sorted, comma-joined), over capabilities that may go ahead; sets has run_id, signal_id."""
    rows = latest.where(F.col("verdict").isin("PILOT", "BUILD_READY")).join(sets, "run_id")
    return rows.groupBy("signal_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("capability"))).alias("required_by"))


def unused_signals(catalog: DataFrame, required: DataFrame) -> DataFrame:
    """category, number of its signals that no capability needs, and how many of them are realtime."""
    rest = catalog.join(required.select("signal_id"), "signal_id", "left_anti")
    return rest.groupBy("category").agg(F.count("*").alias("unused"), F.sum((F.col("declared_frequency") == "realtime").cast("long")).alias("unused_realtime"))


def portfolio_order(latest: DataFrame) -> DataFrame:
    """Studies by verdict, then by the chance of a positive return."""
    rank = F.when(F.col("verdict") == "BUILD_READY", 0).when(F.col("verdict") == "PILOT", 1).otherwise(2)
    w = Window.orderBy(rank, F.col("p_positive").desc(), "capability")
    return latest.withColumn("place", F.row_number().over(w))


def uncited_lines(lines: DataFrame) -> DataFrame:
    """Lines of a report that hold a digit, name no evidence id, and are not on the list of plain lines."""
    digit, cited = F.col("line").rlike(r"\d"), F.size(F.regexp_extract_all("line", F.lit(r"(ev_[0-9a-f]{12})"), 1)) > 0
    return lines.where(digit & ~cited & ~F.col("line").rlike(r"^(#|Policy version)"))


def cited_sentences(text: DataFrame, known: DataFrame) -> DataFrame:
    """place, sentence: sentences without digits, and those that cite evidence that exists."""
    rows = text.select("run_id", F.posexplode(F.split("narrative", r"(?<=[.!?])\s+")).alias("place", "sentence"))
    ids = known.groupBy("run_id").agg(F.collect_set("evidence_id").alias("known"))
    rows = rows.join(ids, "run_id", "left").withColumn("ids", F.regexp_extract_all("sentence", F.lit(r"(ev_[0-9a-f]{12})"), 1))
    ok = ~F.col("sentence").rlike(r"\d") | (F.size(F.array_intersect("ids", F.coalesce("known", F.array().cast("array<string>")))) > 0)
    return rows.where(ok).select("run_id", "place", "sentence")
