"""Stored runs: an append-only log of what happened to each run, folded to its last state, and its evidence."""

from __future__ import annotations

import json
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.operators import policy
from signalpanel.plans import study

LOG = "run_id string, at double, capability string, kind string, status string, verdict string, dataset_hash string, derived_from string, spec string, metrics string, sufficient string, error string"


class Runs:
    """Runs in a folder: `log` and `evidence`, both only ever appended to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def say(self, run_id: str, **what) -> None:
        """One row of the log; fields not given stay as they were."""
        names = [c.split()[0] for c in LOG.split(", ")]
        row = {"run_id": run_id, "at": time.time()} | what
        self.spark.createDataFrame([tuple(row.get(c) for c in names)], LOG).write.mode("append").parquet(f"{self.path}/log")

    def save(self, result: study.Result, kind: str = "study", derived_from: str | None = None) -> None:
        """A finished run: evidence first, so that a run that is done has all of it."""
        ledger = result.ledger
        if ledger.rows:
            policy.append_evidence(ledger.frame(self.spark).select("run_id", "name", "tool", "inputs", "dataset_hash", "seed", "outputs"), f"{self.path}/evidence")
        cited = sorted((k, v.evidence_id) for k, v in ledger.items.items())
        self.say(result.run_id, capability=result.spec.capability, kind=kind, status="done", verdict=result.decision, dataset_hash=ledger.dataset_hash, derived_from=derived_from, spec=json.dumps(asdict(result.spec), sort_keys=True), metrics=policy.canonical(result.metrics | {"cited": cited}), sufficient=json.dumps(result.sufficient))

    def state(self) -> DataFrame:
        """Each run's last state, with when it was first and last heard of."""
        log = self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
        names = [c.split()[0] for c in LOG.split(", ")][2:]
        return log.groupBy("run_id").agg(F.min("at").alias("created_at"), F.max("at").alias("changed_at"), *map(last, names))

    def listing(self, limit: int = 50) -> DataFrame:
        return newest(self.state(), limit)

    def evidence(self, run_id: str) -> dict[str, study.Evidence]:
        """The run's own evidence by name, and of a derived run its parent's that it has none of; an unknown run is an error."""
        run = self.state().where(F.col("run_id") == run_id).first()
        if run is None:
            raise KeyError(run_id)
        rows = self.spark.read.parquet(f"{self.path}/evidence").where(F.col("run_id") == run_id).select("evidence_id", "name", "outputs").collect()
        own = {r.name: study.Evidence(r.evidence_id, r.name, json.loads(r.outputs)) for r in rows}
        parent = self.evidence(run.derived_from) if run.derived_from and run.kind == "whatif" else {}
        return {k: v for k, v in parent.items() if k not in study.RECOMPUTED} | own

    def load(self, run_id: str) -> study.Result:
        """A finished run, for a what-if or a replay."""
        evidence = self.evidence(run_id)
        run = self.state().where(F.col("run_id") == run_id).first()
        if run.status != "done":
            raise KeyError(f"run {run_id} is not finished")
        spec = json.loads(run.spec)
        spec["inputs"] = {k: tuple(v) for k, v in spec["inputs"].items()}
        ledger = study.Ledger(run_id, run.dataset_hash)
        ledger.items = evidence
        verdict = evidence["verdict"].outputs
        values = {k: v for k, v in json.loads(run.metrics).items() if k != "cited"}
        return study.Result(run_id, study.Spec(**spec), verdict["decision"], verdict["failed"], verdict["raised"], ledger, values, json.loads(run.sufficient))


def newest(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs first, ties by id."""
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(limit)


def summary(result: study.Result) -> str:
    """One line for a message: what was asked, the verdict, and why."""
    why = "; ".join(x for x in (f"failed gates: {result.failed}" if result.failed else "", f"flags: {result.raised}" if result.raised else "") if x)
    cited = result.ledger.items["verdict"].evidence_id
    return f"{result.spec.capability}: {result.decision}" + (f" ({why})" if why else "") + f", run {result.run_id} [{cited}]"


def datasets(path: str) -> list[str]:
    """Folders under a local path that hold a generated fleet (a `truth` table), the latest first."""
    from pathlib import Path

    found = [p.parent for p in Path(path).glob("*/truth*")] + [p.parent for p in Path(path).glob("truth*")]
    return [str(p) for p in sorted(set(found), key=lambda p: (p.stat().st_mtime, str(p)), reverse=True)]
