"""Run cost, value simulation, operating points and delivery patterns as frames."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalpanel.functions.draws import triangular, uniform

DAYS = 30.44
#: Unit prices and volumes.
PRICES = {
    "storage_tb": 23.0, "compression": 3.0, "credit": 3.0, "ingest_credits_gb": 0.0037, "job_credits_hour": 2.0, "cells_minute": 20e6, "bus_gb_in": 0.10, "bus_gb_out": 0.10,
    "bus_days": 7.0, "bus_storage_gb": 0.10, "vehicle_base": 1.99, "call_1k": 0.02, "record_bytes": 64.0, "raw_months": 13.0, "predictions_million": 0.05, "hour": 150.0, "amortized_months": 24.0,
}
SAMPLES = {"realtime": 180.0, "daily": 1.0, "weekly": 0.142857}
ADD_ON = {"location_trips": 0.75, "health": 1.0, "driver_behavior": 0.5, "fuel_energy": 0.5, "context": 0.0, "derived": 0.0}
BUILD_HOURS = {"batch_daily": 240.0, "batch_hourly": 320.0, "streaming": 480.0}
#: Pattern, seconds until a score is there, least horizon in days; the cheapest first.
PATTERNS = [("batch_daily", 86_400, 1), ("batch_hourly", 3_600, 0), ("streaming", 60, 0)]
#: What the prices above are without a public list price.
PLACEHOLDERS = ["engineering", "inference", "inspection", "job_throughput", "oem_data", "streaming_ingest", "telemetry"]


def lookup(column: Column, values: dict[str, float]) -> Column:
    return reduce(lambda c, kv: F.when(column == kv[0], F.lit(kv[1])).otherwise(c), values.items(), F.lit(0.0))


def signal_volumes(signals: DataFrame, fleet: float, prices: dict = PRICES) -> DataFrame:
    """signals with records and bytes a day of a fleet."""
    records = F.lit(fleet) * lookup(F.col("declared_frequency"), SAMPLES)
    return signals.withColumn("records_day", records).withColumn("bytes_day", records * prices["record_bytes"])


def run_cost(signals: DataFrame, fleet: float, mode: str, prices: dict = PRICES, owned: tuple[str, ...] = tuple(ADD_ON), by: tuple[str, ...] = (), build: bool = True) -> DataFrame:
    """Monthly cost lines of a set of signals (or of each set of a grouping), marginal and attributed."""
    p, v = prices, signal_volumes(signals, fleet, prices)
    package = F.collect_set("category")
    agg = v.groupBy(*by).agg(F.count("*").alias("n_signals"), F.sum("bytes_day").alias("bytes_day"), F.max(lookup(F.col("declared_frequency"), SAMPLES)).alias("calls_day"), package.alias("packages"))
    add = lambda c: F.aggregate(F.transform(c, lambda x: lookup(x, ADD_ON)), F.lit(0.0), lambda a, x: a + x)
    gb = F.col("bytes_day") * DAYS / 1e9
    cells = F.lit(fleet) * F.col("n_signals") * 4
    predictions = fleet * DAYS * (24 if mode == "batch_hourly" else 1)
    out = agg.withColumns({
        "gb_month": gb,
        "ingest": gb * p["ingest_credits_gb"] * p["credit"],
        "storage": (F.col("bytes_day") * DAYS * p["raw_months"] / p["compression"] / 1e12 + cells * 4 * DAYS * 3 / 1e12) * p["storage_tb"],
        "compute": cells / p["cells_minute"] / 60 * p["job_credits_hour"] * p["credit"] * DAYS,
        "bus": (gb * (p["bus_gb_in"] + p["bus_gb_out"]) + F.col("bytes_day") * p["bus_days"] / 1e9 * p["bus_storage_gb"]) * (1.0 if mode == "streaming" else 0.5),
        "inference": F.lit(predictions / 1e6 * p["predictions_million"]),
        "api_calls": F.lit(fleet) * F.col("calls_day") * DAYS / 1000 * p["call_1k"],
        "oem_attributed": F.lit(fleet) * (F.lit(p["vehicle_base"]) + add(F.col("packages"))),
        "oem_marginal": F.lit(fleet) * add(F.filter("packages", lambda x: ~x.isin(*owned)) if owned else F.col("packages")),
        "build_amortized": F.lit(BUILD_HOURS[mode] * p["hour"] / p["amortized_months"] if build else 0.0),
    }).drop("packages")
    out = out.withColumn("infra", F.col("ingest") + F.col("storage") + F.col("compute") + F.col("bus") + F.col("inference"))
    rest = F.col("infra") + F.col("api_calls") + F.col("build_amortized")
    return out.withColumns({"marginal_total": rest + F.col("oem_marginal"), "attributed_total": rest + F.col("oem_attributed")})


def cost_compare(a: DataFrame, b: DataFrame, lines: list[str]) -> DataFrame:
    """line, a, b, change in percent of a (null where a is zero)."""
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(x).alias("line"), F.col(x).cast("double").alias(name)) for x in lines))).alias("r")).select("r.*")
    return long(a, "a").join(long(b, "b"), "line").withColumn("change_pct", F.try_divide((F.col("b") - F.col("a")) * 100, "a"))


def signal_marginal_cost(signals: DataFrame, fleet: float, mode: str) -> DataFrame:
    """Cost a month of each signal alone, without the build: what removing it last would save."""
    return run_cost(signals, fleet, mode, by=("signal_id",), build=False).select("signal_id", F.col("marginal_total").alias("cost"))


def deployment_fit(spark: SparkSession, horizon: int, max_latency_s: float | None, requested: str) -> DataFrame:
    """pattern, latency_s, feasible, recommended: the requested pattern if feasible, else the cheapest feasible one."""
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PATTERNS)], "place int, pattern string, latency_s int, least_horizon int")
    ok = (F.lit(horizon) >= F.col("least_horizon")) & (F.lit(True) if max_latency_s is None else F.col("latency_s") <= max_latency_s)
    df = df.withColumn("feasible", ok)
    best = df.where("feasible").agg(F.min_by("pattern", F.when(F.col("pattern") == requested, -1).otherwise(F.col("place"))).alias("best"))
    return df.crossJoin(F.broadcast(best)).select("pattern", "latency_s", "feasible", F.coalesce(F.col("pattern") == F.col("best"), F.lit(False)).alias("recommended"))


#: (low, base, high) of each input; fixed values of the example study.
INPUTS = {
    "fleet": (15_000.0, 20_000.0, 25_000.0), "event_rate": (0.8, 1.0, 1.2), "value_bearing": (0.3, 0.5, 0.7), "preventable": (0.2, 0.4, 0.6),
    "usd_per_event": (300.0, 500.0, 900.0), "recall": (0.4, 0.5, 0.6), "inspection": (40.0, 75.0, 120.0),
}


def scenarios(spark: SparkSession, rows: list[tuple[str, dict[str, tuple[float, float, float]], float, float]]) -> DataFrame:
    """scenario, run_cost, false_100 (false alerts for 100 vehicle-months) and low, base, high of each input."""
    names = [f"{k}_{e}" for k in INPUTS for e in ("low", "base", "high")]
    data = [(name, float(cost), float(false), *(x for k in INPUTS for x in ranges[k])) for name, ranges, cost, false in rows]
    return spark.createDataFrame(data, ", ".join(["scenario string", "run_cost double", "false_100 double", *(f"{n} double" for n in names)]))


def drawn(cases: DataFrame, draws: int, seed: int) -> DataFrame:
    """A row for each scenario and draw, every input drawn from a triangular distribution by a hash of draw and input; all
    scenarios share their draws."""
    rows = cases.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return rows.withColumns({k: triangular(uniform(seed, "draw", F.lit(k)), *(F.col(f"{k}_{e}") for e in ("low", "base", "high"))) for k in INPUTS})


def drawn_pert(cases: DataFrame, draws: int, seed: int, block: int = 1000) -> DataFrame:
    """The same from PERT (scaled beta) distributions, which Spark has no draws of: numpy, seeded by block and input, so
    that the rows do not depend on partitions."""
    schema = ", ".join(["draw int", *(f"u_{k} double" for k in INPUTS), *(f"scenario string" for _ in [0])])
    keep = cases

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                n = min(block, draws - row.block * block)
                out = {"draw": np.arange(n, dtype=np.int32) + row.block * block}
                for i, k in enumerate(INPUTS):
                    lo, mode, hi = (getattr(row, f"{k}_{e}") for e in ("low", "base", "high"))
                    rng = np.random.default_rng([seed, row.block, i])
                    out[f"u_{k}"] = np.full(n, mode) if hi <= lo else lo + rng.beta(1 + 4 * (mode - lo) / (hi - lo), 1 + 4 * (hi - mode) / (hi - lo), n) * (hi - lo)
                yield pd.DataFrame(out | {"scenario": row.scenario})

    blocks = cases.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // block))))
    rows = blocks.mapInPandas(run, schema).join(F.broadcast(keep), "scenario")  # a row a scenario
    return rows.withColumnsRenamed({f"u_{k}": k for k in INPUTS})


def value_terms(rows: DataFrame, build_once: bool = True, build_month: float = 1500.0) -> DataFrame:
    """Events, detections, avoided value, false alerts and their cost, cost a year, net value and return of each draw.

    `run_cost` includes the amortised build; build_once=False adds it a second time, for comparison with older reports."""
    c = F.col
    detected = c("fleet") * c("event_rate") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("recall")))
    rows = rows.withColumns({"detected": detected, "false_alerts": c("fleet") * 12.0 * c("false_100") / 100.0})
    cost = (c("run_cost") + F.lit(0.0 if build_once else build_month)) * 12 * c("fleet") / c("fleet_base")
    rows = rows.withColumns({"avoided": c("detected") * c("value_bearing") * c("preventable") * c("usd_per_event"), "false_cost": c("false_alerts") * c("inspection"), "cost_year": cost})
    rows = rows.withColumn("net", c("avoided") - c("false_cost") - c("cost_year"))
    return rows.withColumn("roi", F.when(c("cost_year") > 0, c("net") / c("cost_year")))


def roi_summary(terms: DataFrame) -> DataFrame:
    """scenario, p5, p50, p95, mean and share above zero of the return; median net value."""
    q = F.percentile("roi", [0.05, 0.5, 0.95])
    return terms.groupBy("scenario").agg(q.alias("q"), F.avg("roi").alias("mean"), F.avg((F.col("roi") > 0).cast("double")).alias("p_positive"), F.percentile("net", 0.5).alias("net_p50")).select("scenario", *(F.col("q")[i].alias(n) for i, n in enumerate(("p5", "p50", "p95"))), "mean", "p_positive", "net_p50")


def tornado_cases(spark: SparkSession, inputs: dict, run_cost_month: float, false_100: float) -> DataFrame:
    """Each input pinned to its bad and its good end, the others as they are; the run cost doubled and halved."""
    rows = []
    for k, (lo, _, hi) in inputs.items():
        bad, good = (hi, lo) if k == "inspection" else (lo, hi)
        for side, x in (("bad", bad), ("good", good)):
            rows.append((f"{k}|{side}", inputs | {k: (x, x, x)} if k != "fleet" else inputs | {k: (x, x, x)}, run_cost_month, false_100))
    rows += [("run_cost|bad", inputs, run_cost_month * 2, false_100), ("run_cost|good", inputs, run_cost_month / 2, false_100)]
    return scenarios(spark, rows)


def tornado(summary: DataFrame) -> DataFrame:
    """input, median net value at the bad and the good end, swing, place by swing."""
    parts = F.split("scenario", r"\|")
    side = lambda s: F.max(F.when(parts[1] == s, F.col("net_p50")))
    out = summary.groupBy(parts[0].alias("input")).agg(side("bad").alias("bad"), side("good").alias("good")).withColumn("swing", F.abs(F.col("good") - F.col("bad")))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("swing").desc(), "input")))  # a row an input


def operating_point(summary: DataFrame) -> DataFrame:
    """The scenario with the highest median net value; ties go to the first name."""
    return summary.agg(F.min_by(F.struct("scenario", "net_p50", "p_positive"), F.struct(-F.col("net_p50"), "scenario")).alias("b")).select("b.*")
