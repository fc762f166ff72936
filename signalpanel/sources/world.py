"""A synthetic fleet with a known truth: drivers, decoys, noise and a leak, events that follow from wear.

Vehicles are a range with hashed draws. A vehicle's days depend on its own past, so they are simulated by one vehicle's
group, seeded by its number alone: any partitioning gives the same fleet."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.functions.draws import uniform
from signalpanel.operators.panel import next_event

PROFILES = {"small": (600, 200), "default": (5_000, 540), "full": (10_000, 730)}


@dataclass(frozen=True)
class World:
    """Parameters; shares of a choice must add up to one."""

    vehicles: int = 600
    days: int = 200
    start: str = "2024-01-01"
    seed: int = 7
    groups: int = 10
    ev_share: float = 0.3
    wear_rate: float = 0.004
    hazard: float = 0.06
    service_lag: int = 12
    theft_rate: float = 0.03
    blackout_days: int = 7
    decoys: int = 13
    noise: int = 7
    missing: float = 0.05
    fade_rate: float = 0.0004
    battery_hazard: float = 0.05
    #: What a group never emits, and the first model year from which one does: {signal: {group: year, or null for never}}.
    coverage: dict = field(default_factory=dict)
    #: Shares of readings that get lost, by declared frequency.
    lost: dict = field(default_factory=lambda: {"realtime": 0.0, "daily": 0.0, "weekly": 0.0})
    #: Shares of the powertrains that are drawn; the first is the electric one.
    weights: dict | None = None

    @classmethod
    def profile(cls, name: str, **overrides) -> World:
        n, days = PROFILES[name]
        return cls(**{"vehicles": n, "days": days} | overrides)

    def __post_init__(self):
        if not 0 <= self.ev_share <= 1 or self.vehicles < 1 or self.days < 2:
            raise ValueError("shares lie in [0, 1]; a world has a vehicle and two days at least")
        if self.weights is not None and (set(self.weights) != {"ev", "ice"} or abs(sum(self.weights.values()) - 1) > 1e-9 or abs(self.weights["ev"] - self.ev_share) > 1e-9):
            raise ValueError("weights of ev and ice add up to one and agree with ev_share")
        known = {r[0] for r in registry(self)}
        if set(self.coverage) - known or set(self.lost) - {"realtime", "daily", "weekly"} or not all(0 <= x <= 1 for x in self.lost.values()):
            raise ValueError("coverage names signals, lost names frequencies and has shares")

    @classmethod
    def load(cls, text: str) -> World:
        """A world from JSON: `profile`, if it names one, and any fields; powertrain weights set the electric share."""
        given = json.loads(text)
        given |= {"ev_share": given["weights"]["ev"]} if given.get("weights") else {}
        name = given.pop("profile", None)
        return cls.profile(name, **given) if name else cls(**given)



def registry(world: World) -> list[tuple[str, str, str, str, str, str]]:
    """signal_id, category, unit, declared_frequency, powertrain, role of every signal."""
    rows = [("pad_wear", "health", "pct", "daily", "any", "driver"), ("brake_temp", "health", "C", "realtime", "any", "driver"), ("hard_stops", "driver_behavior", "count", "realtime", "any", "driver")]
    rows += [("miles", "location_trips", "mi", "daily", "any", "context"), ("odometer", "location_trips", "mi", "weekly", "any", "context"), ("soc", "fuel_energy", "pct", "daily", "ev", "context"), ("fuel", "fuel_energy", "gal", "daily", "ice", "context")]
    rows += [("battery_health", "health", "pct", "weekly", "ev", "battery"), ("cell_spread", "health", "ratio", "daily", "ev", "battery")]
    rows += [(f"decoy_{i:02d}", "health", "ratio" if i % 2 else "count", "daily", "any", "decoy") for i in range(world.decoys)]
    rows += [(f"noise_{i:02d}", "context", "ratio", ("realtime", "daily", "weekly")[i % 3], "any", "noise") for i in range(world.noise)]
    return rows + [("service_flag", "derived", "count", "daily", "any", "leakage")]


def catalog(spark: SparkSession, world: World) -> DataFrame:
    return spark.createDataFrame(registry(world), "signal_id string, category string, unit string, declared_frequency string, powertrain string, role string")


def vehicles(spark: SparkSession, world: World) -> DataFrame:
    u = lambda what: uniform(world.seed, F.lit(what), "id")
    pick = lambda what, *names: F.element_at(F.array(*map(F.lit, names)), (F.floor(u(what) * len(names)) + 1).cast("int"))
    group = F.floor(F.pow(u("oem"), 1.5) * world.groups).cast("int")  # some groups are larger
    return spark.range(world.vehicles).select(
        "id", F.concat(F.lit("V"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("vehicle_id"), F.concat(F.lit("oem_"), group.cast("string")).alias("oem"),
        (F.lit(2019) + F.floor(u("year") * 6)).cast("int").alias("model_year"), F.when(u("power") < world.ev_share, "ev").otherwise("ice").alias("powertrain"),
        pick("segment", "van", "truck", "car").alias("segment"), pick("climate", "cold", "mild", "hot").alias("climate"), pick("duty", "light", "medium", "heavy").alias("duty"),
    )


def _days(world: World):
    decoys = [f"decoy_{i:02d}" for i in range(world.decoys)]
    noise = [f"noise_{i:02d}" for i in range(world.noise)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.iloc[0]
        rng = np.random.default_rng([world.seed, int(v.id)])
        n = world.days
        date = pd.date_range(world.start, periods=n).date
        heavy = {"light": 0.7, "medium": 1.0, "heavy": 1.5}[v.duty]
        miles = rng.gamma(4, 12 * heavy, n) * (np.arange(n) % 7 < 5)
        wear, brake, theft, black, service = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool), -1
        level = rng.uniform(0, 0.8)
        for t in range(n):
            level += world.wear_rate * miles[t] / 45 * rng.lognormal(0, 0.2)
            if t == service:
                level = rng.uniform(0, 0.1)
            wear[t] = min(1.2, level)
            if service < t and rng.random() < world.hazard / (1 + np.exp(-18 * (level - 0.95))):
                brake[t], service = True, t + 1 + int(rng.integers(0, world.service_lag + 1))
            if rng.random() < world.theft_rate / 365:
                theft[t] = True
                black[t + 1 : t + 1 + world.blackout_days] = True
        seen = ~black & (rng.random(n) >= world.missing)
        out = {"vehicle_id": v.vehicle_id, "date": date, "active": seen, "pad_wear": np.clip(100 * wear + rng.normal(0, 4, n), 0, 100), "brake_temp": 60 + 80 * wear + rng.normal(0, 12, n), "hard_stops": rng.poisson(1 + 3 * heavy * wear).astype(float), "miles": miles, "odometer": np.cumsum(miles) + 1000.0}
        out["soc"] = np.where(v.powertrain == "ev", rng.uniform(20, 100, n), np.nan)
        out["fuel"] = np.where(v.powertrain == "ice", rng.uniform(2, 25, n), np.nan)
        shapes = (lambda x: x / 100, lambda x: np.floor(x / 10), lambda x: np.sqrt(x), lambda x: np.log1p(x))
        for i, name in enumerate(decoys):  # follow an observed driver, with noise of their own
            out[name] = shapes[i % 4](out["pad_wear"]) * rng.lognormal(0, 0.3 + 0.05 * i, n)
        for name in noise:
            out[name] = rng.random(n)
        # the battery fades with miles, faster in the heat; a worn one fails
        health, failed = np.full(n, np.nan), np.zeros(n, bool)
        if v.powertrain == "ev":
            heat, level = {"cold": 0.8, "mild": 1.0, "hot": 1.6}[v.climate], rng.uniform(0.72, 1.0)
            for t in range(n):
                level -= world.fade_rate * heat * miles[t] / 45 * rng.lognormal(0, 0.2)
                failed[t] = rng.random() < world.battery_hazard / (1 + np.exp(60 * (level - 0.7)))
                health[t] = level
                level = 1.0 if failed[t] else level  # a new one
        out["battery_health"] = np.clip(100 * health + rng.normal(0, 0.8, n), 0, 100)
        out["cell_spread"] = np.where(np.isnan(health), np.nan, np.clip(1.1 - health + rng.normal(0, 0.03, n), 0, 1))
        phase = int(rng.integers(0, 7))
        for name, _, _, often, _, role in registry(world):
            if name in out and role != "leakage":
                if often == "weekly":
                    out[name] = np.where(np.arange(n) % 7 == phase, out[name], np.nan)
                if world.lost.get(often):
                    out[name] = np.where(rng.random(n) < world.lost[often], np.nan, out[name])
        df = pd.DataFrame(out)
        df.loc[~seen, [c for c in df.columns if c not in ("vehicle_id", "date", "active")]] = np.nan
        df["_brake"], df["_theft"], df["_battery"] = brake, theft, failed
        return df

    signals = [r[0] for r in registry(world) if r[5] != "leakage"]
    return run, "vehicle_id string, date date, active boolean, " + ", ".join(f"{s} double" for s in signals) + ", _brake boolean, _theft boolean, _battery boolean"


def build(spark: SparkSession, world: World) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vehicles, signals_daily, events. `service_flag` is the leak: written back on the days before a brake event."""
    fleet = vehicles(spark, world)
    run, schema = _days(world)
    days = fleet.groupBy("vehicle_id").applyInPandas(run, schema)
    kinds = F.array(F.when(F.col("_brake"), "brake"), F.when(F.col("_theft"), "theft"), F.when(F.col("_battery"), "battery"))
    events = days.withColumn("event_type", F.explode(F.filter(kinds, lambda k: k.isNotNull()))).select("vehicle_id", "date", "event_type")
    near = next_event(days.drop("_brake", "_theft", "_battery"), events.where("event_type = 'brake'"), strict=False, out="_ahead")
    leak = F.when(F.col("active"), (F.coalesce(F.col("_ahead"), F.lit(999)) <= 5).cast("double"))
    signals = near.withColumn("service_flag", leak).drop("_ahead").join(fleet.select("vehicle_id", "oem", "model_year"), "vehicle_id")
    for name, groups in world.coverage.items():  # a when of a few groups, no join
        never = F.col("oem").isin(*(g for g, year in groups.items() if year is None))
        early = [(F.col("oem") == g) & (F.col("model_year") < year) for g, year in groups.items() if year is not None]
        for gone in (never, *early):
            signals = signals.withColumn(name, F.when(~gone, F.col(name)))
    return fleet.drop("id"), signals, events


def coverage_matrix(spark: SparkSession, world: World) -> DataFrame:
    """signal_id, oem, emits, from_year of every signal and group."""
    rows = []
    for name, *_ in registry(world):
        for g in (f"oem_{i}" for i in range(world.groups)):
            year = world.coverage.get(name, {}).get(g, 0)
            rows.append((name, g, year is not None, year or None))
    return spark.createDataFrame(rows, "signal_id string, oem string, emits boolean, from_year int")


def truth(world: World) -> dict:
    names = lambda role: [r[0] for r in registry(world) if r[5] == role]
    brake = {"drivers": names("driver"), "context": names("context"), "leakage": names("leakage")}
    return {"targets": {"brake": brake, "battery": {"drivers": names("battery"), "context": names("context"), "leakage": []}}, "coverage": world.coverage, "decoys": names("decoy"), "noise": names("noise")}


def write(spark: SparkSession, world: World, path: str) -> None:
    """The three tables and the catalog as Parquet (zstd; signals by month) and truth.json through Spark's own writers."""
    fleet, signals, events = build(spark, world)
    fleet.write.mode("overwrite").parquet(f"{path}/vehicles")
    signals.withColumn("month", F.date_format("date", "yyyy-MM")).repartition("month").write.mode("overwrite").option("compression", "zstd").partitionBy("month").parquet(f"{path}/signals_daily")
    events.write.mode("overwrite").parquet(f"{path}/events")
    catalog(spark, world).write.mode("overwrite").parquet(f"{path}/signal_catalog")
    coverage_matrix(spark, world).coalesce(1).write.mode("overwrite").parquet(f"{path}/coverage")
    for name, value in (("truth", truth(world)), ("params", asdict(world))):
        spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
