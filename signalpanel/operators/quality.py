"""Coverage, data quality, drift and leakage of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalpanel.operators.metrics import average_rank, univariate_auc
from signalpanel.operators.panel import day_number

#: Plausible range of each unit, and units whose readings stand still for days at most.
PLAUSIBLE = {
    "pct": (0, 100), "ratio": (0, 1), "kPa": (0, 1400), "V": (0, 30), "C": (-60, 150), "mph": (0, 200), "min": (0, 1440), "hour": (0, 24), "deg": (-180, 180), "g": (0, 3),
    "mi": (0, None), "hr": (0, None), "count": (0, None), "gal": (0, None), "mpg": (0, None), "kg": (0, None), "kWh": (0, None), "mm": (0, None), "nats": (0, None),
}
PERSISTENT = ("pct", "mi", "hr", "C", "kPa", "V", "gal", "mpg", "kg", "kWh", "mph", "min", "deg", "mm")
DECLARED_GAP = {"realtime": 1, "daily": 1, "weekly": 7}


def unpivot(panel: DataFrame, ids: list[str], catalog: DataFrame | None = None) -> DataFrame:
    """A row for each panel row and signal: its columns, signal, value; with the catalog's columns if given."""
    keys = [c for c in panel.columns if c not in ids]
    long = panel.select(*keys, *(F.col(i).cast("double").alias(i) for i in ids)).unpivot(keys, ids, "signal", "value")
    if catalog is None:
        return long
    meta = catalog.select(F.col("signal_id").alias("signal"), "unit", "declared_frequency", F.col("powertrain").alias("signal_powertrain"))
    return long.join(F.broadcast(meta), "signal")  # one row a signal


def eligible() -> Column:
    return (F.col("signal_powertrain") == "any") | (F.col("signal_powertrain") == F.col("powertrain"))


def coverage_by_oem(long: DataFrame, least: float = 0.2) -> DataFrame:
    """signal, oem: eligible vehicles, those with any reading, share of rows that have one, and whether the group emits it."""
    per = long.where(eligible()).groupBy("signal", "oem", "vehicle_id").agg(F.max(F.col("value").isNotNull().cast("int")).alias("has"), F.count("value").alias("filled"), F.count("*").alias("rows"))
    out = per.groupBy("signal", "oem").agg(F.count("*").alias("vehicles"), F.sum("has").cast("long").alias("covered"), (F.sum("filled") / F.sum("rows")).alias("row_rate"))
    return out.withColumn("emits", F.col("covered") / F.col("vehicles") >= least)


def from_model_year(long: DataFrame, least: float = 0.5) -> DataFrame:
    """signal, oem, from_year: the first model year of which at least that share of eligible vehicles is covered."""
    per = long.where(eligible()).groupBy("signal", "oem", "model_year", "vehicle_id").agg(F.max(F.col("value").isNotNull().cast("int")).alias("has"))
    years = per.groupBy("signal", "oem", "model_year").agg(F.avg("has").alias("share"))
    return years.groupBy("signal", "oem").agg(F.min(F.when(F.col("share") >= least, F.col("model_year"))).alias("from_year"))


def full_set(vehicles: DataFrame, coverage: DataFrame, years: DataFrame, catalog: DataFrame) -> DataFrame:
    """vehicle_id, oem, full: whether the vehicle has every signal of the set: it is not eligible, or its group emits the
    signal and its model year is late enough. The catalog, a row a signal, is broadcast."""
    meta = catalog.select(F.col("signal_id").alias("signal"), F.col("powertrain").alias("signal_powertrain"))
    rows = vehicles.crossJoin(F.broadcast(meta))
    rows = rows.join(coverage.select("signal", "oem", "emits"), ["signal", "oem"], "left").join(years, ["signal", "oem"], "left")
    ok = ~eligible() | (F.coalesce("emits", F.lit(False)) & F.coalesce(F.col("model_year") >= F.col("from_year"), F.lit(False)))
    return rows.groupBy("vehicle_id", "oem").agg(F.bool_and(ok).alias("full"))


def event_rate(vehicles: DataFrame, panel: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """Events, vehicle-years, rate a vehicle-year with its normal interval, and rate a vehicle and horizon. All vehicles given
    count, also those that the panel is silent about."""
    span = panel.agg((F.datediff(F.max("date"), F.min("date")) + 1).alias("days")).crossJoin(vehicles.agg(F.count("*").alias("vehicles")))
    n = events.join(vehicles.select("vehicle_id"), "vehicle_id", "left_semi").agg(F.count("*").alias("events"))
    years, half = F.col("vehicles") * F.col("days") / 365.0, F.lit(1.96) * F.sqrt(F.greatest(F.col("events"), F.lit(1))) / F.col("years")
    out = n.crossJoin(F.broadcast(span)).withColumn("years", years).withColumn("rate", F.col("events") / F.col("years"))
    return out.select("events", "vehicles", "days", "years", "rate", F.greatest(F.lit(0.0), F.col("rate") - half).alias("lo"), (F.col("rate") + half).alias("hi"), (F.col("rate") * horizon / 365.0).alias("per_horizon"))


def nonnull_rate(long: DataFrame) -> DataFrame:
    return long.groupBy("signal").agg((F.count("value") / F.count("*")).alias("nonnull_rate"))


def median_gap(long: DataFrame) -> DataFrame:
    """signal, median_gap: days between one reading of a vehicle and its next."""
    w = Window.partitionBy("signal", "vehicle_id").orderBy("date")
    gaps = long.where("value IS NOT NULL").withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    return gaps.groupBy("signal").agg(F.percentile("gap", 0.5).alias("median_gap"))


def psi_drift(long: DataFrame, bins: int = 10, least_rows: int = 200, least_first: int = 50) -> DataFrame:
    """signal, psi between the first and the last quarter of its readings in order of date and vehicle; bins are quantiles of
    the first, and a reading equal to an edge is above it. 0 where there are few readings or a quarter is small or does not vary."""
    w = Window.partitionBy("signal").orderBy("date", "vehicle_id")
    rows = long.where("value IS NOT NULL").withColumns({"_at": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("signal"))})
    quarter = F.floor(F.col("_n") / 4)
    rows = rows.withColumn("part", F.when(F.col("_at") <= quarter, "first").when(F.col("_at") > F.col("_n") - quarter, "last")).where("part IS NOT NULL")
    first = rows.where("part = 'first'").groupBy("signal").agg(F.percentile("value", [i / bins for i in range(1, bins)]).alias("edges"), F.count("*").alias("n"), F.stddev_pop("value").alias("sd"), F.max("_n").alias("all"))
    # equal edges make one bin: a reading belongs to the bin after the last distinct edge that it reaches
    first = first.withColumn("edges", F.array_distinct("edges"))
    placed = rows.join(first, "signal").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("value"))))
    count = lambda p: F.sum((F.col("part") == p).cast("long"))
    per = placed.groupBy("signal", "bin").agg(count("first").alias("a"), count("last").alias("b"))
    every = first.select("signal", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"), "n", "sd", "all")
    share = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.col("n"), F.lit(1e-6))
    rows = every.join(per, ["signal", "bin"], "left").withColumns({"a": share("a"), "b": share("b")})
    psi = rows.groupBy("signal", "n", "sd", "all").agg(F.sum((F.col("b") - F.col("a")) * F.ln(F.col("b") / F.col("a"))).alias("psi"))
    return psi.select("signal", F.when((F.col("all") <= least_rows) | (F.col("n") < least_first) | (F.col("sd") == 0), 0.0).otherwise(F.col("psi")).alias("psi"))


def frozen_share(long: DataFrame, days: int = 14) -> DataFrame:
    """signal, frozen_share: vehicles with a run of equal readings on at least `days` consecutive days, of those with any
    reading. Runs at the unit's bound do not count; only units that persist, and not weekly signals."""
    at_bound = F.lit(False)
    for unit, (lo, hi) in PLAUSIBLE.items():
        inside = [F.col("value") == bound for bound in (lo, hi) if bound is not None]
        at_bound = F.when(F.col("unit") == unit, inside[0] | inside[1] if len(inside) > 1 else inside[0]).otherwise(at_bound)
    rows = long.where("value IS NOT NULL").where(F.col("unit").isin(*PERSISTENT) & (F.col("declared_frequency") != "weekly"))
    w = Window.partitionBy("signal", "vehicle_id").orderBy("date")
    stays = (F.lag("value").over(w) == F.col("value")) & (F.datediff("date", F.lag("date").over(w)) == 1)
    rows = rows.withColumn("_break", (~F.coalesce(stays, F.lit(False))).cast("int"))
    rows = rows.withColumn("island", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("signal", "vehicle_id", "island").agg(F.count("*").alias("run"), F.max(at_bound.cast("int")).alias("bound"))
    per = runs.groupBy("signal", "vehicle_id").agg(F.max(F.when(F.col("bound") == 0, F.col("run")).otherwise(0)).alias("longest"))
    return per.groupBy("signal").agg(F.avg((F.col("longest") >= days).cast("double")).alias("frozen_share"))


def implausible_share(long: DataFrame) -> DataFrame:
    """signal, implausible_share: readings outside their unit's range; units without one are not checked."""
    bad = F.lit(False)
    for unit, (lo, hi) in PLAUSIBLE.items():
        outside = (F.col("value") < lo) | (F.col("value") > hi) if hi is not None else F.col("value") < lo
        bad = F.when(F.col("unit") == unit, outside).otherwise(bad)
    return long.where("value IS NOT NULL").groupBy("signal").agg(F.avg(bad.cast("double")).alias("implausible_share"))


def history_months(long: DataFrame) -> DataFrame:
    """signal, its own months between first and last reading, and the data set's."""
    own = long.where("value IS NOT NULL").groupBy("signal").agg((F.datediff(F.max("date"), F.min("date")) / 30.44).alias("signal_months"))
    whole = long.agg((F.datediff(F.max("date"), F.min("date")) / 30.44).alias("dataset_months"))
    return own.crossJoin(F.broadcast(whole))


def quality_flags(long: DataFrame) -> DataFrame:
    """signal and its flags in alphabetic order, joined by commas: sparse, stale, drift, frozen, implausible."""
    meta = long.select("signal", "declared_frequency").distinct()
    out = meta
    for part in (nonnull_rate(long), median_gap(long), psi_drift(long), frozen_share(long), implausible_share(long)):
        out = out.join(part, "signal", "left")
    gap = F.when(F.col("declared_frequency") == "weekly", 7.0).otherwise(1.0)
    rules = {"drift": F.col("psi") > 0.2, "frozen": F.col("frozen_share") > 0.1, "implausible": F.col("implausible_share") > 0.01, "sparse": F.col("nonnull_rate") < 0.05, "stale": F.col("median_gap") > 1.5 * gap}
    return out.select("signal", F.concat_ws(",", *(F.when(rule, name) for name, rule in rules.items())).alias("flags"))


def usable_signals(catalog: DataFrame, flags: DataFrame, leaks: DataFrame, powertrain: str = "any") -> DataFrame:
    """signal, reason (null: keep): leakage before sparse before a powertrain that the population lacks."""
    rows = catalog.select(F.col("signal_id").alias("signal"), "powertrain").join(flags, "signal", "left").join(leaks.select("signal", "leaks"), "signal", "left")
    foreign = ~F.col("powertrain").isin("any", powertrain) if powertrain != "any" else F.lit(False)
    sparse = F.array_contains(F.split(F.coalesce("flags", F.lit("")), ","), "sparse")
    return rows.select("signal", F.when(F.coalesce("leaks", F.lit(False)), "leakage").when(sparse, "sparse").when(foreign, "powertrain_ineligible").alias("reason"))


def leakage_availability(long: DataFrame) -> DataFrame:
    """signal, share of positive and of negative rows that have a reading, and their ratio; long has y of known rows."""
    share = lambda y: F.avg(F.when(F.col("y") == y, F.col("value").isNotNull().cast("double")))
    return long.groupBy("signal").agg(share(1).alias("pos_avail"), share(0).alias("neg_avail")).withColumn("ratio", F.try_divide("pos_avail", "neg_avail"))


def leakage_spearman(long: DataFrame, least: int = 50) -> DataFrame:
    """signal, |rho| of the reading with the days to the event, over positive rows; more than `least` of them."""
    rows = long.where("y = 1 AND value IS NOT NULL").withColumns({"rv": average_rank("value", ("signal",)), "rd": average_rank("days_to_event", ("signal",))})
    return rows.groupBy("signal").agg(F.count("*").alias("n"), F.abs(F.corr("rv", "rd")).alias("rho")).where(F.col("n") > least).select("signal", "rho")


def leakage_flag_lift(long: DataFrame, least: int = 20) -> DataFrame:
    """signal, lift, recall of its values other than the most frequent one (of equally frequent ones the smallest) as a flag, of
    signals with 2 or 3 distinct values and more than `least` such rows. Rates are over all known rows, with a reading or not."""
    per = long.groupBy("signal", "value").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    read = F.col("value").isNotNull()
    mode = F.max(F.when(read, F.struct("n", (-F.col("value")).alias("v"), "y")))  # the greatest: most rows, then smallest value
    own = per.groupBy("signal").agg(F.count("value").alias("distinct"), mode.alias("mode"), F.sum(F.when(read, F.col("n"))).alias("read"), F.sum(F.when(read, F.col("y"))).alias("hits"), F.sum("n").alias("n"), F.sum("y").alias("pos"))
    own = own.where("distinct IN (2, 3)").withColumns({"active": F.col("read") - F.col("mode.n"), "hits": F.col("hits") - F.col("mode.y")})
    return own.where(F.col("active") > least).select("signal", F.try_divide(F.col("hits") / F.col("active"), F.col("pos") / F.col("n")).alias("lift"), F.try_divide("hits", "pos").alias("recall"))


def leakage_verdict(long: DataFrame, least_class: int = 20) -> DataFrame:
    """signal, reasons (joined by commas), leaks, suspicious. Without enough rows of either class nothing is said."""
    enough = long.where("y >= 0").groupBy("signal").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).where((F.col("p") >= least_class) & (F.col("n") >= least_class)).select("signal")
    known = long.where("y >= 0").join(F.broadcast(enough), "signal", "left_semi")
    out = enough
    for part in (leakage_availability(known), leakage_spearman(known), leakage_flag_lift(known), univariate_auc(known, 101)):
        out = out.join(part, "signal", "left")
    rules = {
        "auc": F.col("auc") >= 0.99, "availability": (F.col("ratio") >= 2.0) & (F.col("pos_avail") > 0.2),
        "flag": (F.col("lift") >= 15) & (F.col("recall") >= 0.25), "timing": F.col("rho") >= 0.9,
    }
    reasons = F.concat_ws(",", *(F.when(rule, name) for name, rule in rules.items()))
    out = out.withColumn("reasons", reasons).withColumn("leaks", F.col("reasons") != "")
    return out.select("signal", "reasons", "leaks", (~F.col("leaks") & F.coalesce(F.col("auc").between(0.95, 0.99), F.lit(False))).alias("suspicious"))


#: Required columns and the kinds that they may have.
REQUIRED = {
    "vehicles": {"vehicle_id": "text", "oem": "text", "model_year": "integer", "powertrain": "text"},
    "events": {"vehicle_id": "text", "date": "date", "event_type": "text"},
    "signals_daily": {"vehicle_id": "text", "date": "date"},
}
KINDS = {"text": ("string",), "integer": ("tinyint", "smallint", "int", "bigint"), "date": ("date", "timestamp", "timestamp_ntz")}
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")


def schema_findings(vehicles: DataFrame, signals: DataFrame, events: DataFrame, ids: list[str]) -> DataFrame:
    """rule, level, count, columns: required columns that are missing or of another kind, catalogued signals that are missing or
    not numeric. From the tables' types alone; nothing is read."""
    tables, rows = {"vehicles": vehicles, "events": events, "signals_daily": signals}, []
    for name, required in REQUIRED.items():
        have = dict(tables[name].dtypes)
        rows.append((f"{name}_missing_column", [c for c in required if c not in have]))
        rows.append((f"{name}_column_type", [c for c, kind in required.items() if c in have and have[c] not in KINDS[kind]]))
    have = dict(signals.dtypes)
    rows.append(("signals_absent", [i for i in ids if i not in have]))
    rows.append(("signals_not_numeric", [i for i in ids if i in have and have[i].split("(")[0] not in NUMERIC]))
    return vehicles.sparkSession.createDataFrame([(rule, "error", len(c), ",".join(sorted(c))) for rule, c in rows], "rule string, level string, count long, columns string")


def shape_findings(vehicles: DataFrame, signals: DataFrame, events: DataFrame, least_days: int = 180) -> DataFrame:
    """rule, level, count: a single group, vehicle-days missing from the grid, days short of a history that forward validation
    needs, events outside the signals' dates, and events of each type."""
    span = signals.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("days"))
    fleet = vehicles.agg(F.count_distinct("vehicle_id").alias("vehicles"), F.count_distinct("oem").alias("groups"))
    whole = span.crossJoin(F.broadcast(fleet))  # a row each
    positive = lambda c: F.greatest(c, F.lit(0)).cast("long")
    row = lambda rule, level, count: F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), count.cast("long").alias("count"))
    shape = whole.select(F.explode(F.array(
        row("vehicles_single_group", "warning", (F.col("groups") < 2).cast("long")),
        row("signals_grid_gaps", "warning", positive(F.col("vehicles") * F.coalesce("days", F.lit(0)) - F.col("n"))),
        row("signals_short_history", "warning", positive(F.lit(least_days) - F.coalesce("days", F.lit(0)))),
    )).alias("r")).select("r.*")
    outside = events.crossJoin(F.broadcast(span)).where((F.col("date") < F.col("first")) | (F.col("date") > F.col("last")))
    outside = outside.agg(F.count("*").alias("count")).select(F.lit("events_outside_dates").alias("rule"), F.lit("warning").alias("level"), "count")
    kinds = events.groupBy("event_type").agg(F.count("*").alias("count")).select(F.concat(F.lit("events_by_type:"), "event_type").alias("rule"), F.lit("info").alias("level"), "count")
    return shape.unionByName(outside).unionByName(kinds)


def findings(vehicles: DataFrame, signals: DataFrame, events: DataFrame, today: str, ids: list[str], inactive_ok: frozenset[str] = frozenset()) -> DataFrame:
    """rule, level, count: defects of the three tables against the contract, a row for each rule. Signals of `inactive_ok`, such
    as positions of a vehicle that is otherwise dark, may speak on inactive days."""
    ids = [i for i in ids if i not in inactive_ok]
    row = lambda df, rule, level: df.agg(F.count("*").alias("count")).select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), "count")
    twice = lambda df, *keys: df.groupBy(*keys).count().where("count > 1")
    own = vehicles.select("vehicle_id")
    parts = [
        row(twice(vehicles, "vehicle_id"), "vehicles_duplicate", "error"),
        row(vehicles.where("vehicle_id IS NULL OR oem IS NULL"), "vehicles_null", "error"),
        row(vehicles.where(~F.col("powertrain").isin("ice", "ev", "hybrid", "phev", "any")), "vehicles_powertrain", "error"),
        row(vehicles.where(~F.col("model_year").between(1990, 2035)), "vehicles_model_year", "warning"),
        row(twice(signals, "vehicle_id", "date"), "signals_duplicate", "error"),
        row(signals.join(own, "vehicle_id", "left_anti"), "signals_orphan", "error"),
        row(signals.where(F.col("date") > F.lit(today).cast("date")), "signals_future", "error"),
        row(twice(events, "vehicle_id", "date", "event_type"), "events_duplicate", "warning"),
        row(events.join(own, "vehicle_id", "left_anti"), "events_orphan", "error"),
        row(events.where(F.col("date") > F.lit(today).cast("date")), "events_future", "error"),
    ]
    if "active" in signals.columns and ids:
        speaks = F.greatest(*(F.coalesce((F.col(i) != 0).cast("int"), F.lit(0)) for i in ids), F.lit(0)) == 1
        parts.append(row(signals.where(~F.col("active") & speaks), "signals_inactive_value", "warning"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grid_completeness(vehicles: DataFrame, signals: DataFrame) -> DataFrame:
    """Reported vehicle-days, days that a complete grid has, and the share."""
    days = signals.agg(F.count_distinct("vehicle_id", "date").alias("reported"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("days"))
    n = vehicles.agg(F.count_distinct("vehicle_id").alias("vehicles"))
    return days.crossJoin(F.broadcast(n)).select("reported", (F.col("days") * F.col("vehicles")).alias("grid"), (F.col("reported") / (F.col("days") * F.col("vehicles"))).alias("share"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")]


def population(df: DataFrame, vehicles: DataFrame, powertrain: str) -> DataFrame:
    """Rows of vehicles with that powertrain; any: all."""
    return df if powertrain == "any" else df.join(vehicles.where(F.col("powertrain") == powertrain).select("vehicle_id"), "vehicle_id", "left_semi")


def candidates(catalog: DataFrame, scope: str) -> DataFrame:
    """Signals that a population of this scope can have: its own and those of any."""
    return catalog if scope == "any" else catalog.where(F.col("powertrain").isin("any", scope))


def span_days(df: DataFrame) -> DataFrame:
    return df.agg(F.min(day_number("date")).alias("first"), F.max(day_number("date")).alias("last"))
