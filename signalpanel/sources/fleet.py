"""Sources: the canonical tables (vehicles, daily signals, events, catalog) behind one interface."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = "signal_id string, category string, unit string, declared_frequency string, powertrain string"
META = ("vehicle_id", "date", "oem", "model_year", "active")
#: Signals of the fleet view over the driver's tables.
CATALOG = [
    ("n_view", "driver_behavior", "count", "realtime", "any"),
    ("n_click", "driver_behavior", "count", "realtime", "any"),
    ("n_purchase", "fuel_energy", "count", "daily", "any"),
    ("n_signup", "context", "count", "weekly", "ev"),
    ("level_view", "health", "kPa", "daily", "any"),
    ("max_value", "health", "pct", "daily", "ice"),
]
SIGNALS = tuple(row[0] for row in CATALOG)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Names:
    """Renames, layout and limits of a warehouse's tables; what is not named keeps its default."""

    vehicles: str = "vehicles"
    signals: str = "signals_daily"
    events: str = "events"
    catalog: str = "signal_catalog"
    columns: dict[str, str] = field(default_factory=dict)
    long_layout: bool = False
    max_vehicles: int | None = None
    start: str | None = None
    end: str | None = None
    event_types: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, settings: dict) -> Names:
        return replace(cls(), **{k: v for k, v in settings.items() if v is not None})


class Warehouse:
    """Canonical frames from any reader `query(table) -> DataFrame`: a catalog, JDBC, or a folder of files."""

    def __init__(self, query: Callable[[str], DataFrame], names: Names = Names()):
        self.query, self.names = query, names

    def _read(self, name: str) -> DataFrame:
        back = {there: here for here, there in self.names.columns.items()}
        df = self.query(name)
        return df.select(*(F.col(f"`{c}`").alias(back.get(c, back.get(c.lower(), c.lower()))) for c in df.columns))

    def vehicles(self) -> DataFrame:
        out = self._read(self.names.vehicles).select("vehicle_id", "oem", "model_year", "powertrain")
        return sample_by_hash(out, "vehicle_id", self.names.max_vehicles) if self.names.max_vehicles else out

    def _dated(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("date", F.to_date("date"))
        return date_window(df, self.names.start, self.names.end)

    def events(self) -> DataFrame:
        """Events of known vehicles; types are renamed back to the engine's names."""
        back = {there: here for here, there in self.names.event_types.items()}
        df = self._dated(self._read(self.names.events)).select("vehicle_id", "date", "event_type")
        df = df.withColumn("event_type", remapped(F.col("event_type"), back))
        return df.join(self.vehicles().select("vehicle_id"), "vehicle_id", "left_semi")

    def catalog(self) -> DataFrame:
        df = self._read(self.names.catalog)
        return df.withColumn("powertrain", F.coalesce("powertrain", F.lit("any")))

    def signals(self, ids: list[str]) -> DataFrame:
        """Wide rows of the reporting days, with oem and model_year from the vehicles."""
        df = self._dated(self._read(self.names.signals))
        wide = pivot_long(df, ids) if self.names.long_layout else df.select("vehicle_id", "date", *(i for i in ids if i in df.columns))
        return wide.join(self.vehicles().select("vehicle_id", "oem", "model_year"), "vehicle_id")

    def date_range(self) -> DataFrame:
        return self._dated(self._read(self.names.signals)).agg(F.min("date").alias("first"), F.max("date").alias("last"))


def remapped(column: Column, names: dict[str, str]) -> Column:
    if not names:
        return column
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(known, column), column)


def date_window(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows from start to end, both included."""
    for bound, keep in ((start, lambda b: F.col("date") >= b), (end, lambda b: F.col("date") <= b)):
        df = df.where(keep(F.lit(bound).cast("date"))) if bound else df
    return df


def pivot_long(df: DataFrame, ids: list[str], name: str = "signal_id", value: str = "value") -> DataFrame:
    """(vehicle, day, signal, value) rows to one column a signal, the mean of repeated values."""
    return df.where(F.col(name).isin(ids)).groupBy("vehicle_id", "date").pivot(name, ids).agg(F.avg(value))


def sample_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows whose ids have the smallest first 8 hex digits of SHA-256, whatever the partitioning."""
    rank = F.conv(F.substring(F.sha2(F.col(key).cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return df.orderBy(rank, key).limit(n)


def raw_rollup(pings: DataFrame, counts: dict[str, str], levels: dict[str, str], maxima: dict[str, Column | None]) -> DataFrame:
    """Raw pings (vehicle_id, ts, kind, value, tie) to a day's row: numbers of pings by kind (0 where there is none), the
    last value of the day by kind, and the day's maxima (null where there is none). One aggregation, no join."""
    kind = F.col("kind")
    last = lambda k: F.max_by(F.when(kind == k, F.struct("value")), F.when(kind == k, F.struct("ts", "tie")))["value"]
    aggs = [F.sum(F.when(kind == k, 1).otherwise(0)).cast("long").alias(c) for c, k in counts.items()]
    aggs += [last(k).alias(c) for c, k in levels.items()]
    aggs += [F.max(F.col("value") if cond is None else F.when(cond, F.col("value"))).alias(c) for c, cond in maxima.items()]
    return pings.groupBy("vehicle_id", F.to_date("ts").alias("date")).agg(*aggs)


class DriverFleet:
    """The driver's tables as a fleet: customers are vehicles, their events daily signals, large errors the target."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def pings(self) -> DataFrame:
        e = table(self.spark, self.dir, "events")
        return e.select(F.col("user_id").cast("string").alias("vehicle_id"), "ts", F.col("event_type").alias("kind"), "value", F.col("event_id").alias("tie"))

    def vehicles(self) -> DataFrame:
        c, e = table(self.spark, self.dir, "customer"), table(self.spark, self.dir, "events")
        c = c.join(e.select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_semi")
        return c.select(
            F.col("c_custkey").cast("string").alias("vehicle_id"), F.col("c_mktsegment").alias("oem"), (F.lit(2019) + F.col("c_nationkey") % 7).cast("int").alias("model_year"),
            F.when(F.col("c_custkey") % 5 == 0, "ev").otherwise("ice").alias("powertrain"),
        )

    def signals(self) -> DataFrame:
        return raw_rollup(self.pings(), {"n_view": "view", "n_click": "click", "n_purchase": "purchase", "n_signup": "signup"}, {"level_view": "view"}, {"max_value": None})

    def events(self) -> DataFrame:
        """Days with an error of 100 or more, once each."""
        e = self.pings().where("kind = 'error' AND value >= 100")
        return e.select("vehicle_id", F.to_date("ts").alias("date"), F.lit("error").alias("event_type")).distinct()

    def catalog(self) -> DataFrame:
        return self.spark.createDataFrame(CATALOG, CATALOG_SCHEMA)


class SupplierFleet:
    """A second fleet with a long history: suppliers are vehicles, shipments their signals, large returns the target."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def _lines(self) -> DataFrame:
        line = table(self.spark, self.dir, "lineitem")
        return line.select(F.col("l_suppkey").cast("string").alias("vehicle_id"), F.to_date("l_shipdate").alias("date"), "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")

    def vehicles(self) -> DataFrame:
        s = table(self.spark, self.dir, "supplier").join(table(self.spark, self.dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        s = s.join(table(self.spark, self.dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return s.select(F.col("s_suppkey").cast("string").alias("vehicle_id"), F.col("r_name").alias("oem"), (F.lit(2019) + F.col("s_nationkey") % 7).cast("int").alias("model_year"), F.when(F.col("s_suppkey") % 5 == 0, "ev").otherwise("ice").alias("powertrain"))

    def signals(self) -> DataFrame:
        return self._lines().groupBy("vehicle_id", "date").agg(F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"))

    def events(self) -> DataFrame:
        e = self._lines().where("l_returnflag = 'R' AND l_quantity >= 45")
        return e.select("vehicle_id", "date", F.lit("return").alias("event_type")).distinct()
