"""Queries over the second fleet (suppliers and their shipments) and the synthetic one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.functions.draws import uniform_sql
from signalpanel.operators import economics, panel, quality
from signalpanel.plans.panel_queries import rounded, rounded_sql
from signalpanel.sources import fleet, world

SECOND = """WITH vehicles AS (SELECT s_suppkey::VARCHAR AS vehicle_id, r_name AS oem, (2019 + s_nationkey % 7)::INT AS model_year, CASE WHEN s_suppkey % 5 = 0 THEN 'ev' ELSE 'ice' END AS powertrain
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
signals AS (SELECT l_suppkey::VARCHAR AS vehicle_id, l_shipdate::DATE AS date, sum(l_quantity) AS quantity, max(l_extendedprice) AS price, max(l_discount) AS discount FROM lineitem GROUP BY ALL),
targets AS (SELECT DISTINCT l_suppkey::VARCHAR AS vehicle_id, l_shipdate::DATE AS date FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)"""
QUERIES, SQL = {}, {}


def query(sql: str | None = None, columns: str = ""):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            SQL[fn.__name__] = rounded_sql(sql, columns)
        return fn

    return add


@query(SECOND + ", result AS (SELECT count(DISTINCT (vehicle_id, date)) AS reported, (max(date) - min(date) + 1) * (SELECT count(*) FROM vehicles) AS grid, count(DISTINCT (vehicle_id, date)) / ((max(date) - min(date) + 1) * (SELECT count(*) FROM vehicles)) AS share FROM signals)", "reported grid share~")
def supplier_grid_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fleet.SupplierFleet(spark, sf_dir)
    return quality.grid_completeness(f.vehicles(), f.signals())


@query(SECOND + """, s AS (SELECT (SELECT count(*) FROM targets WHERE vehicle_id IN (SELECT vehicle_id FROM vehicles)) AS events, (SELECT count(*) FROM vehicles) AS vehicles, max(date) - min(date) + 1 AS days FROM signals),
r AS (SELECT *, vehicles * days / 365.0::DOUBLE AS years FROM s), result AS (SELECT events, vehicles, days::INT AS days, years, events / years AS rate, greatest(0, events / years - 1.96::DOUBLE * sqrt(greatest(events, 1)) / years) AS lo,
events / years + 1.96::DOUBLE * sqrt(greatest(events, 1)) / years AS hi, events / years * 30 / 365.0::DOUBLE AS per_horizon FROM r)""", "events vehicles days years~ rate~ lo~ hi~ per_horizon~")
def supplier_event_rate(spark, sf_dir):
    f = fleet.SupplierFleet(spark, sf_dir)
    return quality.event_rate(f.vehicles(), f.signals(), f.events(), 30)


@query(SECOND + ", result AS (SELECT s.vehicle_id, s.date, (min(t.date) - s.date)::INT AS days_to_event FROM signals s LEFT JOIN targets t ON t.vehicle_id = s.vehicle_id AND t.date > s.date GROUP BY s.vehicle_id, s.date)", "vehicle_id date days_to_event")
def supplier_next_return(spark, sf_dir):
    f = fleet.SupplierFleet(spark, sf_dir)
    return panel.next_event(f.signals(), f.events()).select("vehicle_id", "date", "days_to_event")


@query(SECOND + ", result AS (SELECT vehicle_id, date, avg(quantity) OVER (PARTITION BY vehicle_id ORDER BY date ROWS 6 PRECEDING) AS m7 FROM signals)", "vehicle_id date m7~")
def supplier_trailing_reports(spark, sf_dir):
    """Trailing means over the last seven reports, not days: the same operator on an incomplete grid."""
    f = fleet.SupplierFleet(spark, sf_dir)
    return panel.trailing_features(f.signals(), ["quantity"]).select("vehicle_id", "date", F.col("quantity__m7").alias("m7"))


@query(f"""WITH result AS (SELECT 'V' || lpad(id::VARCHAR, 6, '0') AS vehicle_id, 'oem_' || floor(power({uniform_sql(7, "'oem'", 'id')}, 1.5::DOUBLE) * 10)::INT AS oem, (2019 + floor({uniform_sql(7, "'year'", 'id')} * 6))::INT AS model_year,
  CASE WHEN {uniform_sql(7, "'power'", 'id')} < 0.3::DOUBLE THEN 'ev' ELSE 'ice' END AS powertrain FROM (SELECT unnest(range(600)) AS id))""", "vehicle_id oem model_year powertrain")
def world_vehicles(spark, sf_dir):
    return world.vehicles(spark, world.World.profile("small")).select("vehicle_id", "oem", "model_year", "powertrain")


@query()
def world_days(spark, sf_dir):
    """Readings and events of a small synthetic fleet by vehicle."""
    _, signals, events = world.build(spark, world.World.profile("small"))
    n = events.groupBy("vehicle_id").agg(F.count("*").alias("events"))
    return signals.groupBy("vehicle_id").agg(F.count("*").alias("days"), F.sum(F.col("active").cast("int")).alias("active"), F.avg("pad_wear").alias("pad_wear")).join(n, "vehicle_id", "left")


@query("WITH result AS (SELECT unnest(" + str(economics.PLACEHOLDERS) + ") AS placeholder)", "placeholder")
def price_placeholders(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in economics.PLACEHOLDERS], "placeholder string")


@query("WITH result AS (SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', '{r[4] if r[0] != 'n_click' else 'any'}')" for r in fleet.CATALOG) + ") AS t(signal_id, powertrain))", "signal_id powertrain")
def catalog_scan(spark, sf_dir):
    """A catalog whose powertrain is missing for one signal, read through the warehouse adapter."""
    raw = fleet.DriverFleet(spark, sf_dir).catalog().withColumn("powertrain", F.when(F.col("signal_id") != "n_click", F.col("powertrain")))
    return fleet.Warehouse({"signal_catalog": raw}.__getitem__).catalog().select("signal_id", "powertrain")
