"""Queries over the driver's tables for panel, quality and metric operators, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.functions.draws import uniform, uniform_sql
from signalpanel.operators import metrics, panel, quality
from signalpanel.sources import fleet

HORIZON = 3
IDS = list(fleet.SIGNALS)
SIX = 6


def rounded(df: DataFrame, digits: int = SIX) -> DataFrame:
    shown = {"double": lambda c: F.round(c, digits), "float": lambda c: F.round(c, digits), "date": lambda c: F.col(c).cast("string")}
    return df.select(*(shown.get(kind, F.col)(c).alias(c) for c, kind in df.dtypes))


def rounded_sql(sql: str, columns: str) -> str:
    """columns: the output, with doubles marked by a trailing ~; days are text, as in rounded()."""
    shown = lambda c: f"round({c[:-1]}, {SIX}) AS {c[:-1]}" if c.endswith("~") else "date::VARCHAR AS date" if c == "date" else c
    out = ", ".join(map(shown, columns.split()))
    return f"{sql} SELECT {out} FROM result"


class View:
    """The first fleet's frames, built once a query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        src = fleet.DriverFleet(spark, sf_dir)
        self.spark, self.dir = spark, sf_dir
        self.vehicles, self.signals, self.events, self.catalog = src.vehicles(), src.signals(), src.events(), src.catalog()
        self.pings = src.pings()

    @property
    def grid(self) -> DataFrame:
        return panel.complete_grid(self.vehicles, self.signals, IDS)

    @property
    def labeled(self) -> DataFrame:
        return panel.label_panel(self.grid, self.events, HORIZON)

    @property
    def known(self) -> DataFrame:
        """Known rows with a score that needs no model, a weight, and a row id."""
        rows = self.labeled.where("y >= 0")
        score = F.coalesce("max_value", F.lit(0.0)) + F.coalesce("n_view", F.lit(0)) * 3 + F.coalesce("n_click", F.lit(0)) * 2
        other = F.coalesce("level_view", F.lit(0.0))
        weight = F.when(F.col("y") == 1, 1.0).otherwise(1.5)
        return rows.withColumns({"score": F.round(score, 0).cast("double"), "other": F.round(other, 0).cast("double"), "weight": weight, "row_id": F.concat_ws("|", F.lpad("vehicle_id", 12, "0"), F.col("date").cast("string"))})

    @property
    def long(self) -> DataFrame:
        return quality.unpivot(self.grid, IDS, self.catalog)

    @property
    def long_labeled(self) -> DataFrame:
        """Labelled readings, with a planted leak: a flag that is up on most days before an event."""
        rows = self.labeled.withColumn("leak", F.when(F.col("active"), ((F.col("y") == 1) & (uniform(1, "vehicle_id", "date") < 0.9)).cast("double")))
        return quality.unpivot(rows, [*IDS, "leak"])


CATALOG_SQL = "SELECT * FROM (VALUES " + ", ".join(str(r) for r in fleet.CATALOG) + ") AS t(signal_id, category, unit, declared_frequency, powertrain)"
BASE = f"""WITH vehicles AS (SELECT c_custkey::VARCHAR AS vehicle_id, c_mktsegment AS oem, (2019 + c_nationkey % 7)::INT AS model_year,
    CASE WHEN c_custkey % 5 = 0 THEN 'ev' ELSE 'ice' END AS powertrain FROM customer WHERE c_custkey IN (SELECT user_id FROM events)),
pings AS (SELECT user_id::VARCHAR AS vehicle_id, ts, event_type AS kind, value, event_id AS tie FROM events),
signals AS (SELECT vehicle_id, ts::DATE AS date, count(*) FILTER (kind = 'view')::BIGINT AS n_view, count(*) FILTER (kind = 'click')::BIGINT AS n_click,
    count(*) FILTER (kind = 'purchase')::BIGINT AS n_purchase, count(*) FILTER (kind = 'signup')::BIGINT AS n_signup,
    last(value ORDER BY ts, tie) FILTER (kind = 'view') AS level_view, max(value) AS max_value FROM pings GROUP BY ALL),
targets AS (SELECT DISTINCT vehicle_id, ts::DATE AS date, 'error' AS event_type FROM pings WHERE kind = 'error' AND value >= 100),
catalog AS ({CATALOG_SQL}),
grid AS (SELECT v.vehicle_id, d.date, oem, model_year, powertrain, n_view, n_click, n_purchase, n_signup, level_view, max_value, s.vehicle_id IS NOT NULL AS active
    FROM vehicles v CROSS JOIN (SELECT unnest(generate_series((SELECT min(date) FROM signals), (SELECT max(date) FROM signals), INTERVAL 1 DAY))::DATE AS date) d
    LEFT JOIN signals s ON s.vehicle_id = v.vehicle_id AND s.date = d.date)"""
NEXT = """, next AS (SELECT g.*, (e.date - g.date)::INT AS days_to_event FROM grid g ASOF LEFT JOIN targets e ON g.vehicle_id = e.vehicle_id AND g.date < e.date)"""
LABELED = BASE + NEXT + f""", labeled AS (SELECT *, CASE WHEN NOT active OR date > (SELECT max(date) FROM grid) - {HORIZON} THEN -1 WHEN days_to_event <= {HORIZON} THEN 1 ELSE 0 END::INT AS y FROM next)"""
KNOWN = LABELED + """, known AS (SELECT *, round(coalesce(max_value, 0) + coalesce(n_view, 0) * 3 + coalesce(n_click, 0) * 2, 0) AS score, round(coalesce(level_view, 0), 0) AS other,
    CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS weight, lpad(vehicle_id, 12, '0') || '|' || date::VARCHAR AS row_id FROM labeled WHERE y >= 0)"""


def _unpivot_sql(source: str, ids: list[str], name: str) -> str:
    keep = "vehicle_id, date, oem, model_year, powertrain, active" + (", y, days_to_event" if source != "grid" else "")
    return f", {name} AS (" + " UNION ALL ".join(f"SELECT {keep}, '{i}' AS signal, {i}::DOUBLE AS value FROM {source}" for i in ids) + ")"


LONG = BASE + _unpivot_sql("grid", IDS, "bare") + ", long AS (SELECT b.*, unit, declared_frequency, c.powertrain AS signal_powertrain, c.powertrain IN ('any', b.powertrain) AS eligible FROM bare b JOIN catalog c ON signal_id = signal)"
PLANTED = LABELED + f", planted AS (SELECT *, CASE WHEN active THEN (y = 1 AND {uniform_sql(1, 'vehicle_id', 'date')} < 0.9)::INT::DOUBLE END AS leak FROM labeled)" + _unpivot_sql("planted", [*IDS, "leak"], "long")
KNOWN_LONG = PLANTED + ", kl AS (SELECT * FROM long WHERE y >= 0)"

QUERIES, SQL = {}, {}


def query(sql: str | None = None, columns: str | None = None):
    """Registers a function of the view as a query; its result is rounded, and so is the SQL's."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(View(spark, sf_dir)))
        if sql:
            SQL[fn.__name__] = rounded_sql(sql, columns) if columns else sql
        return fn

    return add


@query(BASE + ", result AS (SELECT * FROM vehicles)", "vehicle_id oem model_year powertrain")
def vehicles_view(v):
    return v.vehicles


@query(BASE + ", result AS (SELECT vehicle_id, date, event_type FROM targets UNION ALL SELECT vehicle_id, date, kind FROM (SELECT DISTINCT vehicle_id, ts::DATE AS date, kind FROM pings WHERE kind IN ('signup', 'purchase')))", "vehicle_id date event_type")
def events_view_union(v):
    other = v.pings.where("kind IN ('signup', 'purchase')").select("vehicle_id", F.to_date("ts").alias("date"), F.col("kind").alias("event_type")).distinct()
    return v.events.unionByName(other)


@query(BASE + ", result AS (SELECT * FROM signals)", "vehicle_id date n_view n_click n_purchase n_signup level_view~ max_value~")
def daily_rollup(v):
    return v.signals


@query(BASE + ", result AS (SELECT vehicle_id, ts::DATE AS date, avg(value) FILTER (kind = 'view') AS view, avg(value) FILTER (kind = 'click') AS click FROM pings WHERE kind IN ('view', 'click') GROUP BY ALL)", "vehicle_id date view~ click~")
def daily_rollup_long_pivot(v):
    long = v.pings.select("vehicle_id", F.to_date("ts").alias("date"), F.col("kind").alias("signal_id"), "value")
    return fleet.pivot_long(long, ["view", "click"])


@query(BASE + ", result AS (SELECT vehicle_id, ts::DATE AS date, kind, last(value ORDER BY ts, tie) AS value FROM pings GROUP BY ALL)", "vehicle_id date kind value~")
def last_value_of_day(v):
    return v.pings.groupBy("vehicle_id", F.to_date("ts").alias("date"), "kind").agg(F.max_by(F.struct("value"), F.struct("ts", "tie"))["value"].alias("value"))


@query(BASE + ", result AS (SELECT v.vehicle_id, v.oem, v.model_year, s.date, n_view FROM signals s JOIN vehicles v USING (vehicle_id) WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12')", "vehicle_id oem model_year date n_view")
def wide_scan_window(v):
    tables = {"vehicles": v.vehicles, "signals_daily": v.signals, "events": v.events, "signal_catalog": v.catalog}
    source = fleet.Warehouse(tables.__getitem__, fleet.Names.of({"start": "2024-01-05", "end": "2024-01-12"}))
    return source.signals(["n_view"]).select("vehicle_id", "oem", "model_year", "date", "n_view")


@query(BASE + ", result AS (SELECT vehicle_id, date, 'breakdown' AS event_type FROM targets)", "vehicle_id date event_type")
def warehouse_renamed_events(v):
    upper = v.events.select(F.col("vehicle_id").alias("VIN"), F.col("date").cast("timestamp").alias("DATE"), F.col("event_type").alias("EVENT_TYPE"))
    source = fleet.Warehouse({"vehicles": v.vehicles, "EV": upper}.__getitem__, fleet.Names(events="EV", columns={"vehicle_id": "VIN"}, event_types={"breakdown": "error"}))
    return source.events()


@query(BASE + ", result AS (SELECT * FROM vehicles ORDER BY ('0x' || substr(sha256(vehicle_id), 1, 8))::BIGINT, vehicle_id LIMIT 10)", "vehicle_id oem model_year powertrain")
def sample_vehicles_sha256(v):
    return fleet.sample_by_hash(v.vehicles, "vehicle_id", 10)


@query(BASE + ", result AS (SELECT * FROM grid)", "vehicle_id date oem model_year powertrain n_view n_click n_purchase n_signup level_view~ max_value~ active")
def grid_complete(v):
    return v.grid


@query(BASE + ", result AS (SELECT count(DISTINCT (vehicle_id, date)) AS reported, (max(date) - min(date) + 1) * (SELECT count(*) FROM vehicles) AS grid, count(DISTINCT (vehicle_id, date)) / ((max(date) - min(date) + 1) * (SELECT count(*) FROM vehicles)) AS share FROM signals)", "reported grid share~")
def grid_completeness(v):
    return quality.grid_completeness(v.vehicles, v.signals)


@query(BASE + NEXT + ", result AS (SELECT vehicle_id, date, days_to_event FROM next)", "vehicle_id date days_to_event")
def asof_next_event(v):
    return panel.next_event(v.grid, v.events).select("vehicle_id", "date", "days_to_event")


@query(BASE + ", result AS (SELECT g.vehicle_id, g.date, CASE WHEN e.date IS NOT NULL THEN least(365, e.date - g.date) END::INT AS days_to_event FROM grid g ASOF LEFT JOIN targets e ON g.vehicle_id = e.vehicle_id AND g.date <= e.date)", "vehicle_id date days_to_event")
def asof_next_event_inclusive(v):
    return panel.next_event(v.grid, v.events, strict=False, clip=365).select("vehicle_id", "date", "days_to_event")


@query(LABELED + ", result AS (SELECT vehicle_id, date, y FROM labeled)", "vehicle_id date y")
def labels_horizon(v):
    return v.labeled.select("vehicle_id", "date", "y")


@query(LABELED + ", result AS (SELECT oem, avg(y)::DOUBLE AS positive_rate, count(*) AS known_days, count(DISTINCT vehicle_id) AS vehicles FROM labeled WHERE y >= 0 GROUP BY oem)", "oem positive_rate~ known_days vehicles")
def positive_rate_by_oem(v):
    return v.labeled.where("y >= 0").groupBy("oem").agg(F.avg("y").alias("positive_rate"), F.count("*").alias("known_days"), F.count_distinct("vehicle_id").alias("vehicles"))


@query(BASE + f""", s AS (SELECT (SELECT count(*) FROM targets) AS events, (SELECT count(*) FROM vehicles) AS vehicles, max(date) - min(date) + 1 AS days FROM grid),
r AS (SELECT *, vehicles * days / 365.0::DOUBLE AS years FROM s), result AS (SELECT events, vehicles, days::INT AS days, years, events / years AS rate, greatest(0, events / years - 1.96::DOUBLE * sqrt(greatest(events, 1)) / years) AS lo,
events / years + 1.96::DOUBLE * sqrt(greatest(events, 1)) / years AS hi, events / years * {HORIZON} / 365.0::DOUBLE AS per_horizon FROM r)""", "events vehicles days years~ rate~ lo~ hi~ per_horizon~")
def event_rate_ci(v):
    return quality.event_rate(v.vehicles, v.grid, v.events, HORIZON)


DEFECTS = """, dv AS (SELECT * FROM vehicles UNION ALL SELECT '1', 'X', 2020, 'ev' UNION ALL SELECT '1', 'X', 1980, 'steam'),
ds AS (SELECT vehicle_id, date, active, n_view, max_value FROM grid UNION ALL SELECT 'ghost', DATE '2031-01-01', FALSE, 3, NULL UNION ALL SELECT 'ghost', DATE '2031-01-01', TRUE, 1, 2.0),
de AS (SELECT * FROM targets UNION ALL SELECT 'ghost', DATE '2031-02-02', 'error' UNION ALL SELECT 'ghost', DATE '2031-02-02', 'error')"""
RULES = {
    "vehicles_duplicate": ("error", "SELECT vehicle_id FROM dv GROUP BY 1 HAVING count(*) > 1"),
    "vehicles_null": ("error", "SELECT 1 FROM dv WHERE vehicle_id IS NULL OR oem IS NULL"),
    "vehicles_powertrain": ("error", "SELECT 1 FROM dv WHERE powertrain NOT IN ('ice', 'ev', 'hybrid', 'phev', 'any')"),
    "vehicles_model_year": ("warning", "SELECT 1 FROM dv WHERE model_year NOT BETWEEN 1990 AND 2035"),
    "signals_duplicate": ("error", "SELECT 1 FROM ds GROUP BY vehicle_id, date HAVING count(*) > 1"),
    "signals_orphan": ("error", "SELECT 1 FROM ds WHERE vehicle_id NOT IN (SELECT vehicle_id FROM dv)"),
    "signals_future": ("error", "SELECT 1 FROM ds WHERE date > DATE '2030-01-01'"),
    "events_duplicate": ("warning", "SELECT 1 FROM de GROUP BY ALL HAVING count(*) > 1"),
    "events_orphan": ("error", "SELECT 1 FROM de WHERE vehicle_id NOT IN (SELECT vehicle_id FROM dv)"),
    "events_future": ("error", "SELECT 1 FROM de WHERE date > DATE '2030-01-01'"),
    "signals_inactive_value": ("warning", "SELECT 1 FROM ds WHERE NOT active AND (coalesce(n_view, 0) <> 0 OR coalesce(max_value, 0) <> 0)"),
}


@query(BASE + DEFECTS + ", result AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, '{lv}' AS level, count(*) AS count FROM ({q})" for k, (lv, q) in RULES.items()) + ")", "rule level count")
def contract_findings(v):
    made = lambda rows, like: v.spark.createDataFrame(rows, like.schema)
    from datetime import date

    vehicles = v.vehicles.unionByName(made([("1", "X", 2020, "ev"), ("1", "X", 1980, "steam")], v.vehicles))
    own = v.grid.select("vehicle_id", "date", "active", "n_view", "max_value")
    signals = own.unionByName(v.spark.createDataFrame([("ghost", date(2031, 1, 1), False, 3, None), ("ghost", date(2031, 1, 1), True, 1, 2.0)], "vehicle_id string, date date, active boolean, n_view long, max_value double"))
    events = v.events.unionByName(v.spark.createDataFrame([("ghost", date(2031, 2, 2), "error")] * 2, "vehicle_id string, date date, event_type string"))
    return quality.findings(vehicles, signals, events, "2030-01-01", ["n_view", "max_value"])


@query(BASE + ", result AS (SELECT vehicle_id, date FROM targets WHERE vehicle_id NOT IN (SELECT vehicle_id FROM vehicles WHERE powertrain = 'ev'))", "vehicle_id date")
def orphans_events(v):
    return v.events.join(v.vehicles.where("powertrain = 'ev'"), "vehicle_id", "left_anti").select("vehicle_id", "date")


@query(BASE + ", result AS (SELECT vehicle_id, count(*) AS days FROM signals WHERE vehicle_id NOT IN (SELECT vehicle_id FROM targets) GROUP BY 1)", "vehicle_id days")
def orphans_signals(v):
    return v.signals.join(v.events, "vehicle_id", "left_anti").groupBy("vehicle_id").agg(F.count("*").alias("days"))


@query(BASE + ", result AS (SELECT vehicle_id, ts::DATE AS date, kind, count(*) AS copies FROM pings GROUP BY ALL HAVING count(*) > 1)", "vehicle_id date kind copies")
def duplicate_grain(v):
    return v.pings.groupBy("vehicle_id", F.to_date("ts").alias("date"), "kind").agg(F.count("*").alias("copies")).where("copies > 1")


COVERAGE = LONG + """, cov AS (SELECT signal, oem, count(*) AS vehicles, sum(has)::BIGINT AS covered, sum(filled) / sum(n) AS row_rate, sum(has) / count(*) >= 0.2::DOUBLE AS emits
    FROM (SELECT signal, oem, vehicle_id, max((value IS NOT NULL)::INT) AS has, count(value) AS filled, count(*) AS n FROM long WHERE eligible GROUP BY ALL) GROUP BY ALL),
yr AS (SELECT signal, oem, min(CASE WHEN share >= 0.5 THEN model_year END) AS from_year FROM (SELECT signal, oem, model_year, avg(has) AS share FROM
    (SELECT signal, oem, model_year, vehicle_id, max((value IS NOT NULL)::INT) AS has FROM long WHERE eligible GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
fs AS (SELECT v.vehicle_id, v.oem, bool_and(c.powertrain NOT IN ('any', v.powertrain) OR (coalesce(emits, FALSE) AND coalesce(model_year >= from_year, FALSE))) AS full
    FROM vehicles v CROSS JOIN catalog c LEFT JOIN cov ON cov.signal = signal_id AND cov.oem = v.oem LEFT JOIN yr ON yr.signal = signal_id AND yr.oem = v.oem GROUP BY ALL)"""


@query(COVERAGE + ", result AS (SELECT * FROM cov)", "signal oem vehicles covered row_rate~ emits")
def coverage_by_oem(v):
    return quality.coverage_by_oem(v.long)


@query(COVERAGE + ", result AS (SELECT * FROM yr)", "signal oem from_year")
def from_model_year(v):
    return quality.from_model_year(v.long)


def _full(v):
    long = v.long
    return quality.full_set(v.vehicles, quality.coverage_by_oem(long), quality.from_model_year(long), v.catalog)


@query(COVERAGE + ", result AS (SELECT avg(\"full\"::INT::DOUBLE) AS share FROM fs)", "share~")
def coverage_full_set(v):
    return _full(v).agg(F.avg(F.col("full").cast("double")).alias("share"))


@query(COVERAGE + ", result AS (SELECT oem, avg(\"full\"::INT::DOUBLE) AS share, avg(\"full\"::INT::DOUBLE) < 0.5::DOUBLE AS weak FROM fs GROUP BY oem)", "oem share~ weak")
def coverage_full_set_by_oem(v):
    out = _full(v).groupBy("oem").agg(F.avg(F.col("full").cast("double")).alias("share"))
    return out.withColumn("weak", F.col("share") < 0.5)


@query(BASE + ", result AS (SELECT oem, count(*) AS vehicles, avg((powertrain = 'ev')::INT) AS ev_share FROM vehicles GROUP BY oem)", "oem vehicles ev_share~")
def fleet_rollup(v):
    return v.vehicles.groupBy("oem").agg(F.count("*").alias("vehicles"), F.avg((F.col("powertrain") == "ev").cast("double")).alias("ev_share"))


@query(LABELED + ", result AS (SELECT vehicle_id, date, y FROM labeled WHERE vehicle_id IN (SELECT vehicle_id FROM vehicles WHERE powertrain = 'ev'))", "vehicle_id date y")
def population_ev(v):
    return quality.population(v.labeled, v.vehicles, "ev").select("vehicle_id", "date", "y")


@query(BASE + ", result AS (SELECT signal_id, declared_frequency FROM catalog WHERE powertrain IN ('any', 'ice') AND declared_frequency <> 'realtime')", "signal_id declared_frequency")
def candidate_signals_slow(v):
    return quality.candidates(v.catalog, "ice").where("declared_frequency <> 'realtime'").select("signal_id", "declared_frequency")


@query(BASE + """, sp AS (SELECT min(date) AS first, max(date) AS last, count(*) AS n, max(date) - min(date) + 1 AS days FROM signals), fl AS (SELECT count(DISTINCT vehicle_id) AS vehicles, count(DISTINCT oem) AS groups FROM vehicles),
result AS (SELECT 'vehicles_single_group' AS rule, 'warning' AS level, (groups < 2)::BIGINT AS count FROM fl UNION ALL SELECT 'signals_grid_gaps', 'warning', greatest(vehicles * days - n, 0)::BIGINT FROM sp, fl
UNION ALL SELECT 'signals_short_history', 'warning', greatest(180 - days, 0)::BIGINT FROM sp UNION ALL SELECT 'events_outside_dates', 'warning', count(*) FROM targets, sp WHERE date NOT BETWEEN first AND last
UNION ALL SELECT 'events_by_type:' || event_type, 'info', count(*) FROM targets GROUP BY event_type)""", "rule level count")
def contract_shape(v):
    return quality.shape_findings(v.vehicles, v.signals, v.events)


@query()
def contract_schema(v):
    return quality.schema_findings(v.vehicles, v.signals, v.events, IDS)


GAPS = ", gaps AS (SELECT signal, date - lag(date) OVER (PARTITION BY signal, vehicle_id ORDER BY date) AS gap FROM long WHERE value IS NOT NULL), mg AS (SELECT signal, quantile_cont(gap, 0.5) AS median_gap FROM gaps GROUP BY 1), nn AS (SELECT signal, count(value) / count(*) AS nonnull_rate FROM long GROUP BY 1)"
PSI = """, nv AS (SELECT signal, value, row_number() OVER (PARTITION BY signal ORDER BY date, vehicle_id) AS pos, count(*) OVER (PARTITION BY signal) AS n FROM long WHERE value IS NOT NULL),
q AS (SELECT signal, value, n, CASE WHEN pos <= n // 4 THEN 'first' ELSE 'last' END AS part FROM nv WHERE pos <= n // 4 OR pos > n - n // 4),
e AS (SELECT signal, list_sort(list_distinct(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS edges, count(*) AS m, stddev_pop(value) AS sd, max(n) AS n FROM q WHERE part = 'first' GROUP BY signal),
pl AS (SELECT q.signal, part, len(list_filter(edges, lambda x: x <= value)) AS bin FROM q JOIN e USING (signal)),
bn AS (SELECT signal, unnest(generate_series(0, len(edges))) AS bin, m, sd, n FROM e),
sh AS (SELECT bn.signal, m, sd, n, greatest((SELECT count(*) FROM pl WHERE pl.signal = bn.signal AND pl.bin = bn.bin AND part = 'first') / m, 1e-6::DOUBLE) AS a,
   greatest((SELECT count(*) FROM pl WHERE pl.signal = bn.signal AND pl.bin = bn.bin AND part = 'last') / m, 1e-6::DOUBLE) AS b FROM bn),
ps AS (SELECT signal, CASE WHEN n <= 200 OR m < 50 OR sd = 0 THEN 0 ELSE sum((b - a) * ln(b / a)) END AS psi FROM sh GROUP BY signal, m, sd, n)"""
BOUND = "CASE unit WHEN 'pct' THEN value IN (0, 100) WHEN 'kPa' THEN value IN (0, 1400) WHEN 'count' THEN value = 0 ELSE FALSE END"
FROZEN = f""", fz AS (SELECT *, lag(value) OVER w AS pv, lag(date) OVER w AS pd FROM long WHERE value IS NOT NULL AND unit IN {quality.PERSISTENT} AND declared_frequency <> 'weekly' WINDOW w AS (PARTITION BY signal, vehicle_id ORDER BY date)),
isl AS (SELECT *, sum(CASE WHEN pv = value AND date - pd = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY signal, vehicle_id ORDER BY date) AS island FROM fz),
rn AS (SELECT signal, vehicle_id, island, count(*) AS run, max(({BOUND})::INT) AS bound FROM isl GROUP BY ALL),
fr AS (SELECT signal, avg((longest >= DAYS)::INT) AS frozen_share FROM (SELECT signal, vehicle_id, max(CASE WHEN bound = 0 THEN run ELSE 0 END) AS longest FROM rn GROUP BY ALL) GROUP BY signal)"""
IMPLAUSIBLE = ", im AS (SELECT signal, avg((CASE unit WHEN 'pct' THEN value < 0 OR value > 100 WHEN 'kPa' THEN value < 0 OR value > 1400 WHEN 'count' THEN value < 0 ELSE FALSE END)::INT) AS implausible_share FROM long WHERE value IS NOT NULL GROUP BY 1)"
FLAGS = GAPS + PSI + FROZEN.replace("DAYS", "14") + IMPLAUSIBLE + """, fl AS (SELECT c.signal_id AS signal, concat_ws(',', CASE WHEN psi > 0.2 THEN 'drift' END, CASE WHEN frozen_share > 0.1 THEN 'frozen' END, CASE WHEN implausible_share > 0.01 THEN 'implausible' END,
   CASE WHEN nonnull_rate < 0.05 THEN 'sparse' END, CASE WHEN median_gap > 1.5 * CASE WHEN declared_frequency = 'weekly' THEN 7 ELSE 1 END THEN 'stale' END) AS flags
   FROM catalog c LEFT JOIN nn ON nn.signal = signal_id LEFT JOIN mg ON mg.signal = signal_id LEFT JOIN ps ON ps.signal = signal_id LEFT JOIN fr ON fr.signal = signal_id LEFT JOIN im ON im.signal = signal_id)"""


@query(LONG + GAPS + ", result AS (SELECT * FROM nn)", "signal nonnull_rate~")
def nonnull_rate(v):
    return quality.nonnull_rate(v.long)


@query(LONG + GAPS + ", result AS (SELECT * FROM mg)", "signal median_gap~")
def median_gap_days(v):
    return quality.median_gap(v.long)


@query(LONG + PSI + ", result AS (SELECT * FROM ps)", "signal psi~")
def psi_drift(v):
    return quality.psi_drift(v.long)


@query(LONG + FROZEN.replace("DAYS", "2") + ", result AS (SELECT * FROM fr)", "signal frozen_share~")
def frozen_share(v):
    return quality.frozen_share(v.long, 2)


@query(LONG + IMPLAUSIBLE + ", result AS (SELECT * FROM im)", "signal implausible_share~")
def implausible_share(v):
    return quality.implausible_share(v.long)


@query(LONG + ", result AS (SELECT signal, (max(date) - min(date)) / 30.44::DOUBLE AS signal_months, (SELECT (max(date) - min(date)) / 30.44::DOUBLE FROM long) AS dataset_months FROM long WHERE value IS NOT NULL GROUP BY 1)", "signal signal_months~ dataset_months~")
def history_months(v):
    return quality.history_months(v.long)


@query(LONG + FLAGS + ", result AS (SELECT * FROM fl)", "signal flags")
def quality_flags(v):
    return quality.quality_flags(v.long)


@query(LONG + FLAGS + ", result AS (SELECT signal_id AS signal, CASE WHEN signal_id = 'n_click' THEN 'leakage' WHEN contains(flags, 'sparse') THEN 'sparse' WHEN powertrain NOT IN ('any', 'ice') THEN 'powertrain_ineligible' END AS reason FROM catalog JOIN fl ON signal = signal_id)", "signal reason")
def usable_signals(v):
    leaks = v.spark.createDataFrame([("n_click", True)], "signal string, leaks boolean")
    return quality.usable_signals(v.catalog, quality.quality_flags(v.long), leaks, "ice")


def _trailing(n, column):
    return BASE + f", result AS (SELECT vehicle_id, date, avg(max_value) OVER w AS {column} FROM grid WINDOW w AS (PARTITION BY vehicle_id ORDER BY date ROWS {n - 1} PRECEDING))"


@query(_trailing(7, "max_value__m7"), "vehicle_id date max_value__m7~")
def features_m7(v):
    return panel.trailing_features(v.grid, ["max_value"]).select("vehicle_id", "date", "max_value__m7")


@query(_trailing(30, "max_value__m30"), "vehicle_id date max_value__m30~")
def features_m30(v):
    return panel.trailing_features(v.grid, ["max_value"]).select("vehicle_id", "date", "max_value__m30")


@query(BASE + ", result AS (SELECT vehicle_id, date, max_value - avg(max_value) OVER w AS max_value__d30 FROM grid WINDOW w AS (PARTITION BY vehicle_id ORDER BY date ROWS 29 PRECEDING))", "vehicle_id date max_value__d30~")
def features_d30(v):
    return panel.trailing_features(v.grid, ["max_value"]).select("vehicle_id", "date", "max_value__d30")


@query(BASE + ", result AS (SELECT vehicle_id, date, (sum(n_view) OVER (PARTITION BY vehicle_id ORDER BY date ROWS 6 PRECEDING))::BIGINT AS views FROM grid)", "vehicle_id date views")
def weekly_ring_sum(v):
    return panel.ring_sum(v.grid, "n_view", out="views").select("vehicle_id", "date", "views")


@query(BASE + """, RECURSIVE_ROWS AS (SELECT vehicle_id, date, max_value::DOUBLE AS v, row_number() OVER (PARTITION BY vehicle_id ORDER BY date) AS k FROM grid),
r AS (SELECT vehicle_id, date, k, v AS x FROM RECURSIVE_ROWS WHERE k = 1 UNION ALL SELECT n.vehicle_id, n.date, n.k, CASE WHEN n.v IS NULL THEN r.x WHEN r.x IS NULL THEN n.v ELSE r.x * (29.0::DOUBLE / 30.0::DOUBLE) + n.v * (1 - 29.0::DOUBLE / 30.0::DOUBLE) END
 FROM r JOIN RECURSIVE_ROWS n ON n.vehicle_id = r.vehicle_id AND n.k = r.k + 1), result AS (SELECT vehicle_id, date, x AS ewma FROM r)""".replace("RECURSIVE_ROWS", "seq"), "vehicle_id date ewma~")
def ewma_state(v):
    return panel.recursive_mean(v.grid, "max_value")


SQL["ewma_state"] = SQL["ewma_state"].replace("WITH vehicles", "WITH RECURSIVE vehicles", 1)

SAMPLED = LABELED + f""", n AS (SELECT sum((y = 1)::INT) AS p, sum((y = 0)::INT) AS n FROM labeled WHERE y >= 0), t AS (SELECT p, n, least(p, greatest(1000, 150000 // 7)) AS tp FROM n),
tk AS (SELECT *, least(n, greatest(tp * 6, 1), greatest(150000 - tp, 1)) AS tn FROM t),
rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {uniform_sql(42, 'vehicle_id', 'date')}, vehicle_id, date) AS rank FROM labeled WHERE y >= 0),
result AS (SELECT vehicle_id, date, y, CASE WHEN y = 1 THEN p / tp ELSE n / tn END AS weight FROM rk, tk WHERE rank <= CASE WHEN y = 1 THEN tp ELSE tn END)"""


@query(SAMPLED, "vehicle_id date y weight~")
def class_sample_weights(v):
    return panel.class_sample(v.labeled).select("vehicle_id", "date", "y", "weight")


FOLDS = f", pg AS (SELECT vehicle_id, sum(y)::BIGINT AS n_pos FROM labeled WHERE y >= 0 GROUP BY 1), fold AS (SELECT *, ((row_number() OVER (ORDER BY n_pos DESC, {uniform_sql(42, 'vehicle_id')}, vehicle_id) - 1) % 5)::INT AS fold FROM pg)"


@query(LABELED + FOLDS + ", result AS (SELECT * FROM fold)", "vehicle_id n_pos fold")
def group_folds(v):
    return panel.group_folds(v.labeled)


def _auc_sql(source: str, score: str, label: str, weight: str, by: str = "") -> str:
    """(hits, p, n) of Mann-Whitney with half ties, as a subquery."""
    g, comma = (f"PARTITION BY {by}" if by else ""), (f"{by}, " if by else "")
    return f"""(SELECT {comma}sum(pw * (below + nw / 2)) / nullif(sum(pw) * sum(nw), 0) AS auc FROM (SELECT *, coalesce(sum(nw) OVER ({g} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
      (SELECT {comma}{score} AS s, sum({weight}) FILTER ({label} = 1) AS p0, coalesce(sum({weight}) FILTER ({label} = 1), 0) AS pw, coalesce(sum({weight}) FILTER ({label} = 0), 0) AS nw FROM {source} WHERE {score} IS NOT NULL GROUP BY ALL)) {'GROUP BY ' + by if by else ''})"""


@query(KNOWN + f", result AS (SELECT * FROM {_auc_sql('known', 'score', 'y', 'weight')})", "auc~")
def auc_weighted(v):
    return metrics.weighted_auc(v.known, "score", "y", "weight")


@query(f"WITH d AS (SELECT n_chars::DOUBLE AS score, quality FROM documents JOIN labels USING (doc_id)), result AS (SELECT * FROM {_auc_sql('d', 'score', 'quality', '1.0::DOUBLE')})", "auc~")
def auc_document_quality(v):
    d = fleet.table(v.spark, v.dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return metrics.weighted_auc(d.join(fleet.table(v.spark, v.dir, "labels"), "doc_id"), "score", "quality")


@query(KNOWN_LONG + f", ok AS (SELECT signal FROM kl WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 50), src AS (SELECT kl.signal, value, y FROM kl JOIN ok USING (signal)), result AS (SELECT signal, greatest(auc, 1 - auc) AS auc FROM {_auc_sql('src', 'value', 'y', '1.0::DOUBLE', 'signal')})", "signal auc~")
def auc_univariate_by_signal(v):
    return metrics.univariate_auc(v.long_labeled.where("y >= 0"))


CURVE = KNOWN + """, sc AS (SELECT score, coalesce(sum(weight) FILTER (y = 1), 0) AS pw, coalesce(sum(weight) FILTER (y = 0), 0) AS nw FROM known GROUP BY 1),
cv AS (SELECT *, sum(pw) OVER (ORDER BY score DESC) AS tp, sum(nw) OVER (ORDER BY score DESC) AS fp, sum(pw) OVER () AS p FROM sc)"""


@query(CURVE + ", result AS (SELECT sum(pw / p * tp / (tp + fp)) AS pr_auc FROM cv)", "pr_auc~")
def pr_auc(v):
    return metrics.average_precision(v.known, "score", "y", "weight")


@query(KNOWN + ", result AS (SELECT sum(weight * power(least(1, greatest(0, score / 200)) - y, 2)) / sum(weight) AS brier FROM known)", "brier~")
def brier(v):
    return metrics.brier(v.known.withColumn("p", F.col("score") / 200), "p", "y", "weight")


@query(CURVE + ", result AS (SELECT t.target, coalesce(max(CASE WHEN tp / (tp + fp) >= t.target THEN tp / p END), 0) AS recall FROM cv, (VALUES (0.5::DOUBLE), (0.3::DOUBLE), (0.1::DOUBLE)) AS t(target) GROUP BY 1)", "target~ recall~")
def recall_at_precision(v):
    return metrics.recall_at_precision(v.known, "score", "y", [0.5, 0.3, 0.1], "weight")


RATES = [0.0025, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2]
FLAGGED = KNOWN + """, cm AS (SELECT *, sum(weight) OVER (ORDER BY score DESC, row_id) AS cum, sum(weight) OVER () AS total FROM known), fr AS (SELECT unnest([%s]::DOUBLE[]) AS fraction),
fg AS (SELECT cm.*, fraction, round(cum / total, 12) <= fraction OR cum = (SELECT min(cum) FROM cm) AS flag FROM cm, fr)""" % ", ".join(map(str, RATES))


def _top(v):
    return metrics.at_top_fraction(v.known, "score", "y", RATES, "weight")


@query(FLAGGED + ", result AS (SELECT fraction, sum(weight) FILTER (flag AND y = 1) / sum(weight) FILTER (y = 1) AS recall FROM fg GROUP BY 1)", "fraction~ recall~")
def recall_at_top_fraction(v):
    return _top(v).select("fraction", "recall")


@query(FLAGGED + ", result AS (SELECT fraction, coalesce(sum(weight) FILTER (flag AND y = 1), 0) / sum(weight) FILTER (flag) AS precision FROM fg GROUP BY 1)".replace("precision", '"precision"'), 'fraction~ "precision"')
def precision_at_top_fraction(v):
    return _top(v).select("fraction", "precision")


SQL["recall_at_top_fraction"] = SQL["recall_at_top_fraction"].replace("sum(weight) FILTER (flag AND y = 1) /", "coalesce(sum(weight) FILTER (flag AND y = 1), 0) /")
SQL["precision_at_top_fraction"] = SQL["precision_at_top_fraction"].replace('SELECT round(fraction, 6) AS fraction, "precision"', 'SELECT round(fraction, 6) AS fraction, round("precision", 6) AS "precision"')
EVENT = FLAGGED + f""", ev AS (SELECT fraction, vehicle_id, date + days_to_event AS event_date, max(flag::INT) AS caught, max(CASE WHEN flag THEN days_to_event END) AS lead FROM fg WHERE y = 1 GROUP BY ALL),
result AS (SELECT fraction, count(*) AS events, sum(caught)::BIGINT AS caught, sum(caught) / count(*) AS event_recall, quantile_cont(lead, 0.5) AS median_lead,
  (SELECT coalesce(sum(weight) FILTER (flag AND y = 0), 0) / {HORIZON} / (sum(weight) / 30.44::DOUBLE) * 100 FROM fg WHERE fg.fraction = ev.fraction) AS false_alerts FROM ev GROUP BY fraction)"""


@query(EVENT, "fraction~ events caught event_recall~ median_lead~ false_alerts~")
def event_level_metrics(v):
    return metrics.event_level(v.known, "score", HORIZON, RATES, "weight")


#: Fixed value: replicates of an interval.
B = 300
DRAWS = f""", nb AS (SELECT vehicle_id, row_number() OVER (ORDER BY {uniform_sql(42, 'vehicle_id')}, vehicle_id) - 1 AS pos FROM (SELECT DISTINCT vehicle_id FROM known)),
dr AS (SELECT replicate, floor({uniform_sql(42, 'replicate', 'draw')} * (SELECT count(*) FROM nb))::BIGINT AS pos FROM (SELECT unnest(range({B})) AS replicate), (SELECT unnest(range((SELECT count(*) FROM nb))) AS draw)),
ct AS (SELECT replicate, vehicle_id, count(*) AS times FROM dr JOIN nb USING (pos) GROUP BY ALL),
bt AS (SELECT replicate, score, other, y, weight * times AS w FROM known JOIN ct USING (vehicle_id))"""


def _counts(v):
    return metrics.resample_counts(v.known, B)


@query(KNOWN + DRAWS + f", a AS (SELECT * FROM {_auc_sql('bt', 'score', 'y', 'w', 'replicate')}), result AS (SELECT (SELECT auc FROM {_auc_sql('known', 'score', 'y', 'weight')}) AS point, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi, avg(auc) AS mean, count(auc) AS replicates FROM a)", "point~ lo~ hi~ mean~ replicates")
def bootstrap_auc_ci(v):
    return metrics.auc_interval(v.known, "score", "y", _counts(v), "weight")


@query(KNOWN + DRAWS + f", d AS (SELECT a.auc - b.auc AS delta FROM {_auc_sql('bt', 'score', 'y', 'w', 'replicate')} a JOIN {_auc_sql('bt', 'other', 'y', 'w', 'replicate')} b USING (replicate)), result AS (SELECT quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi, avg((delta > 0)::INT) AS p_above, (quantile_cont(delta, 0.975) - quantile_cont(delta, 0.025)) / 2 AS half_width FROM d)", "lo~ hi~ p_above~ half_width~")
def paired_delta_auc(v):
    return metrics.paired_delta(v.known, "score", "other", "y", _counts(v), "weight")


@query(EVENT.replace("result AS", "unused AS") + DRAWS + ", pe AS (SELECT vehicle_id, sum(caught) AS c, count(*) AS e FROM ev WHERE fraction = 0.1::DOUBLE GROUP BY 1), rr AS (SELECT replicate, sum(c * times) / sum(e * times) AS recall FROM pe JOIN ct USING (vehicle_id) GROUP BY 1), result AS (SELECT quantile_cont(recall, 0.025) AS lo, quantile_cont(recall, 0.975) AS hi, avg(recall) AS mean, count(recall) AS replicates FROM rr)", "lo~ hi~ mean~ replicates")
def event_recall_ci(v):
    rows = metrics.flagged(v.known, "score", [0.1], "weight", "row_id").where("y = 1")
    events = rows.groupBy("vehicle_id", F.date_add("date", F.col("days_to_event"))).agg(F.max(F.col("flag").cast("int")).alias("caught"))
    return metrics.event_recall_interval(events, _counts(v))


LEAK = KNOWN_LONG + """, av AS (SELECT signal, avg((value IS NOT NULL)::INT) FILTER (y = 1) AS pos_avail, avg((value IS NOT NULL)::INT) FILTER (y = 0) AS neg_avail FROM kl GROUP BY 1),
sp0 AS (SELECT signal, rank() OVER (PARTITION BY signal ORDER BY value) + (count(*) OVER (PARTITION BY signal, value) - 1) / 2 AS rv, rank() OVER (PARTITION BY signal ORDER BY days_to_event) + (count(*) OVER (PARTITION BY signal, days_to_event) - 1) / 2 AS rd FROM kl WHERE y = 1 AND value IS NOT NULL),
sp AS (SELECT signal, CASE WHEN isnan(corr(rv, rd)) THEN NULL ELSE abs(corr(rv, rd)) END AS rho FROM sp0 GROUP BY 1 HAVING count(*) > 50),
ct AS (SELECT signal, value, count(*) AS c FROM kl WHERE value IS NOT NULL GROUP BY ALL),
md AS (SELECT signal, first(value ORDER BY c DESC, value) AS mode FROM ct GROUP BY 1 HAVING count(*) IN (2, 3)),
ft AS (SELECT signal, (sum(y) FILTER (value <> mode) / count(*) FILTER (value <> mode)) / (sum(y) / count(*)) AS lift, sum(y) FILTER (value <> mode) / sum(y) AS recall FROM kl JOIN md USING (signal) GROUP BY 1 HAVING count(*) FILTER (value <> mode) > 20)"""


@query(LEAK + ", result AS (SELECT signal, pos_avail, neg_avail, pos_avail / neg_avail AS ratio FROM av)", "signal pos_avail~ neg_avail~ ratio~")
def leakage_availability(v):
    return quality.leakage_availability(v.long_labeled.where("y >= 0"))


@query(LEAK + ", result AS (SELECT * FROM sp)", "signal rho~")
def leakage_spearman(v):
    return quality.leakage_spearman(v.long_labeled)


@query(LEAK + ", result AS (SELECT * FROM ft)", "signal lift~ recall~")
def leakage_flag_lift(v):
    return quality.leakage_flag_lift(v.long_labeled.where("y >= 0"))


@query(LEAK + f""", cls AS (SELECT signal FROM kl GROUP BY 1 HAVING sum(y) >= 20 AND sum(1 - y) >= 20), ok AS (SELECT signal FROM kl WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) > 100), src AS (SELECT kl.signal, value, y FROM kl JOIN ok USING (signal)),
ua AS (SELECT signal, greatest(auc, 1 - auc) AS auc FROM {_auc_sql('src', 'value', 'y', '1.0::DOUBLE', 'signal')}),
vd AS (SELECT signal, auc, concat_ws(',', CASE WHEN auc >= 0.99 THEN 'auc' END, CASE WHEN pos_avail / neg_avail >= 2 AND pos_avail > 0.2 THEN 'availability' END, CASE WHEN lift >= 15 AND recall >= 0.25 THEN 'flag' END, CASE WHEN rho >= 0.9 THEN 'timing' END) AS reasons
  FROM cls LEFT JOIN av USING (signal) LEFT JOIN sp USING (signal) LEFT JOIN ft USING (signal) LEFT JOIN ua USING (signal)),
result AS (SELECT signal, reasons, reasons <> '' AS leaks, reasons = '' AND coalesce(auc BETWEEN 0.95 AND 0.99, FALSE) AS suspicious FROM vd)""", "signal reasons leaks suspicious")
def leakage_verdict(v):
    return quality.leakage_verdict(v.long_labeled)


PAIRS = [(x, y) for i, x in enumerate(IDS) for y in IDS[i + 1 :]]
SPEARMAN = BASE + ", pr AS (" + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, {x}::DOUBLE AS va, {y}::DOUBLE AS vb FROM grid WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in PAIRS) + """),
rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY va) + (count(*) OVER (PARTITION BY a, b, va) - 1) / 2 AS ra, rank() OVER (PARTITION BY a, b ORDER BY vb) + (count(*) OVER (PARTITION BY a, b, vb) - 1) / 2 AS rb FROM pr),
rho AS (SELECT a, b, CASE WHEN isnan(corr(ra, rb)) THEN NULL ELSE corr(ra, rb) END AS rho, count(*) AS n FROM rk GROUP BY ALL HAVING count(*) >= 200)"""


@query(SPEARMAN + ", result AS (SELECT * FROM rho)", "a b rho~ n")
def spearman_pairs(v):
    return metrics.spearman_pairs(v.grid, IDS, ["vehicle_id", "date"])


@query(SPEARMAN.replace("WITH vehicles", "WITH RECURSIVE vehicles", 1) + ", ed AS (SELECT a, b FROM rho WHERE abs(rho) >= 0.1 UNION SELECT b, a FROM rho WHERE abs(rho) >= 0.1), reach AS (SELECT signal_id AS a, signal_id AS b FROM catalog UNION SELECT reach.a, ed.b FROM reach JOIN ed ON reach.b = ed.a), result AS (SELECT a AS signal, min(b) AS \"group\" FROM reach GROUP BY 1)", 'signal "group"')
def redundancy_groups(v):
    return metrics.redundancy_groups(metrics.spearman_pairs(v.grid, IDS, ["vehicle_id", "date"]), IDS, 0.1)
