"""Queries for studies, economics, policy, ledger and streaming, each with the SQL that must agree where SQL can."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalpanel.functions.draws import triangular_sql, uniform_sql
from signalpanel.operators import economics, metrics, panel, policy, studies
from signalpanel.plans import runs
from signalpanel.plans.panel_queries import B, FOLDS, HORIZON, LABELED, QUERIES as PANEL_QUERIES, SIX, SQL as PANEL_SQL, View, _auc_sql, query, rounded
from signalpanel.sources import fleet
from signalpanel.streaming import rollup

FEATURES = ["n_view", "n_click__m7", "max_value__m7", "max_value__m30", "level_view__d30"]
SOURCES = ["n_click", "max_value", "level_view"]


def study_rows(v: View):
    rows = panel.trailing_features(v.labeled, SOURCES).where("y >= 0")
    return studies.with_folds(rows.select("vehicle_id", "date", "oem", "y", *FEATURES))


def study_long(v: View):
    return studies.binned(study_rows(v), FEATURES)


DECILES = "[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]"
ROWS = LABELED + FOLDS + """, ft AS (SELECT *, avg(n_click) OVER w7 AS n_click__m7, avg(max_value) OVER w7 AS max_value__m7, avg(max_value) OVER w30 AS max_value__m30, level_view - avg(level_view) OVER w30 AS level_view__d30
  FROM labeled WINDOW w7 AS (PARTITION BY vehicle_id ORDER BY date ROWS 6 PRECEDING), w30 AS (PARTITION BY vehicle_id ORDER BY date ROWS 29 PRECEDING)),
rw AS (SELECT ft.*, fold FROM ft JOIN fold USING (vehicle_id) WHERE y >= 0),
eg AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS feature, list_distinct(quantile_cont({f}::DOUBLE, {DECILES})) AS edges FROM rw" for f in FEATURES) + "), vl AS (" + " UNION ALL ".join(
    f"SELECT vehicle_id, date, oem, y, fold, '{f}' AS feature, {f}::DOUBLE AS value FROM rw" for f in FEATURES
) + "), lb AS (SELECT vehicle_id, date, oem, y, fold, feature, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(edges, lambda x: x < value)) END::INT AS bin FROM vl JOIN eg USING (feature))"


def oof_sql(src: str, out: str, keys: str = "vehicle_id, date", extra: str = "") -> str:
    """CTEs that end in `out`: keys, score and y of every row of `src`, by odds of the other folds."""
    odds = "ln((p + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) - ln((sum(p) OVER w + 0.5::DOUBLE) / (sum(n) OVER w + 0.5::DOUBLE))"
    return f""", {out}_per AS (SELECT feature, bin, fold, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM {src} GROUP BY ALL), {out}_all AS (SELECT feature, bin, sum(p) AS p, sum(n) AS n FROM {out}_per GROUP BY ALL),
{out}_rest AS (SELECT a.feature, a.bin, f.fold, a.p - coalesce(o.p, 0) AS p, a.n - coalesce(o.n, 0) AS n FROM {out}_all a CROSS JOIN (SELECT DISTINCT fold FROM {src}) f LEFT JOIN {out}_per o ON o.feature = a.feature AND o.bin = a.bin AND o.fold = f.fold),
{out}_tab AS (SELECT feature, bin, fold, {odds} AS odds FROM {out}_rest WINDOW w AS (PARTITION BY feature, fold)),
{out} AS (SELECT {keys}, round(sum(odds), 9) AS score, any_value(y) AS y{extra} FROM {src} JOIN {out}_tab USING (feature, bin, fold) GROUP BY {keys})"""


OOF = ROWS + oof_sql("lb", "oof")


@query(OOF + ", result AS (SELECT vehicle_id, date, y, score FROM oof)", "vehicle_id date y score~")
def scorecard_oof(v):
    # one score of nine decimals in a thousand ends in 500: round by a product, as the SQL's engine does, not by decimal digits
    score = F.round(F.col("score") * 10.0**SIX) / 10.0**SIX
    return studies.out_of_fold(study_long(v)).select("vehicle_id", "date", "y", score.alias("score"))


@query(OOF + f", result AS (SELECT * FROM {_auc_sql('oof', 'score', 'y', '1.0::DOUBLE')})", "auc~")
def scorecard_oof_auc(v):
    return metrics.weighted_auc(studies.out_of_fold(study_long(v)), "score", "y")


SQL_SOLO = ROWS + ", sg AS (SELECT *, split_part(feature, '__', 1) AS signal FROM lb)" + oof_sql("sg", "solo", "signal, vehicle_id, date") + f", solo_auc AS (SELECT * FROM {_auc_sql('solo', 'score', 'y', '1.0::DOUBLE', 'signal')})"


@query(SQL_SOLO + ", result AS (SELECT * FROM solo_auc)", "signal auc~")
def single_signal_baseline(v):
    return studies.single_signal_auc(study_long(v))


@query(ROWS + """, c AS (SELECT feature, bin, y, count(*)::DOUBLE AS c FROM lb GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS a, sum(c) OVER (PARTITION BY feature, bin) AS b, sum(c) OVER (PARTITION BY feature, y) AS l FROM c),
result AS (SELECT feature, sum(c / a * ln(c * a / (b * l))) AS mi FROM m GROUP BY 1)""", "feature mi~")
def mutual_info_binned(v):
    return studies.mutual_information(study_long(v))


PERM = OOF + f""", od AS (SELECT DISTINCT vehicle_id, date, fold FROM lb), ok AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {uniform_sql(42, 'vehicle_id', 'date')}, vehicle_id, date) AS k, count(*) OVER (PARTITION BY fold) AS n FROM od),
pl AS (SELECT lb.*, k, k % n + 1 AS nx FROM lb JOIN ok USING (vehicle_id, date, fold)), gv AS (SELECT fold, nx AS k, feature, bin AS given FROM pl),
sw AS (SELECT s.signal, pl.vehicle_id, pl.date, pl.fold, pl.feature, pl.y, CASE WHEN split_part(pl.feature, '__', 1) = s.signal THEN given ELSE pl.bin END AS bin
  FROM pl JOIN gv USING (fold, k, feature), (SELECT DISTINCT split_part(feature, '__', 1) AS signal FROM lb) s),
sc AS (SELECT signal, vehicle_id, date, fold, round(sum(odds), 9) AS score, any_value(y) AS y FROM sw JOIN oof_tab USING (feature, bin, fold) GROUP BY ALL),
bs AS (SELECT vehicle_id, date, fold, round(sum(odds), 9) AS score, any_value(y) AS y FROM lb JOIN oof_tab USING (feature, bin, fold) GROUP BY ALL),
af AS (SELECT * FROM {_auc_sql('sc', 'score', 'y', '1.0::DOUBLE', 'signal, fold')}), bf AS (SELECT fold, auc AS base FROM {_auc_sql('bs', 'score', 'y', '1.0::DOUBLE', 'fold')}),
fl AS (SELECT signal, avg(base - auc) AS importance, stddev_samp(base - auc) / sqrt(count(*)) AS se FROM af JOIN bf USING (fold) GROUP BY 1),
result AS (SELECT *, importance - 1.96::DOUBLE * se AS lo, importance + 1.96::DOUBLE * se AS hi FROM fl)"""


@query(PERM, "signal importance~ se~ lo~ hi~")
def perm_importance(v):
    return studies.permutation_importance(study_long(v))


@query()
def ablation_trace(v):
    rows = study_rows(v)
    signals = sorted({f.split("__")[0] for f in FEATURES})
    counts = metrics.resample_counts(rows, B)
    trace = studies.ablation(rows, studies.binned(rows, FEATURES), signals, {}, counts)
    return v.spark.createDataFrame([tuple(t.values()) for t in trace], "step int, signal string, p_above double, lo double, hi double, accepted boolean, underpowered boolean, kept_conservatively boolean")


TEMPORAL = ROWS + f""", dy AS (SELECT date, row_number() OVER (ORDER BY date) AS d, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM lb)),
pt AS (SELECT date, CASE WHEN d <= floor(n * 0.7::DOUBLE) THEN 0 WHEN d > floor(n * 0.7::DOUBLE) + {HORIZON} THEN ceil((d - floor(n * 0.7::DOUBLE) - {HORIZON}) * 3 / (n - floor(n * 0.7::DOUBLE) - {HORIZON})) END::INT AS part FROM dy),
tr AS (SELECT lb.*, part FROM lb JOIN pt USING (date) WHERE part IS NOT NULL), tc AS (SELECT feature, bin, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM tr WHERE part = 0 GROUP BY ALL),
tt AS (SELECT feature, bin, ln((p + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) - ln((sum(p) OVER w + 0.5::DOUBLE) / (sum(n) OVER w + 0.5::DOUBLE)) AS odds FROM tc WINDOW w AS (PARTITION BY feature)),
ts AS (SELECT vehicle_id, date, part, round(coalesce(sum(odds), 0), 9) AS score, any_value(y) AS y FROM tr LEFT JOIN tt USING (feature, bin) WHERE part > 0 GROUP BY ALL),
result AS (SELECT part AS "window", count(*) AS rows, sum(y)::BIGINT AS positives, (SELECT auc FROM {_auc_sql('ts', 'score', 'y', '1.0::DOUBLE', 'part')} a WHERE a.part = ts.part) AS auc FROM ts GROUP BY part)"""


@query(TEMPORAL, '"window" rows positives auc~')
def temporal_forward_auc(v):
    return studies.temporal(study_long(v), HORIZON)


LOGO = ROWS + """, en AS (SELECT oem FROM (SELECT DISTINCT vehicle_id, date, oem, y FROM lb) GROUP BY 1 HAVING sum(y) >= 25), lg AS (SELECT lb.* FROM lb JOIN en USING (oem)),
ac AS (SELECT * REPLACE (oem AS fold) FROM lg), ins AS (SELECT * REPLACE (oem || '|' || fold AS fold, oem || '|' || feature AS feature) FROM lg)"""
LOGO += oof_sql("ac", "across", "vehicle_id, date", ", any_value(oem) AS oem") + oof_sql("ins", "inside", "vehicle_id, date, oem")
LOGO += f""", result AS (SELECT a.oem, a.auc, i.auc AS within_auc, CASE WHEN i.auc - a.auc > 0.03 THEN 'does_not_transfer' WHEN i.auc < 0.75 THEN 'oem_lacks_signal' ELSE 'ok' END AS note
  FROM {_auc_sql('across', 'score', 'y', '1.0::DOUBLE', 'oem')} a JOIN {_auc_sql('inside', 'score', 'y', '1.0::DOUBLE', 'oem')} i USING (oem))"""


@query(LOGO, "oem auc~ within_auc~ note")
def leave_one_oem_out_auc(v):
    return studies.transfer_notes(studies.leave_one_group_out(study_long(v)))


CURVE = ROWS + f""", vo AS (SELECT vehicle_id, row_number() OVER (ORDER BY {uniform_sql(42, "'curve'", 'vehicle_id')}, vehicle_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT vehicle_id FROM rw)),
sb AS (SELECT vehicle_id, share FROM vo, (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS share) WHERE k <= floor(n * share)),
lc AS (SELECT lb.* REPLACE (share || '|' || feature AS feature), share FROM lb JOIN sb USING (vehicle_id))""" + oof_sql("lc", "cv", "vehicle_id, date, share") + f""",
result AS (SELECT share, count(*) AS vehicles, (SELECT auc FROM {_auc_sql('cv', 'score', 'y', '1.0::DOUBLE', 'share')} a WHERE a.share = sb.share) AS auc FROM sb GROUP BY share)"""


@query(CURVE, "share~ vehicles auc~")
def learning_curve_auc(v):
    return studies.learning_curve(study_rows(v), FEATURES, [0.25, 0.5, 0.75, 1.0])


SEEDS = [42, 1042, 2042]
STABILITY = ROWS + ", sf AS (" + " UNION ALL ".join(f"SELECT vehicle_id, {s} AS seed, ((row_number() OVER (ORDER BY n_pos DESC, {uniform_sql(s, 'vehicle_id')}, vehicle_id) - 1) % 5)::INT AS fold FROM pg" for s in SEEDS) + """),
sl AS (SELECT lb.* EXCLUDE (fold) REPLACE (seed || '|' || feature AS feature), sf.fold, seed FROM lb JOIN sf USING (vehicle_id))""" + oof_sql("sl", "ss", "vehicle_id, date, seed") + f", aucs AS (SELECT * FROM {_auc_sql('ss', 'score', 'y', '1.0::DOUBLE', 'seed')})"


@query(STABILITY + ", result AS (SELECT seed, auc FROM aucs)", "seed auc~")
def seed_stability_auc(v):
    return studies.seed_stability(study_rows(v), FEATURES, SEEDS)


@query(STABILITY + ", result AS (SELECT max(auc) - min(auc) AS spread, avg(auc) AS mean, stddev_samp(auc) AS sd, max(auc) - min(auc) > 0.005 AS sensitive FROM aucs)", "spread~ mean~ sd~ sensitive")
def seed_spread(v):
    return studies.spread(studies.seed_stability(study_rows(v), FEATURES, SEEDS))


@query()
def logistic_oof_auc(v):
    return metrics.weighted_auc(studies.mllib_out_of_fold(study_rows(v), FEATURES, "logistic"), "score", "y")


@query()
def gbt_oof_auc(v):
    return metrics.weighted_auc(studies.mllib_out_of_fold(study_rows(v), FEATURES, "gbt"), "score", "y")


@query()
def tuning_headroom(v):
    """Paired interval of a looser logistic model against the default one."""
    rows = study_rows(v)
    scored = lambda c, **s: studies.mllib_out_of_fold(rows, FEATURES, "logistic", **s).withColumnRenamed("score", c)
    both = scored("base").join(scored("loose", regParam=0.0).select("vehicle_id", "date", "loose"), ["vehicle_id", "date"])
    out = metrics.paired_delta(both, "loose", "base", "y", metrics.resample_counts(rows, B))
    return out.withColumn("headroom", F.col("lo") > 0.01)


# ---------------------------------------------------------------- economics

FLEET = 20_000.0
LINES = ["gb_month", "ingest", "storage", "compute", "bus", "inference", "infra", "api_calls", "oem_attributed", "oem_marginal", "build_amortized", "marginal_total", "attributed_total"]


def cost_sql(source: str, mode: str, by: str = "", build: bool = True, name: str = "cost") -> str:
    """CTE of monthly cost lines from columns category, declared_frequency."""
    p, g = economics.PRICES, f"{by}, " if by else ""
    samples = "CASE declared_frequency " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in economics.SAMPLES.items()) + " END"
    add = "CASE category " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in economics.ADD_ON.items()) + " ELSE 0 END"
    half = "" if mode == "streaming" else " * 0.5::DOUBLE"
    months = economics.BUILD_HOURS[mode] * p["hour"] / p["amortized_months"] if build else 0.0
    predictions = FLEET * economics.DAYS * (24 if mode == "batch_hourly" else 1) / 1e6 * p["predictions_million"]
    d = "30.44::DOUBLE"
    return f"""{name}_v AS (SELECT {g}count(*) AS n_signals, sum({FLEET!r}::DOUBLE * {samples} * {p['record_bytes']!r}::DOUBLE) AS bytes_day, max({samples}) AS calls_day FROM {source} {'GROUP BY ' + by if by else ''}),
{name}_p AS (SELECT {g}sum({add}) AS packages FROM (SELECT DISTINCT {g}category FROM {source}) {'GROUP BY ' + by if by else ''}),
{name}_l AS (SELECT {g}n_signals, bytes_day, bytes_day * {d} / 1e9 AS gb_month, bytes_day * {d} / 1e9 * 0.0037::DOUBLE * 3 AS ingest, (bytes_day * {d} * 13 / 3 / 1e12 + {FLEET!r}::DOUBLE * n_signals * 4 * 4 * {d} * 3 / 1e12) * 23 AS storage,
  {FLEET!r}::DOUBLE * n_signals * 4 / 20e6 / 60 * 2 * 3 * {d} AS compute, (bytes_day * {d} / 1e9 * 0.2::DOUBLE + bytes_day * 7 / 1e9 * 0.1::DOUBLE){half} AS bus, {predictions!r}::DOUBLE AS inference,
  {FLEET!r}::DOUBLE * calls_day * {d} / 1000 * 0.02::DOUBLE AS api_calls, {FLEET!r}::DOUBLE * (1.99::DOUBLE + packages) AS oem_attributed, 0.0::DOUBLE AS oem_marginal, {months!r}::DOUBLE AS build_amortized FROM {name}_v {f'JOIN {name}_p USING ({by})' if by else f', {name}_p'}),
{name} AS (SELECT *, ingest + storage + compute + bus + inference AS infra, ingest + storage + compute + bus + inference + api_calls + build_amortized + oem_marginal AS marginal_total,
  ingest + storage + compute + bus + inference + api_calls + build_amortized + oem_attributed AS attributed_total FROM {name}_l)"""


CAT = "WITH catalog AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in fleet.CATALOG) + ") AS t(signal_id, category, unit, declared_frequency, powertrain)), "


@query(CAT + cost_sql("catalog", "batch_daily") + ", result AS (SELECT * FROM cost)", "n_signals " + " ".join(f"{x}~" for x in LINES))
def run_cost(v):
    return economics.run_cost(v.catalog, FLEET, "batch_daily").select("n_signals", *LINES)


@query(CAT + "slow AS (SELECT * FROM catalog WHERE declared_frequency <> 'realtime'), " + cost_sql("catalog", "streaming", name="big") + ", " + cost_sql("slow", "batch_daily", name="small") + ", result AS (" + " UNION ALL ".join(f"SELECT '{x}' AS line, big.{x} AS a, small.{x} AS b, (small.{x} - big.{x}) * 100 / nullif(big.{x}, 0) AS change_pct FROM big, small" for x in LINES) + ")", "line a~ b~ change_pct~")
def cost_compare(v):
    small = v.catalog.where("declared_frequency <> 'realtime'")
    return economics.cost_compare(economics.run_cost(v.catalog, FLEET, "streaming"), economics.run_cost(small, FLEET, "batch_daily"), LINES)


@query(CAT + cost_sql("catalog", "batch_daily", "signal_id", False) + ", result AS (SELECT signal_id, marginal_total AS cost FROM cost)", "signal_id cost~")
def signal_marginal_cost(v):
    return economics.signal_marginal_cost(v.catalog, FLEET, "batch_daily")


@query("WITH p AS (SELECT * FROM (VALUES (0, 'batch_daily', 86400, 1), (1, 'batch_hourly', 3600, 0), (2, 'streaming', 60, 0)) AS t(place, pattern, latency_s, least)), f AS (SELECT *, 7 >= least AND latency_s <= 7200 AS feasible FROM p), result AS (SELECT pattern, latency_s, feasible, coalesce(pattern = (SELECT arg_min(pattern, CASE WHEN pattern = 'batch_daily' THEN -1 ELSE place END) FROM f WHERE feasible), FALSE) AS recommended FROM f)", "pattern latency_s feasible recommended")
def deployment_fit(v):
    return economics.deployment_fit(v.spark, 7, 7200.0, "batch_daily")


#: Draws of the return, of each of the tornado's cases, and of each operating point.
ROI_DRAWS, TORNADO_DRAWS, POINT_DRAWS = 10_000, 2_000, 3_000
SEED, COST, FALSE_100 = 11, 3500.0, 1.3
POINTS = {"0.005": (0.15, 0.5), "0.02": (0.40, 2.4), "0.1": (0.80, 14.0)}


def simulation_sql(cases: list[tuple[str, dict, float, float]], n_draws: int) -> str:
    """CTEs sim (a row a case and draw) and summary of cases."""
    names = [f"{k}_{e}" for k in economics.INPUTS for e in ("low", "base", "high")]
    rows = ", ".join("(" + ", ".join([f"'{name}'", f"{cost!r}::DOUBLE", f"{false!r}::DOUBLE", *(f"{x!r}::DOUBLE" for k in economics.INPUTS for x in ranges[k])]) + ")" for name, ranges, cost, false in cases)
    draws = ", ".join(triangular_sql(uniform_sql(SEED, "draw", f"'{k}'"), *(f"{k}_{e}" for e in ("low", "base", "high"))) + f" AS {k}" for k in economics.INPUTS)
    return f"""WITH cases AS (SELECT * FROM (VALUES {rows}) AS t(scenario, run_cost, false_100, {', '.join(names)})), dn AS (SELECT cases.*, draw, {draws} FROM cases, (SELECT unnest(range({n_draws})) AS draw)),
t1 AS (SELECT *, fleet * event_rate * least(1, greatest(0, recall)) AS detected, fleet * 12 * false_100 / 100 AS false_alerts, run_cost * 12 * fleet / fleet_base AS cost_year FROM dn),
t2 AS (SELECT *, detected * value_bearing * preventable * usd_per_event - false_alerts * inspection - cost_year AS net FROM t1), sim AS (SELECT *, net / cost_year AS roi FROM t2),
summary AS (SELECT scenario, quantile_cont(roi, 0.05) AS p5, quantile_cont(roi, 0.5) AS p50, quantile_cont(roi, 0.95) AS p95, avg(roi) AS mean, avg((roi > 0)::INT) AS p_positive, quantile_cont(net, 0.5) AS net_p50 FROM sim GROUP BY 1)"""


def _point_cases():
    return [(name, economics.INPUTS | {"recall": (r * 0.8, r, min(1.0, r * 1.2))}, COST, false) for name, (r, false) in POINTS.items()]


BASE_CASE = [("base", economics.INPUTS, COST, FALSE_100)]


@query(simulation_sql(BASE_CASE, ROI_DRAWS) + ", result AS (SELECT * FROM summary)", "scenario p5~ p50~ p95~ mean~ p_positive~ net_p50~")
def roi_distribution(v):
    return economics.roi_summary(economics.value_terms(economics.drawn(economics.scenarios(v.spark, BASE_CASE), ROI_DRAWS, SEED)))


@query()
def roi_distribution_pert(v):
    return economics.roi_summary(economics.value_terms(economics.drawn_pert(economics.scenarios(v.spark, BASE_CASE), ROI_DRAWS, SEED)))


def _tornado_rows():
    rows = []
    for k, (lo, _, hi) in economics.INPUTS.items():
        for side, x in (("bad", hi if k == "inspection" else lo), ("good", lo if k == "inspection" else hi)):
            rows.append((f"{k}|{side}", economics.INPUTS | {k: (x, x, x)}, COST, FALSE_100))
    return rows + [("run_cost|bad", economics.INPUTS, COST * 2, FALSE_100), ("run_cost|good", economics.INPUTS, COST / 2, FALSE_100)]


@query(simulation_sql(_tornado_rows(), TORNADO_DRAWS) + ", r AS (SELECT split_part(scenario, '|', 1) AS input, max(net_p50) FILTER (scenario LIKE '%|bad') AS bad, max(net_p50) FILTER (scenario LIKE '%|good') AS good FROM summary GROUP BY 1), result AS (SELECT *, abs(good - bad) AS swing, row_number() OVER (ORDER BY abs(good - bad) DESC, input)::INT AS place FROM r)", "input bad~ good~ swing~ place")
def tornado(v):
    cases = economics.tornado_cases(v.spark, economics.INPUTS, COST, FALSE_100)
    return economics.tornado(economics.roi_summary(economics.value_terms(economics.drawn(cases, TORNADO_DRAWS, SEED))))


@query(simulation_sql(_point_cases(), POINT_DRAWS) + ", result AS (SELECT scenario, net_p50, p_positive FROM summary ORDER BY net_p50 DESC, scenario LIMIT 1)", "scenario net_p50~ p_positive~")
def operating_point_choice(v):
    cases = economics.scenarios(v.spark, _point_cases())
    return economics.operating_point(economics.roi_summary(economics.value_terms(economics.drawn(cases, POINT_DRAWS, SEED))))


# ---------------------------------------------------------------- policy

EVIDENCE = {
    "fleet_share": 0.62, "auc_lift_lo": 0.02, "p_roi_positive": 0.9, "feasible_patterns": 2.0, "cross_oem_std": 0.01, "cross_oem_gap": 0.01, "degradation_upper": 0.01, "roi_p5": 0.5,
    "value_validated": 1.0, "history_months": 12.0, "underpowered": 0.0, "curve_gain": 0.008, "seed_spread": 0.002, "suspicious_in_set": 0.0, "placeholders": 0.0, "marginal_cost": 900.0,
}
CEILING = 1000.0


def _evidence(v):
    return v.spark.createDataFrame(list(EVIDENCE.items()), "metric string, value double")


def _rules_sql() -> str:
    rows = policy.RULES + [("gate", "cost", "marginal_cost", "<=", CEILING, 0.1 * CEILING)]
    values = ", ".join(f"('{k}', '{r}', '{m}', '{g}', {t!r}::DOUBLE, {s!r}::DOUBLE)" for k, r, m, g, t, s in rows)
    evidence = ", ".join(f"('{m}', {x!r}::DOUBLE)" for m, x in EVIDENCE.items())
    return f"""WITH rules AS (SELECT * FROM (VALUES {values}) AS t(kind, rule, metric, good, threshold, step)), evidence AS (SELECT * FROM (VALUES {evidence}) AS t(metric, value)),
moved AS (SELECT kind, rule, metric, good, step, value, threshold + CASE WHEN good = '<=' THEN 1 ELSE -1 END * step * shift AS threshold, shift FROM rules LEFT JOIN evidence USING (metric), (VALUES (-1), (0), (1)) AS s(shift)),
judged AS (SELECT *, coalesce(CASE good WHEN '>=' THEN value >= threshold WHEN '>' THEN value > threshold ELSE value <= threshold END, kind = 'flag') AS ok, CASE WHEN good = '<=' THEN threshold - value ELSE value - threshold END AS margin FROM moved),
verdict AS (SELECT shift, CASE WHEN bool_or(kind = 'gate' AND NOT ok) THEN 'NOT_FEASIBLE' WHEN bool_or(NOT ok) THEN 'PILOT' ELSE 'BUILD_READY' END AS decision,
  coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule) FILTER (kind = 'gate' AND NOT ok), '') AS failed, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule) FILTER (kind = 'flag' AND NOT ok), '') AS raised FROM judged GROUP BY shift)"""


@query(_rules_sql() + ", result AS (SELECT kind, rule, metric, value, threshold, ok, margin FROM judged WHERE shift = 0)", "kind rule metric value~ threshold~ ok margin~")
def policy_gates(v):
    return policy.judged(policy.rules(v.spark, CEILING), _evidence(v)).select("kind", "rule", "metric", "value", "threshold", "ok", "margin")


@query(_rules_sql() + ", result AS (SELECT decision, failed, raised FROM verdict WHERE shift = 0)", "decision failed raised")
def policy_verdict(v):
    return policy.verdict(policy.judged(policy.rules(v.spark, CEILING), _evidence(v)))


@query(_rules_sql() + ", result AS (SELECT shift, decision FROM verdict)", "shift decision")
def policy_sensitivity(v):
    return policy.sensitivity(policy.rules(v.spark, CEILING), _evidence(v))


@query(_rules_sql() + ", result AS (SELECT rule, margin / step AS steps FROM judged WHERE shift = 0 AND kind = 'gate' AND ok AND step > 0 ORDER BY steps, rule LIMIT 1)", "rule steps~")
def binding_gate(v):
    return policy.binding_gate(policy.judged(policy.rules(v.spark, CEILING), _evidence(v)))


# ---------------------------------------------------------------- ledger

RUNS = [("r1", "brake", "study", "done", 1, "PILOT", 0.8), ("r2", "theft", "study", "done", 2, "NOT_FEASIBLE", 0.1), ("r3", "brake", "study", "done", 3, "BUILD_READY", 0.9), ("r4", "brake", "whatif", "done", 4, "PILOT", 0.7), ("r5", "battery", "study", "running", 5, None, None), ("r6", "tyre", "study", "done", 6, "PILOT", 0.6)]
RUN_SCHEMA = "run_id string, capability string, kind string, status string, created_at int, verdict string, p_positive double"
SETS = [("r1", "n_view"), ("r1", "level_view"), ("r2", "n_click"), ("r3", "n_view"), ("r3", "max_value"), ("r6", "max_value")]
OUTPUTS = [("coverage", "{\"a\":1}", "{\"a\":1}"), ("roi", "{\"p\":0.5}", "{\"p\":0.6}"), ("timing", "{\"s\":1}", "{\"s\":2}"), ("only_here", "{}", None), ("only_there", None, "{}")]
LINES_TEXT = ["# Brief 1", "Policy version 1.4", "Coverage is 62 % (ev_0123456789ab)", "Rate is 1.05 a year", "No numbers here", "Cost 900 [ev_12]"]
NARRATIVE = [("r1", "It works. AUC is 0.88 (ev_aaaaaaaaaaaa). Cost is 900. Saved 3 (ev_bbbbbbbbbbbb)! Why not?")]


def _values(rows: list[tuple], columns: str) -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns}))"


LATEST = f"WITH runs AS {_values(RUNS, 'run_id, capability, kind, status, created_at, verdict, p_positive')}, sets AS {_values(SETS, 'run_id, signal_id')}, catalog AS {_values(fleet.CATALOG, 'signal_id, category, unit, declared_frequency, powertrain')}, latest AS (SELECT * FROM runs WHERE kind = 'study' AND status = 'done' QUALIFY row_number() OVER (PARTITION BY capability ORDER BY created_at DESC, run_id DESC) = 1), req AS (SELECT signal_id, string_agg(DISTINCT capability, ',' ORDER BY capability) AS required_by FROM latest JOIN sets USING (run_id) WHERE verdict IN ('PILOT', 'BUILD_READY') GROUP BY 1)"


def _latest(v):
    return policy.latest_studies(v.spark.createDataFrame(RUNS, RUN_SCHEMA))


def _required(v):
    return policy.required_signals(_latest(v), v.spark.createDataFrame(SETS, "run_id string, signal_id string"))


@query(LATEST + ", result AS (SELECT run_id, capability, verdict, row_number() OVER (ORDER BY CASE verdict WHEN 'BUILD_READY' THEN 0 WHEN 'PILOT' THEN 1 ELSE 2 END, p_positive DESC, capability)::INT AS place FROM latest)", "run_id capability verdict place")
def portfolio_latest(v):
    return policy.portfolio_order(_latest(v)).select("run_id", "capability", "verdict", "place")


@query(LATEST + ", result AS (SELECT * FROM req)", "signal_id required_by")
def portfolio_required(v):
    return _required(v)


@query(LATEST + ", result AS (SELECT category, count(*) AS unused, sum((declared_frequency = 'realtime')::INT)::BIGINT AS unused_realtime FROM catalog WHERE signal_id NOT IN (SELECT signal_id FROM req) GROUP BY 1)", "category unused unused_realtime")
def unused_signals(v):
    return policy.unused_signals(v.catalog, _required(v))


@query(f"WITH o AS {_values(OUTPUTS, 'name, a, b')}, result AS (SELECT name, CASE WHEN b IS NULL THEN 'missing_in_replay' WHEN a IS NULL THEN 'missing_in_original' WHEN a = b THEN 'identical' WHEN name = 'timing' THEN 'informational' ELSE 'differs' END AS status FROM o)", "name status")
def replay_diff(v):
    side = lambda i: v.spark.createDataFrame([(o[0], o[i]) for o in OUTPUTS if o[i] is not None], "name string, outputs string")
    return policy.replay_diff(side(1), side(2), ("timing",))


EVIDENCE_ROWS = [("r1", "coverage_all", "coverage", policy.canonical({"ids": ["a", "b"], "x": 0.12345678}), "ds1", 42, "{}"), ("r1", "coverage_set", "coverage", policy.canonical({"ids": ["a", "b"], "x": 0.12345678}), "ds1", 42, "{}")]


@query(f"WITH e AS {_values(EVIDENCE_ROWS, 'run_id, name, tool, inputs, dataset_hash, seed, outputs')}, h AS (SELECT *, sha256(tool || '|' || inputs || '|' || dataset_hash || '|' || seed) AS inputs_hash FROM e), result AS (SELECT name, inputs_hash, 'ev_' || substr(sha256(run_id || '|' || name || '|' || tool || '|' || inputs_hash), 1, 12) AS evidence_id FROM h)", "name inputs_hash evidence_id")
def evidence_ids(v):
    rows = v.spark.createDataFrame(EVIDENCE_ROWS, "run_id string, name string, tool string, inputs string, dataset_hash string, seed long, outputs string")
    return policy.with_evidence_id(rows).select("name", "inputs_hash", "evidence_id")


LOG = [("r1", 1, "brake", "study", "queued", None), ("r1", 2, None, None, "running", None), ("r1", 3, None, None, "done", "PILOT"), ("r2", 1, "theft", "study", "queued", None), ("r2", 4, None, None, "failed", None)]


@query(f"WITH l AS {_values(LOG, 'run_id, pos, capability, kind, status, verdict')}, result AS (SELECT run_id, " + ", ".join(f"last({c} ORDER BY pos) FILTER ({c} IS NOT NULL) AS {c}" for c in ("capability", "kind", "status", "verdict")) + " FROM l GROUP BY 1)", "run_id capability kind status verdict")
def run_state(v):
    return policy.run_state(v.spark.createDataFrame(LOG, "run_id string, at int, capability string, kind string, status string, verdict string"))


@query(f"WITH l AS {_values([(x,) for x in LINES_TEXT], 'line')}, result AS (SELECT line FROM l WHERE regexp_matches(line, '[0-9]') AND NOT regexp_matches(line, 'ev_[0-9a-f]{{12}}') AND NOT regexp_matches(line, '^(#|Policy version)'))", "line")
def uncited_lines(v):
    return policy.uncited_lines(v.spark.createDataFrame([(x,) for x in LINES_TEXT], "line string"))


@query("WITH result AS (SELECT * FROM (VALUES ('r1', 0, 'It works.'), ('r1', 1, 'AUC is 0.88 (ev_aaaaaaaaaaaa).'), ('r1', 4, 'Why not?')) AS t(run_id, place, sentence))", "run_id place sentence")
def cited_sentences(v):
    known = v.spark.createDataFrame([("r1", "ev_aaaaaaaaaaaa")], "run_id string, evidence_id string")
    return policy.cited_sentences(v.spark.createDataFrame(NARRATIVE, "run_id string, narrative string"), known)


@query(f"WITH runs AS {_values(RUNS, 'run_id, capability, kind, status, created_at, verdict, p_positive')}, result AS (SELECT run_id, kind, status, row_number() OVER (ORDER BY created_at DESC, run_id DESC)::INT AS place FROM runs QUALIFY place <= 4)", "run_id kind status place")
def run_listing(v):
    """The newest runs first."""
    newest = runs.newest(v.spark.createDataFrame(RUNS, RUN_SCHEMA), 4)
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.col("created_at").desc(), F.col("run_id").desc()))).select("run_id", "kind", "status", "place")


def _made_again(v, horizon):
    """Evidence of the same names by another horizon, from frames that are partitioned another way."""
    labeled = panel.label_panel(v.grid.repartition(5, "date"), v.events, horizon)
    known = labeled.agg(F.sum((F.col("y") >= 0).cast("long")).alias("known"), F.sum((F.col("y") == 1).cast("long")).alias("positive"))
    days = v.grid.agg(F.count("*").alias("days"))
    row = lambda df, name: df.select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("outputs"))
    return row(known, "labels").unionByName(row(days, "grid"))


AGAIN = f"""labels2 AS (SELECT count(*) FILTER (known) AS known, count(*) FILTER (known AND days_to_event <= {HORIZON + 1}) AS positive FROM (SELECT *, active AND date <= (SELECT max(date) FROM grid) - {HORIZON + 1} AS known FROM next)),
labels1 AS (SELECT count(*) FILTER (y >= 0) AS known, count(*) FILTER (y = 1) AS positive FROM labeled)"""


@query(LABELED + ", " + AGAIN + ", result AS (SELECT 'grid' AS name, 'identical' AS status UNION ALL SELECT 'labels', CASE WHEN a.known = b.known AND a.positive = b.positive THEN 'identical' ELSE 'differs' END FROM labels1 a, labels2 b UNION ALL SELECT 'same_labels', 'identical' UNION ALL SELECT 'rate', 'missing_in_replay')", "name status")
def replay_status(v):
    """A study's evidence against evidence made again: by the same horizon, and, under `labels`, by another one."""
    once = _made_again(v, HORIZON)
    same = once.where("name = 'labels'").withColumn("name", F.lit("same_labels"))
    other = _made_again(v, HORIZON + 1)
    rate = v.spark.createDataFrame([("rate", "{}")], "name string, outputs string")
    return policy.replay_diff(once.unionByName(same).unionByName(rate), other.unionByName(_made_again(v, HORIZON).where("name = 'labels'").withColumn("name", F.lit("same_labels"))))


RICH = {"usd_per_event": (900.0, 1500.0, 2700.0)}
WHATIF_CASES = [("as_studied", economics.INPUTS, COST, FALSE_100), ("streaming", economics.INPUTS | RICH, COST, FALSE_100)]


@query(CAT + cost_sql("catalog", "batch_daily", name="batch") + ", " + cost_sql("catalog", "streaming", name="stream") + ", " + simulation_sql(WHATIF_CASES, POINT_DRAWS).removeprefix("WITH ").replace("cases AS (SELECT * FROM", "cases AS (SELECT * REPLACE (CASE scenario WHEN 'streaming' THEN (SELECT marginal_total FROM stream) ELSE (SELECT marginal_total FROM batch) END AS run_cost) FROM", 1) + ", result AS (SELECT scenario, p5, p50, p_positive, net_p50 FROM summary)", "scenario p5~ p50~ p_positive~ net_p50~")
def whatif_roi(v):
    """Return as studied, and with another delivery and another value of an event: cost and value are both made anew."""
    price = {mode: economics.run_cost(v.catalog, FLEET, mode).first().marginal_total for mode in ("batch_daily", "streaming")}
    cases = [(name, inputs, price["streaming" if name == "streaming" else "batch_daily"], false) for name, inputs, _, false in WHATIF_CASES]
    return economics.roi_summary(economics.value_terms(economics.drawn(economics.scenarios(v.spark, cases), POINT_DRAWS, SEED))).select("scenario", "p5", "p50", "p_positive", "net_p50")


@query(SQL_SOLO + ", result AS (SELECT * FROM solo_auc ORDER BY auc DESC, signal LIMIT 3)", "signal auc~")
def top_single_signals(v):
    return studies.top_signals(studies.single_signal_auc(study_long(v)))


@query(CURVE.replace("result AS", "points AS") + ", gained AS (SELECT max(auc) FILTER (share = 1) - max(auc) FILTER (share = 0.5) AS gain FROM points), result AS (SELECT gain, coalesce(gain > 0.01, FALSE) AS still_improving FROM gained)", "gain~ still_improving")
def learning_curve_gain(v):
    return studies.curve_gain(studies.learning_curve(study_rows(v), FEATURES, [0.25, 0.5, 0.75, 1.0]))


@query(ROWS + ", result AS (SELECT oem, avg((" + " + ".join(f"({f} IS NULL)::INT" for f in FEATURES) + f") / {len(FEATURES)}::DOUBLE) AS missing_share FROM rw GROUP BY 1)", "oem missing_share~")
def missing_share_by_oem(v):
    return studies.missing_share(study_rows(v), FEATURES)


# ---------------------------------------------------------------- streaming

SQL = {**PANEL_SQL, "stream_daily_rollup": PANEL_SQL["daily_rollup"]}


def stream_daily_rollup(spark, sf_dir):
    """The streamed roll-up of all files there are now, written by date in the shared folder: the same days as the batch."""
    schema = fleet.table(spark, sf_dir, "events").schema
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='stream-')}/stream_daily_{uuid.uuid4().hex}"
    pings = rollup.ping_stream(spark, f"{sf_dir}/events.parquet*", schema)
    # all files at once, in no order: a watermark of the whole history drops no day
    rollup.upsert_days(rollup.daily(pings, "3650 days"), f"{folder}/days", f"{folder}/log").awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/days").select("vehicle_id", "date", "n_view", "n_click", "n_purchase", "n_signup", "level_view", "max_value"))


QUERIES = {**PANEL_QUERIES, "stream_daily_rollup": stream_daily_rollup}
