"""Models and studies on the labelled panel: scorecard, MLlib models, ablation, robustness.

The scorecard bins each feature into deciles (missing values are a bin) and adds up smoothed log-odds learned on other rows.
It is a join of counts, so out-of-fold scores of all folds come from one pass. Scores are rounded to 9 decimals: rows of
equal bins tie whatever the order in which a cluster adds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalpanel.functions.draws import uniform
from signalpanel.functions.saved import saved
from signalpanel.operators import metrics, panel

ROW = ["vehicle_id", "date"]


def binned(rows: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """A row for each row and feature, with its bin: how many of the feature's distinct quantile edges lie below, -1 if null.

    The edges of all features are one row, broadcast."""
    q = [i / bins for i in range(1, bins)]
    edges = rows.agg(*(F.array_distinct(F.percentile(F.col(f).cast("double"), q)).alias(f"_e_{f}") for f in features))
    keep = [c for c in rows.columns if c not in features]
    at = lambda f: F.when(F.col(f).isNull(), -1).otherwise(F.size(F.filter(f"_e_{f}", lambda e: e < F.col(f).cast("double"))))
    wide = rows.crossJoin(F.broadcast(edges)).select(*keep, *(at(f).cast("int").alias(f) for f in features))
    return wide.unpivot(keep, features, "feature", "bin")


def bin_counts(long: DataFrame, *by: str) -> DataFrame:
    return long.groupBy("feature", "bin", *by).agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("n"))


def _odds(p: Column, n: Column, all_p: Column, all_n: Column) -> Column:
    return F.ln((p + 0.5) / (n + 0.5)) - F.ln((all_p + 0.5) / (all_n + 0.5))


def out_of_fold(long: DataFrame, keys: list[str] = ROW, fold: str = "fold") -> DataFrame:
    """Every row's score by odds that its own fold had no part in; long comes from binned() with y and a fold."""
    per = bin_counts(long, fold)
    folds = per.select(fold).distinct()  # of the counts, which the query has anyway
    whole = per.groupBy("feature", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    own = per.select("feature", "bin", fold, F.col("p").alias("op"), F.col("n").alias("on"))
    rest = whole.crossJoin(F.broadcast(folds)).join(own, ["feature", "bin", fold], "left")  # features x bins x folds
    rest = rest.select("feature", "bin", fold, (F.col("p") - F.coalesce("op", F.lit(0.0))).alias("p"), (F.col("n") - F.coalesce("on", F.lit(0.0))).alias("n"))
    w = Window.partitionBy("feature", fold)
    table = rest.withColumn("odds", _odds(F.col("p"), F.col("n"), F.sum("p").over(w), F.sum("n").over(w))).select("feature", "bin", fold, "odds")
    scored = long.join(F.broadcast(table), ["feature", "bin", fold])
    extra = [c for c in ("y", "oem", "weight", fold) if c in long.columns and c not in keys]
    return scored.groupBy(*keys).agg(F.round(F.sum("odds"), 9).alias("score"), *(F.first(c).alias(c) for c in extra))


def fit_apply(long: DataFrame, train: Column, test: Column, keys: list[str] = ROW) -> DataFrame:
    """Scores of the test rows by odds of the train rows; bins that training never saw say nothing."""
    counts = bin_counts(long.where(train))
    w = Window.partitionBy("feature")
    table = counts.withColumn("odds", _odds(F.col("p"), F.col("n"), F.sum("p").over(w), F.sum("n").over(w))).select("feature", "bin", "odds")
    scored = long.where(test).join(F.broadcast(table), ["feature", "bin"], "left")
    extra = [c for c in ("y", "oem") if c in long.columns]
    return scored.groupBy(*keys).agg(F.round(F.coalesce(F.sum("odds"), F.lit(0.0)), 9).alias("score"), *(F.first(c).alias(c) for c in extra))


def with_folds(rows: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    return rows.join(panel.group_folds(rows, folds, seed).select("vehicle_id", "fold"), "vehicle_id")


def signal_of(feature: Column) -> Column:
    return F.split(feature, "__")[0]


def top_signals(solo: DataFrame, most: int = 3) -> DataFrame:
    """The signals with the highest AUC of their own, ties by name."""
    return solo.orderBy(F.col("auc").desc(), "signal").limit(most)


def compare_sets(long: DataFrame, sets: dict[str, list[str]], counts: DataFrame) -> DataFrame:
    """name, auc, lo, hi of each set of signals out of fold, and the interval of its difference to the first set."""
    out, first = None, None
    for name, signals in sets.items():
        scored = out_of_fold(long.where(signal_of(F.col("feature")).isin(signals))).select(*ROW, "y", F.col("score").alias("own"))
        first = first if first is not None else scored.select(*ROW, F.col("own").alias("first"))
        one = metrics.auc_interval(scored, "own", "y", counts).select(F.lit(name).alias("name"), F.col("point").alias("auc"), "lo", "hi")
        delta = metrics.paired_delta(scored.join(first, ROW), "own", "first", "y", counts).select(F.col("lo").alias("delta_lo"), F.col("hi").alias("delta_hi"))
        one = one.crossJoin(F.broadcast(delta))  # a row each
        out = one if out is None else out.unionByName(one)
    return out


def single_signal_auc(long: DataFrame) -> DataFrame:
    """signal, auc of its features alone, out of fold."""
    per = out_of_fold(long.withColumn("signal", signal_of(F.col("feature"))), ["signal", *ROW])
    return metrics.weighted_auc(per, "score", "y", None, ("signal",))


def permutation_importance(long: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """signal, mean fall of the fold's AUC when the signal's bins are dealt to other rows of the fold together, its standard
    error over folds and 95 % interval. Rows swap by hash order: the k-th gets the bins of the next, the last of the first."""
    w = Window.partitionBy("fold").orderBy(uniform(seed, *ROW), *ROW)
    order = long.select(*ROW, "fold").distinct().withColumn("_k", F.row_number().over(w))
    n = order.groupBy("fold").agg(F.max("_k").alias("_n"))
    order = order.join(F.broadcast(n), "fold").withColumn("_next", F.col("_k") % F.col("_n") + 1)
    rows = long.join(order.drop("fold"), ROW)
    given = rows.select("fold", F.col("_next").alias("_k"), "feature", F.col("bin").alias("_given"))
    swapped = rows.join(given, ["fold", "_k", "feature"])
    signals = long.select(signal_of(F.col("feature")).alias("signal")).distinct()
    each = swapped.crossJoin(F.broadcast(signals)).withColumn("_bin", F.when(signal_of(F.col("feature")) == F.col("signal"), F.col("_given")).otherwise(F.col("bin")))
    table = _fold_table(long)
    score = lambda df, b, *by: df.join(F.broadcast(table.withColumnRenamed("bin", b)), ["feature", b, "fold"]).groupBy(*by, *ROW, "fold").agg(F.round(F.sum("odds"), 9).alias("score"), F.first("y").alias("y"))
    base = metrics.weighted_auc(score(long, "bin"), "score", "y", None, ("fold",)).withColumnRenamed("auc", "base")
    after = metrics.weighted_auc(score(each, "_bin", "signal"), "score", "y", None, ("signal", "fold"))
    fall = after.join(F.broadcast(base), "fold").withColumn("fall", F.col("base") - F.col("auc"))
    out = fall.groupBy("signal").agg(F.avg("fall").alias("importance"), (F.stddev_samp("fall") / F.sqrt(F.count("fall"))).alias("se"))
    return out.withColumns({"lo": F.col("importance") - 1.96 * F.col("se"), "hi": F.col("importance") + 1.96 * F.col("se")})


def _fold_table(long: DataFrame) -> DataFrame:
    """feature, bin, fold, odds learned on the other folds."""
    per = bin_counts(long, "fold")
    folds = per.select("fold").distinct()
    whole = per.groupBy("feature", "bin").agg(F.sum("p").alias("wp"), F.sum("n").alias("wn"))
    rest = whole.crossJoin(F.broadcast(folds)).join(per, ["feature", "bin", "fold"], "left")
    rest = rest.select("feature", "bin", "fold", (F.col("wp") - F.coalesce("p", F.lit(0.0))).alias("p"), (F.col("wn") - F.coalesce("n", F.lit(0.0))).alias("n"))
    w = Window.partitionBy("feature", "fold")
    return rest.select("feature", "bin", "fold", _odds(F.col("p"), F.col("n"), F.sum("p").over(w), F.sum("n").over(w)).alias("odds"))


def mutual_information(long: DataFrame) -> DataFrame:
    """feature, mutual information of its bin and the label, in nats. Binned, where other tools use neighbours."""
    c = long.groupBy("feature", "bin", "y").agg(F.count("*").cast("double").alias("c"))
    w = lambda *k: F.sum("c").over(Window.partitionBy("feature", *k))
    c = c.withColumns({"all": w(), "b": w("bin"), "l": w("y")})
    return c.groupBy("feature").agg(F.sum(F.col("c") / F.col("all") * F.ln(F.col("c") * F.col("all") / (F.col("b") * F.col("l")))).alias("mi"))


def ablation(rows: DataFrame, long: DataFrame, signals: list[str], cost: dict[str, float], counts: DataFrame, tolerance: float = 0.005, share: float = 0.8, screen: int = 20) -> list[dict]:
    """Backward removal, least permutation importance for its cost first, of the `screen` signals that have most. A removal
    stands if at least `share` of the replicates lose no more than `tolerance` against the full set; one that does not stays and
    the search goes on. The trace, a row a step.

    Driver control flow over aggregates: each step is one scorecard and one paired bootstrap on the cluster."""
    worth = {r.signal: max(r.importance or 0.0, 0.0) / max(cost.get(r.signal, 1.0), 1e-9) for r in permutation_importance(long).collect()}
    order = sorted(signals, key=lambda s: (worth.get(s, 0.0), s))[-screen:]
    kept, trace = list(order), []
    full = out_of_fold(long.where(signal_of(F.col("feature")).isin(order))).select(*ROW, "y", F.col("score").alias("full"))
    full = saved(full)
    for s in order:
        rest = [k for k in kept if k != s]
        if not rest:
            break
        less = out_of_fold(long.where(signal_of(F.col("feature")).isin(rest))).select(*ROW, F.col("score").alias("less"))
        d = metrics.paired_delta(full.join(less, ROW), "less", "full", "y", counts, threshold=-tolerance).first()
        stands = d.p_above is not None and d.p_above >= share
        trace.append({"step": len(trace), "signal": s, "p_above": d.p_above, "lo": d.lo, "hi": d.hi, "accepted": stands, "underpowered": bool(stands and d.half_width > tolerance / 2), "kept_conservatively": bool(not stands and d.hi is not None and d.hi > -tolerance)})
        if stands:
            kept = rest
    return trace


def forward_scores(long: DataFrame, horizon: int, train_share: float = 0.7, windows: int = 3) -> DataFrame:
    """Scores of the rows after the training days and a gap of the horizon, with their window (part): odds of the earliest days."""
    days = long.select("date").distinct()
    place = days.withColumn("_d", F.row_number().over(Window.orderBy("date")))
    n = place.agg(F.count("*").alias("_n"))
    cut = F.floor(F.col("_n") * train_share)
    place = place.crossJoin(F.broadcast(n)).withColumn("part", F.when(F.col("_d") <= cut, 0).when(F.col("_d") > cut + horizon, F.ceil((F.col("_d") - cut - horizon) * windows / (F.col("_n") - cut - horizon))))
    rows = long.join(F.broadcast(place.select("date", F.col("part").cast("int").alias("part"))), "date").where("part IS NOT NULL")
    return fit_apply(rows, F.col("part") == 0, F.col("part") > 0, [*ROW, "part"])


def temporal(long: DataFrame, horizon: int, train_share: float = 0.7, windows: int = 3) -> DataFrame:
    """window, rows, positives, auc of forward windows."""
    scored = forward_scores(long, horizon, train_share, windows)
    size = scored.groupBy("part").agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("positives"))
    return size.join(metrics.weighted_auc(scored, "score", "y", None, ("part",)), "part").withColumnRenamed("part", "window")


def leave_one_group_out(long: DataFrame, group: str = "oem", least: int = 25) -> DataFrame:
    """group, auc by odds of all other groups, and of the group's own folds; groups with enough positives."""
    keys = [*ROW, group]
    enough = long.select(*keys, "y").distinct().groupBy(group).agg(F.sum("y").alias("_p")).where(F.col("_p") >= least).select(group)
    rows = long.join(F.broadcast(enough), group, "left_semi")
    across = out_of_fold(rows.withColumn("fold", F.col(group)), ROW)
    out = metrics.weighted_auc(across.select(F.col("fold").alias(group), "score", "y"), "score", "y", None, (group,))
    inside = out_of_fold(rows.withColumn("fold", F.concat_ws("|", group, F.col("fold").cast("string"))).withColumn("feature", F.concat_ws("|", group, "feature")), keys)
    return out.join(metrics.weighted_auc(inside, "score", "y", None, (group,)).withColumnRenamed("auc", "within_auc"), group)


def transfer_notes(per_group: DataFrame) -> DataFrame:
    note = F.when(F.col("within_auc") - F.col("auc") > 0.03, "does_not_transfer").when(F.col("within_auc") < 0.75, "oem_lacks_signal").otherwise("ok")
    return per_group.withColumn("note", note)


def missing_share(rows: DataFrame, features: list[str], group: str = "oem") -> DataFrame:
    """group, share of its readings that are missing, over all features."""
    gone = sum(F.col(f).isNull().cast("double") for f in features) / len(features)
    return rows.groupBy(group).agg(F.avg(gone).alias("missing_share"))


def curve_gain(points: DataFrame, threshold: float = 0.01) -> DataFrame:
    """gain of the AUC from half of the vehicles to all, and whether more would help."""
    at = lambda s: F.max(F.when(F.col("share") == s, F.col("auc")))
    return points.agg((at(1.0) - at(0.5)).alias("gain")).withColumn("still_improving", F.coalesce(F.col("gain") > threshold, F.lit(False)))


def learning_curve(rows: DataFrame, features: list[str], shares: list[float], seed: int = 42) -> DataFrame:
    """share, vehicles, auc with that share of the vehicles: nested subsets by hash order."""
    order = rows.select("vehicle_id").distinct().withColumn("_k", F.row_number().over(Window.orderBy(uniform(seed, F.lit("curve"), "vehicle_id"), "vehicle_id")))
    n = order.agg(F.max("_k").alias("_n"))
    order = order.crossJoin(F.broadcast(n)).withColumn("share", F.explode(F.array(*map(F.lit, shares)))).where(F.col("_k") <= F.floor(F.col("_n") * F.col("share")))
    long = binned(rows, features).join(order.select("vehicle_id", "share"), "vehicle_id").withColumn("feature", F.concat_ws("|", F.col("share").cast("string"), "feature"))
    scored = out_of_fold(long, [*ROW, "share"])
    size = order.groupBy("share").agg(F.count("*").alias("vehicles"))
    return size.join(metrics.weighted_auc(scored, "score", "y", None, ("share",)), "share")


def seed_stability(rows: DataFrame, features: list[str], seeds: list[int], folds: int = 5) -> DataFrame:
    """seed, auc with folds dealt by that seed; one pass for all seeds."""
    dealt = None
    for s in seeds:
        one = panel.group_folds(rows, folds, s).select("vehicle_id", "fold", F.lit(s).alias("seed"))
        dealt = one if dealt is None else dealt.unionByName(one)
    long = binned(rows.drop("fold"), features).join(dealt, "vehicle_id").withColumn("feature", F.concat_ws("|", F.col("seed").cast("string"), "feature"))
    return metrics.weighted_auc(out_of_fold(long, [*ROW, "seed"]), "score", "y", None, ("seed",))


def spread(aucs: DataFrame, threshold: float = 0.005) -> DataFrame:
    out = aucs.agg((F.max("auc") - F.min("auc")).alias("spread"), F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("sd"))
    return out.withColumn("sensitive", F.col("spread") > threshold)


def mllib_out_of_fold(rows: DataFrame, features: list[str], kind: str = "logistic", folds: int = 5, **settings) -> DataFrame:
    """vehicle_id, date, y, fold, score by MLlib: `logistic` (median imputed, scaled) or `gbt` (sentinel and missing marks)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = rows.select(*ROW, F.col("y").cast("double").alias("y"), "fold", *(F.col(f).cast("double").alias(f) for f in features))
    if kind == "gbt":
        rows = rows.withColumns({f"{f}__null": F.col(f).isNull().cast("double") for f in features} | {f: F.coalesce(f, F.lit(-999.0)) for f in features})
        inputs = [*features, *(f"{f}__null" for f in features)]
        model = GBTClassifier(featuresCol="x", labelCol="y", **{"maxIter": 20, "maxDepth": 5, "minInstancesPerNode": 50,  "subsamplingRate": 0.8, "seed": 42} | settings)
        stages = [VectorAssembler(inputCols=inputs, outputCol="x"), model]
    else:
        filled = [f"{f}__filled" for f in features]
        model = LogisticRegression(featuresCol="x", labelCol="y", **{"maxIter": 100, "regParam": 0.01} | settings)
        stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), model]
    out = None
    rows = saved(rows)
    for k in range(folds):
        fitted = Pipeline(stages=stages).fit(rows.where(F.col("fold") != k))
        part = fitted.transform(rows.where(F.col("fold") == k)).select(*ROW, F.col("y").cast("int").alias("y"), "fold", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
