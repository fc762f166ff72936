"""The panel: complete grid, forward as-of labels, trailing features, class sampling, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalpanel.functions.draws import uniform


def day_number(column: str | Column) -> Column:
    return F.datediff(F.col(column) if isinstance(column, str) else column, F.lit("1970-01-01").cast("date"))


def complete_grid(vehicles: DataFrame, signals: DataFrame, ids: list[str]) -> DataFrame:
    """A row for each vehicle and calendar day between the first and the last; active says whether the day reported.

    Days are generated for each vehicle from one broadcast row with both ends, so nothing but the grid itself is large."""
    ends = signals.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    days = vehicles.crossJoin(F.broadcast(ends)).withColumn("date", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    own = signals.select("vehicle_id", "date", *(F.col(i) for i in ids if i in signals.columns), F.lit(True).alias("active"))
    out = days.join(own, ["vehicle_id", "date"], "left").withColumn("active", F.coalesce("active", F.lit(False)))
    return out.withColumns({i: F.lit(None).cast("double") for i in ids if i not in signals.columns}) if set(ids) - set(signals.columns) else out


def next_event(panel: DataFrame, events: DataFrame, strict: bool = True, out: str = "days_to_event", clip: int | None = None) -> DataFrame:
    """Days from each row to its vehicle's next event (strictly later, or the same day too), null where there is none.

    Events join the rows of their vehicle by a union and one window over days: a merge, not a range join."""
    e = events.select("vehicle_id", "date").distinct().withColumns({"_event": day_number("date"), "_row": F.lit(False)})
    rows = panel.withColumn("_row", F.lit(True)).unionByName(e, allowMissingColumns=True).withColumn("_day", day_number("date"))
    w = Window.partitionBy("vehicle_id").orderBy("_day").rangeBetween(1 if strict else 0, Window.unboundedFollowing)
    days = F.min("_event").over(w) - F.col("_day")
    rows = rows.withColumn(out, F.when(days.isNotNull(), F.least(F.lit(clip), days)).cast("int") if clip else days)
    return rows.where("_row").drop("_row", "_event", "_day")


def label_panel(panel: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """y: 1 where the next event is 1 to `horizon` days ahead, -1 where that is unknown (inactive, or too near the end), else 0."""
    last = panel.agg(F.max("date").alias("_last"))
    rows = next_event(panel, events).crossJoin(F.broadcast(last))
    y = F.when(~F.col("active") | (F.col("date") > F.date_sub("_last", horizon)), -1).when(F.col("days_to_event") <= horizon, 1).otherwise(0)
    return rows.withColumn("y", y.cast("int")).drop("_last")


def trailing_features(panel: DataFrame, ids: list[str]) -> DataFrame:
    """For each signal s: s__m7, s__m30 (trailing means with today, nulls left out) and s__d30 (s less s__m30).

    Needs a complete grid; one sort by vehicle and day serves all signals."""
    w = Window.partitionBy("vehicle_id").orderBy("date")
    mean = lambda s, n: F.avg(s).over(w.rowsBetween(1 - n, 0))
    panel = panel.withColumns({f"{s}__m{n}": mean(s, n) for s in ids for n in (7, 30)})
    return panel.withColumns({f"{s}__d30": F.col(s) - F.col(f"{s}__m30") for s in ids})


def ring_sum(panel: DataFrame, column: str, days: int = 7, out: str | None = None) -> DataFrame:
    w = Window.partitionBy("vehicle_id").orderBy("date").rowsBetween(1 - days, 0)
    return panel.withColumn(out or f"{column}__sum{days}", F.sum(column).over(w))


def recursive_mean(panel: DataFrame, column: str, keep: float = 29 / 30, out: str = "ewma") -> DataFrame:
    """x_t = keep x_(t-1) + (1 - keep) value_t along a vehicle's days; a null day keeps the state. A fold over an array of one
    vehicle's days, since no window frame can refer to its own result."""
    days = panel.groupBy("vehicle_id").agg(F.array_sort(F.collect_list(F.struct("date", F.col(column).cast("double").alias("v")))).alias("d"))
    start = F.struct(F.lit(None).cast("double").alias("x"), F.array().cast("array<struct<date:date,x:double>>").alias("out"))

    def step(acc, d):
        x = F.when(d["v"].isNull(), acc["x"]).when(acc["x"].isNull(), d["v"]).otherwise(acc["x"] * keep + d["v"] * (1 - keep))
        return F.struct(x.alias("x"), F.concat(acc["out"], F.array(F.struct(d["date"].alias("date"), x.alias("x")))).alias("out"))

    folded = days.select("vehicle_id", F.explode(F.aggregate("d", start, step)["out"]).alias("e"))
    return folded.select("vehicle_id", F.col("e.date").alias("date"), F.col("e.x").alias(out))


def class_sample(labeled: DataFrame, ratio: int = 6, max_rows: int = 150_000, seed: int = 42) -> DataFrame:
    """Known rows, all positives up to a limit and `ratio` negatives for each, with weights that restore the classes.

    Rows are chosen by a hash of vehicle and day, each class by its own cut."""
    known = labeled.where("y >= 0").withColumn("_u", uniform(seed, "vehicle_id", "date"))
    below = lambda y: F.array(*(F.sum(((F.col("y") == y) & (F.col("_u") < 0.5**k)).cast("long")) for k in range(41)))
    n = known.agg(F.sum((F.col("y") == 1).cast("long")).alias("_p"), F.sum((F.col("y") == 0).cast("long")).alias("_n"), below(1).alias("_pk"), below(0).alias("_nk"))
    most = max(1000, max_rows // (1 + ratio))
    take_p = F.least(F.col("_p"), F.lit(most))
    sizes = n.withColumn("_tp", take_p.cast("long")).withColumn("_tn", F.least(F.col("_n"), F.greatest(F.col("_tp") * ratio, F.lit(1)), F.greatest(F.lit(max_rows) - F.col("_tp"), F.lit(1))).cast("long"))
    # the rows that are taken lie below the smallest power of a half that has enough below it: only about twice as many are ranked
    cut = lambda counts, taken: F.pow(F.lit(0.5), F.size(F.filter(counts, lambda c: c >= F.col(taken))) - 1)
    sizes = sizes.select("_p", "_n", "_tp", "_tn", cut("_pk", "_tp").alias("_pu"), cut("_nk", "_tn").alias("_nu"))
    of = lambda a, b: F.when(F.col("y") == 1, F.col(a)).otherwise(F.col(b))
    near = known.crossJoin(F.broadcast(sizes)).where(F.col("_u") < of("_pu", "_nu"))  # sizes are one row
    rows = near.withColumn("_rank", F.row_number().over(Window.partitionBy("y").orderBy("_u", "vehicle_id", "date")))
    return rows.where(F.col("_rank") <= of("_tp", "_tn")).withColumn("weight", of("_p", "_n") / of("_tp", "_tn")).drop("_u", "_rank", "_p", "_n", "_tp", "_tn", "_pu", "_nu")


def group_folds(labeled: DataFrame, folds: int = 5, seed: int = 42, group: str = "vehicle_id") -> DataFrame:
    """group, n_pos, fold: groups with most positives first are dealt round the folds, ties by hash."""
    per = labeled.where("y >= 0").groupBy(group).agg(F.sum("y").cast("long").alias("n_pos"))
    order = F.row_number().over(Window.orderBy(F.col("n_pos").desc(), uniform(seed, group), F.col(group)))
    return per.withColumn("fold", ((order - 1) % folds).cast("int"))
