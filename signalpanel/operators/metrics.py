"""Ranking metrics with weights, event-level metrics, and cluster bootstrap intervals.

Scores are collapsed to distinct values first, so rows of one score count half for and half against, and the running totals
see one row a score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from signalpanel.functions.draws import uniform
from signalpanel.functions.running import running_totals


def _weight(df: DataFrame, weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def by_score(df: DataFrame, score: str, label: str, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Weight of positives and negatives at each distinct score."""
    w = _weight(df, weight)
    side = lambda y: F.sum(F.when(F.col(label) == y, w).otherwise(0.0))
    return df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(side(1).alias("pw"), side(0).alias("nw"))


def weighted_auc(df: DataFrame, score: str, label: str, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """auc (Mann-Whitney, ties one half) of each group, null where a class is missing.

    Distinct scores are sorted in ranges, so a group may spread over many tasks; each range is added up for itself, and the
    negatives of earlier ranges, a row a range and group, are added. Nothing runs before the query does."""
    kinds = {c: df.schema[c] for c in by}
    schema = StructType([StructField("__part", IntegerType()), *kinds.values(), *(StructField(c, DoubleType()) for c in ("__p", "__n", "__hits"))])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = by_score(df, score, label, weight, by).select(*by, "score", "pw", "nw").repartitionByRange(parts, *by, "score").sortWithinPartitions(*by, "score")

    def pieces(batches):
        part, held = TaskContext.get().partitionId(), None  # held: the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * batch.num_rows
            p, n = batch.column("pw").to_numpy(), batch.column("nw").to_numpy()
            first = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            out = []
            for lo, hi in zip(first, [*first[1:], len(keys)]):
                if not (held and held[0] == keys[lo]):
                    out += [held] if held else []
                    held = (keys[lo], 0.0, 0.0, 0.0)
                _, ps, ns, hits = held
                held = (keys[lo], ps + p[lo:hi].sum(), ns + n[lo:hi].sum(), hits + float(p[lo:hi] @ (ns + np.cumsum(n[lo:hi]) - n[lo:hi] / 2)))
            if out:
                yield rows_of(out, part)
        if held:
            yield rows_of([held], part)

    arrow = to_arrow_schema(schema)

    def rows_of(found, part):
        columns = [[part] * len(found), *([f[0][i] for f in found] for i in range(len(by))), *([float(f[i]) for f in found] for i in (1, 2, 3))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], arrow.names)

    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    rows = rows.mapInArrow(pieces, schema).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0.0)))
    agg = rows.groupBy(*by).agg(F.sum(F.col("__hits") + F.col("__p") * F.col("__before")).alias("__hits"), F.sum("__p").alias("__p"), F.sum("__n").alias("__n"))
    return agg.select(*by, F.try_divide("__hits", F.col("__p") * F.col("__n")).alias("auc"))


def univariate_auc(long: DataFrame, least: int = 50) -> DataFrame:
    """signal, auc whichever way it points, of signals with at least `least` readings; long has signal, value, y."""
    enough = long.where("value IS NOT NULL").withColumn("_n", F.count("*").over(Window.partitionBy("signal"))).where(F.col("_n") >= least)
    auc = weighted_auc(enough, "value", "y", None, ("signal",))
    return auc.select("signal", F.greatest("auc", 1 - F.col("auc")).alias("auc"))


def _cumulative(df: DataFrame, score: str, label: str, weight: str | None) -> DataFrame:
    rows = running_totals(by_score(df, score, label, weight), "score", {"tp": "pw", "fp": "nw"}, descending=True)
    total = rows.agg(F.sum("pw").alias("p"))
    return rows.crossJoin(F.broadcast(total))


def average_precision(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    rows = _cumulative(df, score, label, weight)
    return rows.agg(F.sum(F.try_divide("pw", "p") * F.try_divide("tp", F.col("tp") + F.col("fp"))).alias("pr_auc"))


def brier(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    p, w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score).cast("double"))), _weight(df, weight)
    return df.agg((F.sum(w * F.pow(p - F.col(label), 2)) / F.sum(w)).alias("brier"))


def recall_at_precision(df: DataFrame, score: str, label: str, targets: list[float], weight: str | None = None) -> DataFrame:
    """target, recall: the best recall at which precision reaches the target, 0 where none does."""
    rows = _cumulative(df, score, label, weight).select((F.col("tp") / F.col("p")).alias("recall"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"))
    rows = rows.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    return rows.groupBy("target").agg(F.coalesce(F.max(F.when(F.col("precision") >= F.col("target"), F.col("recall"))), F.lit(0.0)).alias("recall"))


def flagged(df: DataFrame, score: str, fractions: list[float], weight: str | None, tie: str) -> DataFrame:
    """df for each fraction, with flag: whether the row is among the top fraction by weight (the first row always is)."""
    w = df.withColumn("_w", _weight(df, weight))
    rows = running_totals(w.withColumn("_s", F.col(score).cast("double")), "_s", {"_cum": "_w"}, tie=(tie,), descending=True)
    total = rows.agg(F.sum("_w").alias("_total"), F.min("_cum").alias("_first"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    share = F.round(F.col("_cum") / F.col("_total"), 12)
    return rows.withColumn("flag", (share <= F.col("fraction")) | (F.col("_cum") == F.col("_first"))).drop("_cum", "_total", "_first", "_s")


def at_top_fraction(df: DataFrame, score: str, label: str, fractions: list[float], weight: str | None = None, tie: str = "row_id") -> DataFrame:
    """fraction, recall, precision of the rows with the highest scores."""
    rows = flagged(df, score, fractions, weight, tie)
    hit = F.sum(F.when(F.col("flag") & (F.col(label) == 1), F.col("_w")).otherwise(0.0))
    return rows.groupBy("fraction").agg(F.try_divide(hit, F.sum(F.when(F.col(label) == 1, F.col("_w")).otherwise(0.0))).alias("recall"), F.try_divide(hit, F.sum(F.when(F.col("flag"), F.col("_w")).otherwise(0.0))).alias("precision"))


def event_level(df: DataFrame, score: str, horizon: int, fractions: list[float], weight: str | None = None, tie: str = "row_id") -> DataFrame:
    """For each alert rate: events, those caught by any alert before them, median lead days, and false alerts: weighted
    flagged days without an event ahead, over the horizon, for 100 vehicle-months."""
    rows = flagged(df, score, fractions, weight, tie)
    events = rows.where("y = 1").groupBy("fraction", "vehicle_id", F.date_add("date", F.col("days_to_event").cast("int")).alias("event_date"))
    events = events.agg(F.max(F.col("flag").cast("int")).alias("caught"), F.max(F.when(F.col("flag"), F.col("days_to_event"))).alias("lead"))
    caught = events.groupBy("fraction").agg(F.count("*").alias("events"), F.sum("caught").cast("long").alias("caught"), F.percentile("lead", 0.5).alias("median_lead"))
    false = rows.groupBy("fraction").agg((F.sum(F.when(F.col("flag") & (F.col("y") == 0), F.col("_w")).otherwise(0.0)) / horizon / (F.sum("_w") / 30.44) * 100).alias("false_alerts"))
    return caught.join(false, "fraction").select("fraction", "events", "caught", (F.col("caught") / F.col("events")).alias("event_recall"), "median_lead", "false_alerts")


def resample_counts(groups: DataFrame, replicates: int, seed: int = 42, group: str = "vehicle_id") -> DataFrame:
    """replicate, group, times: each replicate draws as many groups as there are, with replacement, by hashed draws.

    Groups are numbered by hash order; a draw is a number, joined with its group, so counts are partial sums on any cluster."""
    numbered = groups.select(group).distinct().withColumn("_at", F.row_number().over(Window.orderBy(uniform(seed, group), F.col(group))) - 1)
    n = numbered.agg(F.count("*").alias("_n"))
    draws = groups.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate")).crossJoin(F.broadcast(n)).where("_n > 0")
    draws = draws.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    at = F.floor(uniform(seed, "replicate", "_draw") * F.col("_n")).cast("int")
    return draws.select("replicate", at.alias("_at")).groupBy("replicate", "_at").agg(F.count("*").alias("times")).join(numbered, "_at").drop("_at")


def _interval(values: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    return values.groupBy(*by).agg(F.percentile(column, 0.025).alias("lo"), F.percentile(column, 0.975).alias("hi"), F.avg(column).alias("mean"), F.count(column).alias("replicates"))


PIECES = "part int, name string, p array<double>, n array<double>, hits array<double>"


def bootstrap_aucs(df: DataFrame, scores: list[str], label: str, counts: DataFrame, weight: str | None = None, group: str = "vehicle_id") -> DataFrame:
    """replicate, name, auc of each score column; all share the replicates' draws.

    Rows are sorted by score once for all replicates, range by range, each with the numbers of times that its group is drawn;
    every range adds up all replicates in numpy, and the totals of earlier ranges, a row a range, are added."""
    w = _weight(df, weight)
    long = df.select(group, F.col(label).alias("y"), w.alias("w"), F.explode(F.array(*(F.struct(F.lit(s).alias("name"), F.col(s).cast("double").alias("score")) for s in scores))).alias("s"))
    # rows of a vehicle and score are one row before they meet the replicates
    side = lambda y: F.sum(F.when(F.col("y") == y, F.col("w")).otherwise(0.0))
    long = long.where("s.score IS NOT NULL").groupBy(group, "s.name", "s.score").agg(side(1).alias("pw"), side(0).alias("nw"))
    drawn = long.join(counts.groupBy(group).agg(F.collect_list(F.struct("replicate", "times")).alias("drawn")), group)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = drawn.select("name", "score", "pw", "nw", "drawn").repartitionByRange(parts, "name", "score").sortWithinPartitions("name", "score")
    pieces = sorted_rows.mapInArrow(_sorted_pieces, PIECES)
    rows = pieces.select("part", "name", F.posexplode(F.arrays_zip("p", "n", "hits"))).select("part", "name", F.col("pos").alias("replicate"), "col.*")
    # replicates of which a range has no rows are zeros at the ends of its arrays
    earlier = Window.partitionBy("name", "replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0.0)))
    agg = rows.groupBy("replicate", "name").agg(F.sum(F.col("hits") + F.col("p") * F.col("before")).alias("hits"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return agg.select("replicate", "name", F.try_divide("hits", F.col("p") * F.col("n")).alias("auc"))


def _sorted_pieces(batches):
    """For each name of a partition sorted by name and score, and each replicate: weights of positives and negatives, and
    positives times the negatives below them (ties one half) within the partition."""
    part, sums, held = TaskContext.get().partitionId(), {}, None  # held: the last score, whose rows may go on

    def wide(x, size):
        return np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, size - x.shape[-1])]) if x.shape[-1] < size else x

    def close(name, p, n):
        """Adds groups of equal score, ascending: (groups, replicates) weights."""
        size = max(p.shape[1], len(sums[name][0]) if name in sums else 0)
        p, n = wide(p, size), wide(n, size)
        own = [wide(x, size) for x in sums.get(name, [np.zeros(size)] * 3)]
        below = own[1] + np.cumsum(n, axis=0) - n / 2
        sums[name] = [own[0] + p.sum(0), own[1] + n.sum(0), own[2] + (p * below).sum(0)]

    for batch in batches:
        names, score = batch.column("name").to_pylist(), batch.column("score").to_numpy(zero_copy_only=False)
        drawn = batch.column("drawn")
        flat, size = drawn.flatten(), np.diff(drawn.offsets.to_numpy())
        rep, times = flat.field("replicate").to_numpy(), flat.field("times").to_numpy()
        for lo in range(0, len(names), 2048):
            hi = min(lo + 2048, len(names))
            a, b = size[:lo].sum(), size[:hi].sum()
            count = np.zeros((hi - lo, int(rep[a:b].max(initial=0)) + 1))
            count[np.repeat(np.arange(hi - lo), size[lo:hi]), rep[a:b]] = times[a:b]
            pw, nw = (batch.column(c).to_numpy()[lo:hi, None] * count for c in ("pw", "nw"))
            keys = list(zip(names[lo:hi], score[lo:hi]))
            first = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            p, n = np.add.reduceat(pw, first), np.add.reduceat(nw, first)
            if held and held[0] == keys[0]:
                width = max(p.shape[1], held[1].shape[1])
                p, n = wide(p, width), wide(n, width)
                p[0] += wide(held[1], width)[0]
                n[0] += wide(held[2], width)[0]
            elif held:
                close(held[0][0], held[1], held[2])
            of = [keys[i][0] for i in first]
            for name in dict.fromkeys(of):
                at = [i for i in range(len(of) - 1) if of[i] == name]
                if at:
                    close(name, p[at], n[at])
            held = (keys[-1], p[-1:], n[-1:])
    if held:
        close(held[0][0], held[1], held[2])
    if sums:
        yield pa.RecordBatch.from_pylist([{"part": part, "name": k, "p": p.tolist(), "n": n.tolist(), "hits": h.tolist()} for k, (p, n, h) in sums.items()], pa.schema([("part", pa.int32()), ("name", pa.string()), *((c, pa.list_(pa.float64())) for c in ("p", "n", "hits"))]))


def auc_interval(df: DataFrame, score: str, label: str, counts: DataFrame, weight: str | None = None) -> DataFrame:
    """point, lo, hi (2.5 and 97.5 percentiles of the cluster bootstrap), mean, replicates."""
    reps = bootstrap_aucs(df, [score], label, counts, weight)
    return _interval(reps, "auc").crossJoin(weighted_auc(df, score, label, weight).withColumnRenamed("auc", "point"))


def paired_delta(df: DataFrame, a: str, b: str, label: str, counts: DataFrame, weight: str | None = None, threshold: float = 0.0) -> DataFrame:
    """Interval of auc(a) - auc(b) over shared replicates, share of replicates above the threshold, half width."""
    reps = bootstrap_aucs(df, [a, b], label, counts, weight).groupBy("replicate").pivot("name", [a, b]).agg(F.first("auc"))
    delta = reps.select((F.col(a) - F.col(b)).alias("delta"))
    out = delta.agg(F.percentile("delta", 0.025).alias("lo"), F.percentile("delta", 0.975).alias("hi"), F.avg((F.col("delta") > threshold).cast("double")).alias("p_above"))
    return out.withColumn("half_width", (F.col("hi") - F.col("lo")) / 2)


def event_recall_interval(events: DataFrame, counts: DataFrame, group: str = "vehicle_id") -> DataFrame:
    """Interval of the share of events caught; events has the vehicle and caught."""
    per = events.groupBy(group).agg(F.sum("caught").alias("c"), F.count("*").alias("e"))
    reps = per.join(counts, group).groupBy("replicate").agg((F.sum(F.col("c") * F.col("times")) / F.sum(F.col("e") * F.col("times"))).alias("recall"))
    return _interval(reps, "recall")


def average_rank(column: str, by: tuple[str, ...]) -> Column:
    """Rank from 1 within a group; equal values share the mean of their places."""
    w = Window.partitionBy(*by).orderBy(column)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2.0


def spearman_pairs(wide: DataFrame, ids: list[str], key: list[str], least: int = 200) -> DataFrame:
    """a, b, rho, n for each pair of columns, over the rows that have both; pairs of fewer than `least` rows are left out."""
    pairs = [(x, y) for i, x in enumerate(ids) for y in ids[i + 1 :]]
    rows = wide.select(*key, F.explode(F.array(*(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).cast("double").alias("va"), F.col(y).cast("double").alias("vb")) for x, y in pairs))).alias("p")).select("p.*")
    rows = rows.where("va IS NOT NULL AND vb IS NOT NULL")
    ranked = rows.withColumns({"ra": average_rank("va", ("a", "b")), "rb": average_rank("vb", ("a", "b"))})
    return ranked.groupBy("a", "b").agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n")).where(F.col("n") >= least)


def redundancy_groups(pairs: DataFrame, ids: list[str], threshold: float = 0.9) -> DataFrame:
    """signal, group: the alphabetically first signal that it is tied to by |rho| of the threshold or more, through others.

    A few dozen signals: labels spread by as many joins as a chain could be long, doubled each time."""
    edges = pairs.where(F.abs("rho") >= threshold).select("a", "b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    spark = pairs.sparkSession
    nodes = spark.createDataFrame([(i,) for i in ids], "signal string")
    reach = both.unionByName(nodes.select(F.col("signal").alias("a"), F.col("signal").alias("b"))).distinct()
    for _ in range(max(1, (len(ids) - 1).bit_length())):
        reach = reach.alias("x").join(reach.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")).distinct()
    return reach.groupBy(F.col("a").alias("signal")).agg(F.min("b").alias("group"))
