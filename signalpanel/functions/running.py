"""Running totals in the order of a number, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(df: DataFrame, key: str, parts: int) -> Column:
    """A column that cuts the rows into about `parts` ranges of the key, of about equal size, ascending."""
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 1000)).first()[0] or []
    edges = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    return F.size(F.filter(edges, lambda e: e <= F.col(key)))


def running_totals(df: DataFrame, key: str, sums: dict[str, str], by: tuple[str, ...] = (), tie: tuple[str, ...] = (), descending: bool = False, parts: int = 64) -> DataFrame:
    """df with, for each out: column of `sums`, the column's total over all rows before this one, and this one.

    With `by`, totals are those of a group. Without, rows are cut into ranges of the key; each range is summed up by its own
    task, and the totals of earlier ranges, a row a range, are added."""
    order = [F.col(key).desc() if descending else F.col(key).asc(), *tie]
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(c).over(w) for out, c in sums.items()})
    df = df.withColumn("_range", ranges(df, key, parts))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumns({out: F.sum(c).over(w) for out, c in sums.items()})
    per = df.groupBy("_range").agg(*(F.sum(c).alias(f"_all_{out}") for out, c in sums.items()))
    earlier = Window.orderBy(F.col("_range").desc() if descending else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("_range", *(F.coalesce(F.sum(f"_all_{out}").over(earlier), F.lit(0)).alias(f"_base_{out}") for out in sums))
    out = inner.join(F.broadcast(base), "_range")  # a row a range
    return out.withColumns({o: F.col(o) + F.col(f"_base_{o}") for o in sums}).drop("_range", *(f"_base_{o}" for o in sums))
