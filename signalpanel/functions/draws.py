"""Draws that depend on keys alone: the same on any cluster, and in any engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *keys: str | Column) -> Column:
    """A number in [0, 1): the first 13 hex digits of the MD5 of seed and keys, joined by |."""
    parts = [F.lit(str(seed)), *(F.col(k) if isinstance(k, str) else k for k in keys)]
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(seed: int | str, *keys: str) -> str:
    """The same in DuckDB's SQL."""
    text = " || '|' || ".join([f"'{seed}'", *(f"({k})::VARCHAR" for k in keys)])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE)"


def triangular(u: Column, low: Column, base: Column, high: Column) -> Column:
    """The triangular distribution's quantile at u; a range of one point is that point."""
    cut = F.try_divide(base - low, high - low)
    left, right = low + F.sqrt(u * (high - low) * (base - low)), high - F.sqrt((1 - u) * (high - low) * (high - base))
    return F.when(high == low, base).when(u < cut, left).otherwise(right)


def triangular_sql(u: str, low: str, base: str, high: str) -> str:
    return f"CASE WHEN {high} = {low} THEN {base} WHEN {u} < ({base} - {low}) / nullif({high} - {low}, 0) THEN {low} + sqrt({u} * ({high} - {low}) * ({base} - {low})) ELSE {high} - sqrt((1 - {u}) * ({high} - {low}) * ({high} - {base})) END"
