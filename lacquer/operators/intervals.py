"""Interval joins written as equi-joins on a bucket with the range as residual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def over_buckets(df: DataFrame, start: Column, end: Column, bucket: int, name: str = "_bk") -> DataFrame:
    """Copy each half-open integer interval to every bucket it touches."""
    lo = F.floor(start / F.lit(bucket)).cast("bigint")
    hi = F.floor((F.greatest(end, start + 1) - 1) / F.lit(bucket)).cast("bigint")
    return df.withColumn(name, F.explode(F.sequence(lo, hi)))


def points_in(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], ix: str,
    start: str = "start_ix", end: str = "end_ix", bucket: int = 4096, how: str = "inner",
) -> DataFrame:
    """Join each point to the intervals [start, end) of its key that hold it.

    Each point lives in one bucket, so semi, anti and left joins keep their meaning.
    """
    keys = list(keys)
    p = points.withColumn("_bk", F.floor(F.col(ix) / F.lit(bucket)).cast("bigint")).alias("p")
    b = over_buckets(intervals, F.col(start), F.col(end), bucket).alias("b")
    cond = F.col("p._bk") == F.col("b._bk")
    for k in keys:
        cond &= F.col(f"p.{k}") == F.col(f"b.{k}")
    cond &= (F.col(f"p.{ix}") >= F.col(f"b.{start}")) & (F.col(f"p.{ix}") < F.col(f"b.{end}"))
    joined = p.join(b, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*[F.col(f"p.{c}") for c in points.columns])
    right = [c for c in intervals.columns if c not in keys]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"b.{c}") for c in right])


def overlapping(
    left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: int = 4096,
    l_start: str = "start_ix", l_end: str = "end_ix", r_start: str = "r_start", r_end: str = "r_end",
) -> DataFrame:
    """Pairs of overlapping half-open intervals, each pair once (in the bucket where the overlap begins)."""
    keys = list(keys)
    a = over_buckets(left, F.col(l_start), F.col(l_end), bucket).alias("a")
    b = over_buckets(right, F.col(r_start), F.col(r_end), bucket).alias("b")
    cond = F.col("a._bk") == F.col("b._bk")
    for k in keys:
        cond &= F.col(f"a.{k}") == F.col(f"b.{k}")
    cond &= (F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end))
    first = F.floor(F.greatest(F.col(l_start), F.col(r_start)) / F.lit(bucket)).cast("bigint")
    joined = a.join(b, cond & (first == F.col("a._bk")))
    extra = [c for c in right.columns if c not in keys]
    return joined.select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in extra])
