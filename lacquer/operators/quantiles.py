"""Exact order statistics per key without holding a large key's values in one task.

Keys of at most `chunk` rows, as many as a task may order, are sorted by themselves. Values of longer keys fall into
order-preserving bins (a fixed function of the value). Counts per bin say which bin holds each wanted rank; only the
values of those bins are shuffled, equal ones counted before. A job that counts the rows of each key finds the long ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK
from ..session import stage
from .ordered import long_keys

BINS_PER_OCTAVE = 1024


def order_bin(v: Column) -> Column:
    """A bigint that never decreases as `v` grows: the sign times a fine logarithm of the magnitude."""
    mag = F.greatest(F.abs(v), F.lit(1e-300))
    step = F.floor((F.log2(mag) + 1000.0) * BINS_PER_OCTAVE)
    return F.when(v > 0, step).when(v < 0, -step).otherwise(F.lit(0)).cast("bigint")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    method: str = "linear",
    skip_at_most: float | None = None,
    min_kept: Column | None = None,
    count_name: str | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per key with the exact quantiles named in `probs`.

    method "linear" interpolates between neighbours; "lower" takes the element at floor((n-1)*p).
    With `skip_at_most`, values at or below it are left out unless fewer than `min_kept` (an expression of
    `_n`, the full count) would remain.
    """
    if method not in ("linear", "lower"):
        raise ValueError("method is linear or lower")
    keys = list(keys)
    how = probs, method, skip_at_most, min_kept, count_name
    few, many = _by_length(df, keys, value, chunk)
    out = _of_few(_sorted(few, keys), keys, *how).drop("_a")
    return out if many is None else out.unionByName(_of_many(many, keys, *how))


def _by_length(df: DataFrame, keys: list[str], value: str, chunk: int) -> tuple[DataFrame, DataFrame | None]:
    """The values (keys, _v) of the short keys, and those of the long ones or None; nulls are left out."""
    v = df.select(*keys, F.col(value).cast("double").alias("_v"))
    for c in [*keys, "_v"]:
        v = v.where(F.col(c).isNotNull())
    long = long_keys(v, keys, chunk)
    if long is None:
        return v, None
    v, long = stage(v), F.broadcast(long.select(*keys))
    return v.join(long, keys, "left_anti"), v.join(long, keys, "left_semi")


def _sorted(v: DataFrame, keys: list[str]) -> DataFrame:
    return v.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_a"))


def _of_few(sets: DataFrame, keys: list[str], probs: dict[str, float], method: str = "linear", skip_at_most: float | None = None,
            min_kept: Column | None = None, count_name: str | None = None) -> DataFrame:
    """Quantiles of sorted arrays `_a`, which stay beside them."""
    n, skip = F.size("_a").cast("bigint"), F.lit(0).cast("bigint")
    sets = sets.withColumn("_n", n)
    if skip_at_most is not None:
        low = F.size(F.filter("_a", lambda x: x <= F.lit(float(skip_at_most))))
        sets = sets.withColumn("_m", low.cast("bigint"))
        skip = F.when(F.col("_n") - F.col("_m") < min_kept, F.lit(0)).otherwise(F.col("_m")).cast("bigint")
    sets = sets.withColumn("_skip", skip)
    at = lambda i: F.get("_a", (i + F.col("_skip")).cast("int"))
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - F.col("_skip") - 1)
        lo = at(F.floor(pos))
        out.append((lo + (at(F.ceil(pos)) - lo) * (pos - F.floor(pos)) if method == "linear" else lo).alias(name))
    if count_name:
        out.append(F.col("_n").alias(count_name))
    return sets.select(*keys, "_a", *out)


def _of_many(v: DataFrame, keys: list[str], probs: dict[str, float], method: str = "linear", skip_at_most: float | None = None,
             min_kept: Column | None = None, count_name: str | None = None) -> DataFrame:
    v = v.withColumn("_bin", order_bin(F.col("_v")))
    low = F.lit(0).cast("bigint")
    if skip_at_most is not None:
        low = F.when(F.col("_v") <= F.lit(float(skip_at_most)), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    bins = v.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_bc"), F.sum(low).alias("_low"))
    whole = Window.partitionBy(*keys)
    up = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        *keys, "_bin", "_bc",
        F.coalesce(F.sum("_bc").over(up), F.lit(0)).alias("_cum"),
        F.sum("_bc").over(whole).alias("_n"),
        F.sum("_low").over(whole).alias("_m"),
    )
    skip = F.lit(0).cast("bigint")
    if skip_at_most is not None:
        skip = F.when(F.col("_n") - F.col("_m") < min_kept, F.lit(0)).otherwise(F.col("_m")).cast("bigint")
    bins = bins.withColumn("_skip", skip).withColumn("_k", F.col("_n") - F.col("_skip"))
    targets = []
    for i, p in enumerate(probs.values()):
        pos = F.lit(float(p)) * (F.col("_k") - 1)
        lo = F.floor(pos).cast("bigint") + F.col("_skip")
        targets.append(F.struct(F.lit(2 * i).alias("id"), lo.alias("rank")))
        if method == "linear":
            hi = F.ceil(pos).cast("bigint") + F.col("_skip")
            targets.append(F.struct(F.lit(2 * i + 1).alias("id"), hi.alias("rank")))
    inside = F.filter(
        F.array(*targets), lambda t: (t["rank"] >= F.col("_cum")) & (t["rank"] < F.col("_cum") + F.col("_bc"))
    )
    wanted = bins.select(*keys, "_bin", "_cum", "_k", "_n", inside.alias("_t")).where(F.size("_t") > 0)
    wanted = F.broadcast(stage(wanted))
    distinct = v.join(wanted.select(*keys, "_bin"), [*keys, "_bin"], "left_semi").groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_c"))
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.join(wanted, [*keys, "_bin"]).withColumn("_top", F.col("_cum") + F.sum("_c").over(in_bin))
    hit = F.filter(
        F.col("_t"), lambda t: (t["rank"] < F.col("_top")) & (t["rank"] >= F.col("_top") - F.col("_c"))
    )
    found = ranked.select(*keys, "_v", "_k", "_n", F.explode(hit["id"]).alias("_id"))
    cols = [F.max("_k").alias("_k"), F.max("_n").alias("_n")]
    for i in range(len(probs)):
        cols.append(F.max(F.when(F.col("_id") == 2 * i, F.col("_v"))).alias(f"_lo{i}"))
        if method == "linear":
            cols.append(F.max(F.when(F.col("_id") == 2 * i + 1, F.col("_v"))).alias(f"_hi{i}"))
    got = found.groupBy(*keys).agg(*cols)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        if method == "linear":
            pos = F.lit(float(p)) * (F.col("_k") - 1)
            frac = pos - F.floor(pos)
            out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(name))
        else:
            out.append(F.col(f"_lo{i}").alias(name))
    if count_name:
        out.append(F.col("_n").alias(count_name))
    return got.select(*keys, *out)


def median(df: DataFrame, keys: Sequence[str], value: str, name: str, count_name: str | None = None) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}, count_name=count_name)


def medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key with the exact median of each named column, all from one pass over (key, column, value)."""
    keys = list(keys)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_which"), F.col(v).cast("double").alias("_x")) for i, v in enumerate(values))))
    long = df.select(*keys, each.alias("_e")).select(*keys, "_e._which", "_e._x")
    got = median(long, [*keys, "_which"], "_x", "_m")
    return got.groupBy(*keys).agg(*(F.max(F.when(F.col("_which") == i, F.col("_m"))).alias(v) for i, v in enumerate(values)))


def median_mad(df: DataFrame, keys: Sequence[str], value: str, center: str, mad: str, count_name: str, chunk: int = CHUNK) -> DataFrame:
    """Median and median absolute deviation: a long key's distances from its median are a second pass."""
    keys = list(keys)
    few, many = _by_length(df, keys, value, chunk)
    mid = _of_few(_sorted(few, keys), keys, {center: 0.5}, count_name=count_name)
    far = F.sort_array(F.transform("_a", lambda x: F.abs(x - F.col(center))))
    out = _of_few(mid.withColumn("_a", far), [*keys, center, count_name], {mad: 0.5}).select(*keys, center, count_name, mad)
    if many is None:
        return out
    mid = _of_many(many, keys, {center: 0.5}, count_name=count_name)
    mid = F.broadcast(stage(mid))
    dist = many.join(mid.select(*keys, center), keys).select(*keys, F.abs(F.col("_v") - F.col(center)).alias("_v"))
    return out.unionByName(mid.join(_of_many(dist, keys, {mad: 0.5}), keys).select(*keys, center, count_name, mad))
