"""Chained folds over ordered points: each step depends on the last point kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import collapse


def collapse_points(points: DataFrame, near: float, chunk_seconds: float = 600.0) -> DataFrame:
    """Chain points closer than `near` to the last kept one, keeping the better score: (capture_id, cut_seconds, score).

    However long a chain is, its points stay in chunks of time.
    """
    own = points.select("capture_id", F.col("cut_seconds").alias("cut"), "score")
    return collapse(own, "capture_id", near, [], chunk_seconds).select("capture_id", F.col("cut").alias("cut_seconds"), "score")


def refractory_counts(hits: DataFrame, key: str, at: str, gap: int, window: int) -> DataFrame:
    """Hits per window of `window` positions, counting one only when it lies more than `gap` after the last counted.

    hits: (key, at). The fold restarts with each window, and a window's hits are bounded by its length.
    """
    w = hits.groupBy(key, F.expr(f"{at} div {window}").alias("win_ix")).agg(F.array_sort(F.collect_list(at)).alias("_h"))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, x):
        free = acc["last"].isNull() | (x - acc["last"] > gap)
        return F.struct(F.when(free, x.cast("bigint")).otherwise(acc["last"]).alias("last"),
                        (acc["n"] + free.cast("bigint")).alias("n"))

    return w.select(key, "win_ix", F.aggregate("_h", start, step)["n"].alias("impulses"))


def strongest_apart(hits: DataFrame, key: str, at: str, strength: str, gap: int, window: int, most: int | None) -> DataFrame:
    """Greedy non-maximum suppression per window: by falling strength, keep what is more than `gap` from all kept.

    Of those the `most` strongest of a window come out (all with None), with `left_out`, the number of the others.
    """
    w = hits.groupBy(key, F.expr(f"{at} div {window}").alias("win_ix")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col(strength)).alias("n"), F.col(at).cast("bigint").alias("at")))).alias("_h"))
    none = F.array().cast("array<struct<n:double,at:bigint>>")

    def step(kept, p):
        clash = F.exists(kept, lambda k: F.abs(k["at"] - p["at"]) <= gap)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(p)))

    w = w.withColumn("_k", F.aggregate("_h", none, step))
    top, more = ("_k", F.lit(0)) if most is None else (F.slice("_k", 1, most), F.greatest(F.size("_k") - most, F.lit(0)))
    return w.select(key, "win_ix", more.alias("left_out"), F.explode(top).alias("k")).select(
        key, "win_ix", F.col("k.at").alias(at), (-F.col("k.n")).alias(strength), "left_out")
