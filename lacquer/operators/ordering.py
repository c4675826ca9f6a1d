"""Choice orders of catalogue results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK
from ..session import stage
from .ordered import long_keys


def release_order() -> list[Column]:
    """Vinyl first, then score, date, title, id."""
    vinyl = F.exists("formats", lambda f: F.contains(F.lower(f), F.lit("vinyl")))
    return [vinyl.desc(), F.col("score").desc(), F.col("date").asc(), F.lower("title").asc(), F.col("release_id").asc()]


def rank_by(df: DataFrame, keys: list[str], order: list[Column], chunk: int = CHUNK) -> DataFrame:
    """1-based place in the order per key, ties in any order.

    Where every key has few enough rows for a task to order, keys are ranked by themselves. Otherwise rows are dealt by
    ranges of (keys, order) that Spark draws from a sample of the whole order tuple, so a key's rows spread over tasks
    also where their leading columns are equal. A range ranks its own rows; what lies before it is one count for each
    key and range.
    """
    df = stage(df)
    if long_keys(df, keys, chunk) is None:
        return df.select("*", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int").alias("rank"))
    placed = stage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = placed.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    offsets = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_q"), "_off")
    out = local.join(offsets, [*same, F.col("_range") == F.col("_q")])
    return out.select(*df.columns, (F.col("_r") + F.col("_off")).cast("int").alias("rank"))


def rank_releases(df: DataFrame, keys: list[str]) -> DataFrame:
    return rank_by(df, keys, release_order())


def rank_matches(df: DataFrame, keys: list[str]) -> DataFrame:
    order = [F.col("score").desc(), F.lower("title").asc(), F.lower("artist_credit").asc(), F.col("recording_mbid").asc()]
    return rank_by(df, keys, order)


def rank_selections(df: DataFrame, keys: list[str], side: str, count: int) -> DataFrame:
    """Track selections of a release: both wanted side and count, then count, then side, then sides before media,
    then the nearest count."""
    c, s = F.col("track_count") == count, F.upper("side") == side.upper()
    s = F.coalesce(s, F.lit(False))
    order = [
        (c & s).desc(), c.desc(), s.desc(), (F.col("kind") == "side").desc(), F.abs(F.col("track_count") - count).asc(),
        F.col("medium_position").asc(), F.col("key").asc(),
    ]
    return rank_by(df, keys, order)
