"""Views of the driver tables as the inputs the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ordered import dense_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture_id, sample_ix, amp, user_id): events of one type as one recording, quiet every fifth stretch."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("capture_id"), "ts", "event_id", "value", "user_id"
    )
    minute = F.expr("datediff(ts, date'1970-01-01') * 1440 + hour(ts) * 60 + minute(ts)")
    ix = dense_index(ev, ["capture_id"], ["ts", "event_id"], minute, "sample_ix")
    gate = F.when(F.expr("(sample_ix div 40) % 5 = 4"), F.lit(0.01)).otherwise(F.lit(1.0))
    return ix.select("capture_id", "sample_ix", ((F.col("value") - 50.0) / 600.0 * gate).alias("amp"), "user_id")


SIG = """
sig as (select capture_id, sample_ix, user_id,
  (value - 50.0) / 600.0 * case when (sample_ix // 40) % 5 = 4 then 0.01 else 1.0 end as amp
  from (select event_type as capture_id, value, user_id,
        row_number() over (partition by event_type order by ts, event_id) - 1 as sample_ix from events))"""


def tracks(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """(project_id, number, side, part, supplier, duration, start_sample, end_sample): an order's lines as its tracks.

    `parts` (part, columns) is joined to the tracks: each part's rows travel along as one list while the lines are
    numbered, so that named tracks stay dealt by project.
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber",
        "l_extendedprice", "l_discount", "l_tax", F.col("l_returnflag").alias("side"),
        F.col("l_quantity").alias("duration"),
    )
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax",
             "side", "duration"]
    day = F.expr("datediff(l_shipdate, date'1990-01-01')")
    li = li.withColumn("_len", (F.col("duration") * 1000).cast("bigint"))
    lines, extra = li, []
    if parts is not None:
        own = [c for c in parts.columns if c != "part"]
        held = parts.groupBy(F.col("part").alias("l_partkey")).agg(F.collect_list(F.struct(*own)).alias("_parts"))
        li, extra = li.join(held, "l_partkey", "left"), [F.inline("_parts")]
    summed = dense_index(li, ["project_id"], order, day, "ix", {"end_sample": F.col("_len")}, counted=lines, undealt=True)
    return summed.select(
        "project_id", (F.col("ix") + 1).alias("number"), "side", F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"), "duration",
        (F.col("end_sample") - F.col("_len")).alias("start_sample"), "end_sample", *extra,
    )


TRACKS = """
tr0 as (select l_orderkey as project_id, l_returnflag as side, l_partkey as part, l_suppkey as supplier,
   l_quantity as duration, cast(l_quantity*1000 as bigint) as len,
   row_number() over (partition by l_orderkey order by l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
     l_discount, l_tax, l_returnflag, l_quantity) as number from lineitem),
tracks as (select project_id, number, side, part, supplier, duration,
   cast(sum(len) over w - len as bigint) as start_sample, cast(sum(len) over w as bigint) as end_sample
   from tr0 window w as (partition by project_id order by number rows unbounded preceding))"""
