"""The block table: fixed-size runs of samples, sorted so that range reads skip row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 65536
SCHEMA = (
    "capture_id string, channel int, block_ix bigint, start_sample bigint, n int, samples array<double>"
)


def to_blocks(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """(capture_id, channel, sample_ix, amp) to blocks of `block` samples; a block is bounded by its size."""
    grouped = samples.groupBy("capture_id", "channel", F.expr(f"sample_ix div {block}").alias("block_ix")).agg(
        F.array_sort(F.collect_list(F.struct("sample_ix", "amp"))).alias("_s")
    )
    return grouped.select(
        "capture_id", F.col("channel").cast("int").alias("channel"), "block_ix",
        (F.col("block_ix") * block).alias("start_sample"), F.size("_s").alias("n"),
        F.col("_s.amp").alias("samples"),
    )


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Range-partition and sort by (capture, channel, block) so min/max statistics prune range reads."""
    (
        blocks.repartitionByRange("capture_id", "channel", "block_ix")
        .sortWithinPartitions("capture_id", "channel", "block_ix")
        .write.mode("errorifexists").parquet(path)
    )


def read_blocks(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_range(blocks: DataFrame, start: int, end: int, block: int = BLOCK) -> DataFrame:
    """Samples [start, end) of every capture and channel, with `complete` false unless all frames arrived.

    The filter is on the bare `block_ix`, so it reaches the scan.
    """
    if start < 0 or end <= start:
        raise ValueError("a range needs 0 <= start < end")
    hit = blocks.where((F.col("block_ix") >= start // block) & (F.col("block_ix") <= (end - 1) // block))
    first = F.greatest(F.lit(start), F.col("start_sample"))
    last = F.least(F.lit(end), F.col("start_sample") + F.col("n"))
    part = hit.where(last > first).select(
        "capture_id", "channel", first.alias("_first"), (last - first).alias("_got"),
        F.slice("samples", (first - F.col("start_sample") + 1).cast("int"), (last - first).cast("int")).alias("_xs"),
    )
    got = part.groupBy("capture_id", "channel").agg((F.sum("_got") == end - start).alias("complete"))
    rows = part.select("capture_id", "channel", "_first", F.posexplode("_xs").alias("_p", "amp")).select(
        "capture_id", "channel", (F.col("_first") + F.col("_p")).alias("sample_ix"), "amp"
    )
    return rows.join(got, ["capture_id", "channel"])
