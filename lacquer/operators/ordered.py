"""Ordered operators that never put a whole series into one task.

A series is cut into chunks of consecutive positions. Work inside a chunk is an ordinary window over
(keys, chunk); what crosses a chunk edge is carried by a halo of neighbour rows or by one summary row per
chunk, so one hot series still spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK, TASK_ROWS
from ..session import stage


def long_keys(df: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame | None:
    """The keys of more than `chunk` rows, as many as a task may order, with `_long`; None where there are none.

    One job counts the rows of each key. There is at most one long key for each `chunk` rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_long")).where(F.col("_long") > chunk)
    long = stage(counts.select(*keys, F.lit(True).alias("_long")))
    return None if long.isEmpty() else long


def maybe_long(df: DataFrame, keys: Sequence[str], chunk: int = CHUNK, buckets: int = CHUNK) -> DataFrame | None:
    """The rows of keys that share a hash bucket of more than `chunk` rows, all keys of more than `chunk` among them; None
    where there are none. Counting buckets shuffles little, however many keys there are."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    full = stage(df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk).select("_b"))
    return None if full.isEmpty() else df.join(F.broadcast(full), bucket == F.col("_b"), "left_semi")


def dealt(df: DataFrame, keys: Sequence[str], rows: int, most: int = TASK_ROWS) -> DataFrame:
    """Rows dealt by `keys` into parts of some `most` rows each, where the session's number of partitions makes larger ones.

    A task then orders its short keys in memory, however large the table is.
    """
    parts = -(-rows // most)
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(parts, *keys)


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column, name: str, sums: dict | None = None, chunk: int = CHUNK,
    counted: DataFrame | None = None, undealt: bool = False,
) -> DataFrame:
    """0-based position of each row in its key's order, and inclusive running sums (name -> column) along it.

    `bucket` must not decrease along the order. Keys of at most `chunk` rows are ranked by themselves. Rows of longer
    ones are ranked inside (keys, bucket) and shifted by the totals of all earlier buckets, which are one row per
    bucket; there are few longer keys, at most one for each `chunk` rows, so they are broadcast. Without longer keys
    the rows stay dealt by `keys`, so that later steps by them need no shuffle. `counted` may name a cheaper table with
    the same rows for each key. `undealt` says that the rows do not lie by `keys` yet: short keys are then dealt into parts that
    a task orders in memory.
    """
    keys, sums = list(keys), dict(sums or {})
    counted = df if counted is None else counted
    crowded = maybe_long(counted, keys, chunk) if undealt else counted
    long = None if crowded is None else long_keys(crowded, keys, chunk)
    if long is None:
        df = dealt(df, keys, counted.count()) if undealt else df
        whole = Window.partitionBy(*keys).orderBy(*order)
        so_far = whole.rowsBetween(Window.unboundedPreceding, 0)
        extra = [F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(s) for s, c in sums.items()]
        return df.select(*[c for c in df.columns if c != name], (F.row_number().over(whole) - 1).cast("bigint").alias(name), *extra)
    long = F.broadcast(long)
    src = df.join(long, keys, "left").withColumn("_b", F.when(F.col("_long"), bucket)).drop("_long")
    totals = df.join(long, keys).withColumn("_b", bucket).groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_n_{s}") for s, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select(
        *keys, "_b", earlier("_n").alias("_off"), *[earlier(f"_n_{s}").alias(f"_off_{s}") for s in sums])
    local = Window.partitionBy(*keys, "_b").orderBy(*order)
    run = local.rowsBetween(Window.unboundedPreceding, 0)
    ranked = src.select("*", F.row_number().over(local).alias("_r"), *[F.sum(c).over(run).alias(f"_l_{s}") for s, c in sums.items()])
    out = ranked.join(offsets, [*keys, "_b"], "left")
    shift = lambda c, off: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(off), F.lit(0))
    extra = [shift(f"_l_{s}", f"_off_{s}").alias(s) for s in sums]
    return out.select(*[c for c in df.columns if c != name], (shift("_r", "_off") - 1).cast("bigint").alias(name), *extra)


def with_halo(df: DataFrame, ix: str, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Copy each row to every chunk whose own rows can see it within `before` rows back or `after` ahead.

    Adds `_chunk` and `_own`; only own rows are kept after the window functions have run.
    """
    lo = F.expr(f"greatest(0, {ix} - {after}) div {chunk}")
    hi = F.expr(f"({ix} + {before}) div {chunk}")
    copied = df.withColumn("_chunk", F.explode(F.sequence(lo, hi)))
    return copied.withColumn("_own", F.col("_chunk") == F.expr(f"{ix} div {chunk}"))


def windowed(
    df: DataFrame, keys: Sequence[str], ix: str, before: int, after: int, exprs: dict, chunk: int = CHUNK
) -> DataFrame:
    """Evaluate `exprs` (name -> f(window) -> Column) over a bounded neighbourhood of each row.

    The window handed to each function is partitioned by (keys, chunk) and ordered by `ix`.
    """
    haloed = with_halo(df, ix, before, after, chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(ix)
    out = haloed.select("*", *[f(w).alias(n) for n, f in exprs.items()])
    return out.where("_own").drop("_own", "_chunk")


def prefix_sums(df: DataFrame, keys: Sequence[str], ix: str, values: dict, chunk: int = CHUNK) -> DataFrame:
    """Inclusive running sums (name -> column) along `ix`: local sums plus one offset row per chunk."""
    keys = list(keys)
    src = df.withColumn("_chunk", F.expr(f"{ix} div {chunk}"))
    totals = src.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = {n: F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values}
    offsets = totals.select(*keys, "_chunk", *zero.values())
    local = Window.partitionBy(*keys, "_chunk").orderBy(ix).rowsBetween(Window.unboundedPreceding, 0)
    summed = src.select("*", *[F.sum(c).over(local).alias(f"_l_{n}") for n, c in values.items()])
    joined = summed.join(offsets, [*keys, "_chunk"])
    extra = [(F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_o_{n}")).alias(n) for n in values]
    kept = [c for c in df.columns]
    return joined.select(*kept, *extra)


def prefix_max(df: DataFrame, keys: Sequence[str], ix: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Inclusive running maximum along `ix`, carried between chunks by one row per chunk."""
    keys = list(keys)
    src = df.withColumn("_chunk", F.expr(f"{ix} div {chunk}")).withColumn("_v", value)
    tops = src.groupBy(*keys, "_chunk").agg(F.max("_v").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_chunk", F.max("_t").over(earlier).alias("_o"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(ix).rowsBetween(Window.unboundedPreceding, 0)
    out = src.withColumn("_l", F.max("_v").over(local)).join(carried, [*keys, "_chunk"])
    return out.withColumn(name, F.greatest("_l", "_o")).drop("_chunk", "_v", "_l", "_o")


def coalesce_runs(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start_ix",
    end: str = "end_ix",
    max_gap=0,
    measures: dict | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Join disjoint half-open intervals of a key whose gap is at most `max_gap`.

    Returns (keys, start, end, n_parts, measures...). `measures` maps a name to (first-level aggregate,
    merge function of a column). Only the first and last run of each chunk can reach over its edge, so the
    second pass orders two rows per chunk.
    """
    keys = list(keys)
    measures = dict(measures or {})
    measures["n_parts"] = (F.count(F.lit(1)), F.sum)
    src = df.withColumn("_chunk", F.floor(F.col(start) / F.lit(chunk)).cast("bigint"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(start)
    opens = F.lag(end).over(w).isNull() | (F.col(start) - F.lag(end).over(w) > F.lit(max_gap))
    sess = src.withColumn("_new", opens.cast("int")).withColumn(
        "_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    local = sess.groupBy(*keys, "_chunk", "_s").agg(
        F.min(start).alias(start), F.max(end).alias(end), *[m[0].alias(n) for n, m in measures.items()]
    )
    last = F.max("_s").over(Window.partitionBy(*keys, "_chunk"))
    parts = local.withColumn("_last", last).withColumn(
        "_part", F.when((F.col("_s") == 1) | (F.col("_s") == F.col("_last")), F.lit(-1)).otherwise(F.col("_chunk"))
    )
    w2 = Window.partitionBy(*keys, "_part").orderBy(start)
    opens2 = F.lag(end).over(w2).isNull() | (F.col(start) - F.lag(end).over(w2) > F.lit(max_gap))
    glued = parts.withColumn("_new", opens2.cast("int")).withColumn(
        "_g", F.sum("_new").over(w2.rowsBetween(Window.unboundedPreceding, 0))
    )
    out = glued.groupBy(*keys, "_part", "_g").agg(
        F.min(start).alias(start), F.max(end).alias(end), *[m[1](F.col(n)).alias(n) for n, m in measures.items()]
    )
    return out.drop("_part", "_g")


def flag_runs(
    df: DataFrame, keys: Sequence[str], ix: str, flag: Column, max_gap: int = 0,
    measures: dict | None = None, chunk: int = CHUNK,
) -> DataFrame:
    """Maximal runs of flagged positions, bridging unflagged gaps of at most `max_gap` positions."""
    hits = df.where(flag).withColumn("start_ix", F.col(ix)).withColumn("end_ix", F.col(ix) + 1)
    return coalesce_runs(hits, keys, max_gap=max_gap, measures=measures, chunk=chunk)
