"""Ranges: complements and tilings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK
from .ordered import coalesce_runs, dense_index, long_keys, windowed


def complement(regions: DataFrame, scopes: DataFrame, wide: int = 1 << 20, chunk: int = CHUNK) -> DataFrame:
    """What a scope holds outside its regions; touching or overlapping regions count as one, empty ones as none.

    regions: (scope_id, start_sample, end_sample); scopes: (scope_id, scope_start, scope_end). Where every scope has few
    enough regions for a task to order, a region is held against the furthest end before it; else regions become flat first.
    """
    regions = regions.where("end_sample > start_sample")
    if long_keys(regions, ["scope_id"], chunk) is None:
        w = Window.partitionBy("scope_id").orderBy("start_sample", "end_sample")
        near = regions.select("scope_id", "start_sample", F.max("end_sample").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("end_sample"),
                              F.max("end_sample").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_p"), F.lead("start_sample").over(w).alias("_n"))
    else:
        flat = coalesce_overlaps(regions, wide)
        ix = dense_index(flat, ["scope_id"], ["start_sample"], F.floor(F.col("start_sample") / wide), "_ix")
        near = windowed(ix, ["scope_id"], "_ix", 1, 1, {
            "_p": lambda w: F.lag("end_sample").over(w), "_n": lambda w: F.lead("start_sample").over(w)})
    j = near.join(scopes, "scope_id")
    before = F.struct(F.coalesce("_p", "scope_start").alias("start_sample"), F.col("start_sample").alias("end_sample"))
    after = F.when(F.col("_n").isNull(), F.struct(F.col("end_sample").alias("start_sample"), F.col("scope_end").alias("end_sample")))
    holes = j.select("scope_id", F.explode(F.array_compact(F.array(before, after))).alias("r")).select("scope_id", "r.*")
    bare = scopes.join(regions.select("scope_id").distinct(), "scope_id", "left_anti").select(
        "scope_id", F.col("scope_start").alias("start_sample"), F.col("scope_end").alias("end_sample"))
    return holes.unionByName(bare).where("end_sample > start_sample")


def coalesce_overlaps(regions: DataFrame, wide: int = 1 << 20) -> DataFrame:
    """Union of overlapping regions: covered elementary pieces between all edges, joined again.

    Edges get +1 and -1 and a running sum says what is covered, so nesting of any depth is handled.
    """
    from .ordered import prefix_sums

    edges = regions.select("scope_id", F.explode(F.array(
        F.struct(F.col("start_sample").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_sample").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    net = edges.groupBy("scope_id", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    ix = dense_index(net, ["scope_id"], ["at"], F.floor(F.col("at") / wide), "_ix")
    depth = prefix_sums(ix, ["scope_id"], "_ix", {"_depth": F.col("d")})
    nxt = windowed(depth, ["scope_id"], "_ix", 0, 1, {"_to": lambda w: F.lead("at").over(w)})
    pieces = nxt.where("_depth > 0").select("scope_id", F.col("at").alias("start_ix"), F.col("_to").alias("end_ix"))
    runs = coalesce_runs(pieces, ["scope_id"], chunk=wide)
    return runs.select("scope_id", F.col("start_ix").alias("start_sample"), F.col("end_ix").alias("end_sample"))


def tiles(ranges: DataFrame, size: int, hop: int | None = None, force_last: bool = False, chunk: int = 4096, short: bool = False) -> DataFrame:
    """Full windows of `size` at every `hop`; with `force_last` one more ends exactly at the range's end.

    Tiles are numbered chunk by chunk, so no row holds all tiles of a long range. A range shorter than a tile has
    none, or with `short` one that is the whole range and whose `complete` is false.
    """
    hop = hop or size
    last = F.col("end_sample") - size
    room = last - F.col("start_sample")
    count = F.expr(f"cast(({'ceil' if force_last else 'floor'}((end_sample - {size} - start_sample) / {hop})) as bigint)") + 1
    out = ranges.where(room >= 0).withColumn("_n", count)
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {chunk}"))))
    out = out.withColumn("_i", F.explode(F.sequence(F.col("_k") * chunk, F.least(F.col("_n"), (F.col("_k") + 1) * chunk) - 1)))
    out = out.withColumn("tile_start", F.least(last, F.col("start_sample") + F.col("_i") * hop)).drop("_n", "_k", "_i")
    out = out.withColumn("tile_end", F.col("tile_start") + size)
    if not short:
        return out
    part = ranges.where((room < 0) & (F.col("end_sample") > F.col("start_sample")))
    part = part.withColumn("tile_start", F.col("start_sample")).withColumn("tile_end", F.col("end_sample"))
    return out.withColumn("complete", F.lit(True)).unionByName(part.withColumn("complete", F.lit(False)))
