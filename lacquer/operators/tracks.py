"""Tracks: contiguity, side groups, duration targets, cumulative offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .ordered import coalesce_runs, dense_index, prefix_max, prefix_sums, windowed
from .quantiles import median

TIME_TOLERANCE = 0.010


def track_violations(tracks: DataFrame, sources: DataFrame, keys: list[str] = ["project_id"]) -> DataFrame:
    """Per track the broken rules; tracks: number, start_sample, end_sample, start_seconds, end_seconds,
    confidence; sources: sample_rate, sample_count."""
    numbered = dense_index(stage(tracks), keys, ["number", "start_sample"], F.expr("number div 4096"), "_ix")
    prev = windowed(numbered, keys, "_ix", 1, 0, {"_prev": lambda w: F.lag("end_sample").over(w)})
    j = prev.join(sources.select(*keys, "sample_rate", "sample_count"), keys)
    off = lambda s, t: F.abs(F.col(t) - F.col(s) / F.col("sample_rate")) > TIME_TOLERANCE
    reasons = F.array_compact(F.array(
        F.when(F.col("number") != F.col("_ix") + 1, "number_not_consecutive"),
        F.when((F.col("start_sample") < 0) | (F.col("end_sample") <= F.col("start_sample")), "invalid_bounds"),
        F.when(F.col("end_sample") > F.col("sample_count"), "past_source_end"),
        F.when(~F.col("confidence").between(0.0, 1.0), "confidence_out_of_range"),
        F.when(F.col("_prev").isNotNull() & (F.col("start_sample") != F.col("_prev")), "not_contiguous"),
        F.when(off("start_sample", "start_seconds"), "start_time_disagrees"),
        F.when(off("end_sample", "end_seconds"), "end_time_disagrees"),
    ))
    return j.withColumn("reasons", reasons).drop("_ix", "_prev", "sample_rate", "sample_count")


def side_islands(tracks: DataFrame, keys: list[str] = ["project_id"]) -> DataFrame:
    """Maximal runs of equal side labels over consecutive track numbers."""
    t = tracks.select(*keys, F.upper(F.trim(F.coalesce("side", F.lit("")))).alias("side"),
                      F.col("number").alias("start_ix"), (F.col("number") + 1).alias("end_ix"))
    return coalesce_runs(t, [*keys, "side"]).withColumnRenamed("n_parts", "tracks")


def side_group_status(tracks: DataFrame, keys: list[str] = ["project_id"]) -> DataFrame:
    """Per project: labels on all or no tracks, and no label that comes back after another one."""
    return _island_status(side_islands(tracks, keys), keys)


def _island_status(islands: DataFrame, keys: list[str]) -> DataFrame:
    per_label = islands.groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("n"), F.sum("tracks").alias("t"))
    agg = per_label.groupBy(*keys).agg(
        F.sum("n").alias("groups"), F.max(F.when(F.col("side") != "", F.col("n"))).alias("_most"),
        F.sum(F.when(F.col("side") == "", F.col("t")).otherwise(0)).alias("_blank"), F.sum("t").alias("tracks"),
    )
    reasons = F.array_compact(F.array(
        F.when((F.col("_blank") > 0) & (F.col("_blank") < F.col("tracks")), "labels_incomplete"),
        F.when(F.col("_most") > 1, "label_repeats"),
    ))
    return agg.select(*keys, "groups", "tracks", reasons.alias("reasons"))


def ordered_side_groups(tracks: DataFrame, keys: list[str] = ["project_id"]) -> DataFrame:
    """Side groups in order, only for projects with two or more, all labelled, none repeated."""
    islands = stage(side_islands(tracks, keys))
    good = _island_status(islands, keys).where((F.size("reasons") == 0) & (F.col("groups") >= 2)).select(*keys)
    isl = stage(islands.where("side <> ''").join(good, keys))
    ix = dense_index(isl, keys, ["start_ix"], F.expr("start_ix div 4096"), "group_ix")
    return ix.select(*keys, "group_ix", "side", "start_ix", "end_ix")


def side_durations(tracks: DataFrame, keys: list[str] = ["project_id"]) -> DataFrame:
    """Sum per side, only where every duration of the side is known."""
    return tracks.groupBy(*keys, "side").agg(
        F.count(F.lit(1)).alias("tracks"),
        F.when(F.count("duration") == F.count(F.lit(1)), F.sum("duration")).alias("duration"),
    )


def effective_durations(tracks: DataFrame, spans: DataFrame, minimum: float, keys: list[str] = ["project_id"]) -> DataFrame:
    """Fill missing durations from what remains of the span, or the known median when that is too little."""
    tracks = stage(tracks)
    agg = tracks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count("duration").alias("_k"), F.sum("duration").alias("_s"))
    mid = median(tracks, keys, "duration", "_mid")
    j = tracks.join(agg.join(spans, keys).join(mid, keys, "left"), keys)
    missing = F.col("_n") - F.col("_k")
    left = F.col("span_seconds") - F.col("_s")
    filler = F.when(left >= missing * minimum, left / missing).otherwise(F.col("_mid"))
    mode = F.when(F.col("_k") == 0, "none").when(missing == 0, "complete").otherwise("partial-imputed")
    return j.withColumn("mode", mode).withColumn(
        "effective", F.when(F.col("duration").isNotNull(), F.col("duration")).when(F.col("mode") == "partial-imputed", filler)
    ).drop("_n", "_k", "_s", "_mid", "span_seconds")


def duration_targets(tracks: DataFrame, music: DataFrame, value: str = "effective", keys: list[str] = ["project_id"]) -> DataFrame:
    """Boundary targets start + round(span * cumulative / total), one per track but the last; `tracks` is read twice."""
    total = tracks.groupBy(*keys).agg(F.sum(value).alias("_total"), F.count(F.lit(1)).alias("_n"))
    cum = prefix_sums(tracks, keys, "number", {"_cum": F.col(value)})
    j = cum.join(total, keys).join(music, keys).where("number < _n")
    span = F.col("music_end") - F.col("music_start")
    return j.select(*keys, "number", F.col("_n").alias("track_count"), "music_start", "music_end",
                    (F.col("music_start") + F.bround(span * F.col("_cum") / F.col("_total"))).cast("bigint").alias("target"))


def feasible_targets(targets: DataFrame, minimum: int, keys: list[str] = ["project_id"]) -> DataFrame:
    """Clamp each target between the previous one plus the minimum and the room the rest needs.

    Shifting by number * minimum turns the chained clamp into a running maximum under one constant ceiling.
    """
    run = prefix_max(stage(targets), keys, "number", F.col("target") - F.col("number") * minimum, "_run")
    floor_ = F.greatest(F.col("music_start"), F.col("_run"))
    ceiling = F.col("music_end") - F.col("track_count") * minimum
    return run.withColumn("feasible", (F.least(ceiling, floor_) + F.col("number") * minimum).cast("bigint")).drop("_run")


def build_tracks(selected: DataFrame, bounds: DataFrame, rate: int, short: bool = False) -> DataFrame:
    """Contiguous tracks between music start, the selected cuts and music end.

    selected: (capture_id, cut_sample, score); bounds: (capture_id, start_sample, end_sample). Cuts on the
    same sample merge to the best score; a track is as sure as its weaker edge. `short` says that a task may order the
    cuts of any capture.
    """
    b = bounds.where("end_sample > start_sample")
    inner = selected.join(b, "capture_id").where("end_sample - start_sample > 1")
    at = F.greatest(F.col("start_sample") + 1, F.least(F.col("end_sample") - 1, F.col("cut_sample")))
    cuts = inner.groupBy("capture_id", at.alias("at")).agg(F.max("score").alias("s"))
    ends = b.select("capture_id", F.explode(F.array("start_sample", "end_sample")).alias("at"), F.lit(1.0).alias("s"))
    marks, after = cuts.unionByName(ends), {"end_sample": lambda w: F.lead("at").over(w), "_s2": lambda w: F.lead("s").over(w)}
    if short:
        w = Window.partitionBy("capture_id").orderBy("at")
        nxt = marks.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("ix"), *[f(w).alias(n) for n, f in after.items()])
    else:
        marks = dense_index(stage(marks), ["capture_id"], ["at"], F.expr(f"at div {rate * 600}"), "ix")
        nxt = windowed(marks, ["capture_id"], "ix", 0, 1, after)
    return nxt.where("end_sample is not null").select(
        "capture_id", (F.col("ix") + 1).alias("number"), F.col("at").alias("start_sample"), "end_sample",
        F.least("s", "_s2").alias("confidence"))


def output_offsets(tracks: DataFrame, keys: list[str], order: Column | str = "number") -> DataFrame:
    """Running sample offsets of the output per side: where each track begins and ends once joined."""
    summed = prefix_sums(tracks.withColumn("_len", F.col("end_sample") - F.col("start_sample")), keys, "number", {"output_end": F.col("_len")})
    return summed.withColumn("output_start", F.col("output_end") - F.col("_len")).drop("_len")


def album_numbering(tracks: DataFrame) -> DataFrame:
    """Album-wide number and offset validity from text metadata: offset + local number within the declared total."""
    off = F.coalesce(F.col("track_offset").try_cast("int"), F.lit(0))
    total = F.col("track_total").try_cast("int")
    n = off + F.col("number")
    reasons = F.array_compact(F.array(
        F.when(F.col("track_offset").isNotNull() & F.col("track_offset").try_cast("int").isNull(), "offset_invalid"),
        F.when(off < 0, "offset_invalid"),
        F.when(F.col("track_total").isNotNull() & (total.isNull() | (total < 1)), "total_invalid"),
        F.when(total.isNotNull() & (n > total), "number_exceeds_total"),
    ))
    return tracks.withColumn("album_number", n).withColumn("album_total", total).withColumn("reasons", F.array_distinct(reasons))
