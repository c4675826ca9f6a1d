"""Music bounds, quiet-gap candidates and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SegmentSettings
from ..functions.levels import clip, seconds_to_sample
from .intervals import points_in
from .ordered import coalesce_runs, flag_runs


def sustained_runs(env: DataFrame, levels: DataFrame, cfg: SegmentSettings) -> DataFrame:
    """Runs above the active and above the boundary (silence) threshold that last long enough."""
    rows = env.join(levels.select("capture_id", "silence_db", "active_db", "windows"), "capture_id")
    kinds = F.array_compact(F.array(
        F.when(F.col("db") > F.col("active_db"), F.lit("core")),
        F.when(F.col("db") > F.least("active_db", "silence_db"), F.lit("edge")),
    ))
    hits = rows.select("capture_id", "win_ix", "windows", F.explode(kinds).alias("kind"))
    runs = flag_runs(
        hits, ["capture_id", "kind"], "win_ix", F.lit(True),
        measures={"windows": (F.max("windows"), F.max)}, chunk=cfg.chunk,
    )
    long_enough = F.col("end_ix") - F.col("start_ix") >= F.least(F.lit(cfg.active_run_windows), F.col("windows"))
    return runs.where(long_enough)


def music_bounds(env: DataFrame, levels: DataFrame, durations: DataFrame, cfg: SegmentSettings) -> DataFrame:
    """Core and padded music bounds in seconds per capture; no row where nothing sustained is found.

    `durations` is (capture_id, duration_seconds). The louder threshold proves that there is music; the
    lower one then sets the edges.
    """
    runs = sustained_runs(env, levels, cfg)
    edges = runs.groupBy("capture_id").agg(
        F.max(F.when(F.col("kind") == "core", 1).otherwise(0)).alias("_core"),
        F.min(F.when(F.col("kind") == "edge", F.col("start_ix"))).alias("_first"),
        F.max(F.when(F.col("kind") == "edge", F.col("end_ix"))).alias("_end"),
    ).where("_core = 1")
    ws = cfg.window_seconds
    e = edges.join(durations, "capture_id")
    core_start = F.greatest(F.lit(0.0), F.col("_first") * ws)
    core_end = F.least(F.col("duration_seconds"), F.col("_end") * ws)
    e = e.withColumn("core_start", core_start).withColumn("core_end", core_end).where("core_end > core_start")
    return e.select(
        "capture_id", "duration_seconds", "core_start", "core_end",
        F.greatest(F.lit(0.0), F.col("core_start") - cfg.lead_in_seconds).alias("music_start"),
        F.least("duration_seconds", F.col("core_end") + cfg.tail_seconds).alias("music_end"),
    )


def quiet_runs(env: DataFrame, levels: DataFrame, bounds: DataFrame, cfg: SegmentSettings) -> DataFrame:
    """Quiet runs inside the music, with short loud interruptions bridged, at least the minimum gap long."""
    ws = cfg.window_seconds
    lims = bounds.join(levels.select("capture_id", "silence_db", "windows"), "capture_id").select(
        "capture_id", "silence_db", "music_start", "music_end",
        F.greatest(F.lit(0), F.floor(F.col("music_start") / ws)).cast("bigint").alias("lo_ix"),
        F.least("windows", F.ceil(F.col("music_end") / ws)).cast("bigint").alias("hi_ix"),
    )
    rows = env.select("capture_id", "win_ix", "db").join(lims, "capture_id")
    quiet = (F.col("db") < F.col("silence_db")) & (F.col("win_ix") >= F.col("lo_ix")) & (F.col("win_ix") < F.col("hi_ix"))
    carry = {c: (F.max(c), F.max) for c in ("silence_db", "music_start", "music_end", "lo_ix", "hi_ix")}
    runs = flag_runs(rows, ["capture_id"], "win_ix", quiet, cfg.bridge_windows, carry, cfg.chunk)
    return runs.where(F.col("end_ix") - F.col("start_ix") >= cfg.min_gap_windows)


def gap_candidates(env: DataFrame, runs: DataFrame, cfg: SegmentSettings, rate: int | None = None) -> DataFrame:
    """Statistics, cut point, contrast and score of each quiet run.

    Windows meet their run through a bucketed range join, first with the context padding, then once more
    for the windows near the minimum; a run as long as the capture still spreads over its buckets.
    """
    rate = rate or cfg.rate
    ws, ctx = cfg.window_seconds, cfg.context_windows
    slim = env.select("capture_id", "win_ix", "db")
    padded = runs.drop("n_parts").withColumnRenamed("start_ix", "run_start").withColumnRenamed("end_ix", "run_end")
    padded = padded.withColumn("start_ix", F.greatest("lo_ix", F.col("run_start") - ctx)).withColumn(
        "end_ix", F.least("hi_ix", F.col("run_end") + ctx)
    )
    near = points_in(slim, padded, ["capture_id"], "win_ix")
    within = (F.col("win_ix") >= F.col("run_start")) & (F.col("win_ix") < F.col("run_end"))
    stats = near.groupBy(
        "capture_id", "run_start", "run_end", "silence_db", "music_start", "music_end"
    ).agg(
        F.min(F.when(within, F.col("db"))).alias("minimum_db"),
        F.avg(F.when(within, F.col("db"))).alias("mean_db"),
        F.avg(F.when(~within, F.col("db"))).alias("_context"),
    )
    again = stats.withColumn("start_ix", F.col("run_start")).withColumn("end_ix", F.col("run_end"))
    low = points_in(slim, again, ["capture_id"], "win_ix").where(F.col("db") <= F.col("minimum_db") + 3.0)
    local = F.col("win_ix") - F.col("run_start")
    middle = (F.col("run_end") - F.col("run_start") - 1) / 2.0
    cut = low.groupBy(
        "capture_id", "run_start", "run_end", "silence_db", "music_start", "music_end", "minimum_db", "mean_db", "_context"
    ).agg(F.min(F.struct(F.abs(local - middle).alias("d"), F.col("win_ix").alias("ix")))["ix"].alias("cut_ix"))
    cut = cut.withColumn("cut_seconds", F.least("music_end", (F.col("cut_ix") + 0.5) * ws)).where(
        (F.col("cut_seconds") - F.col("music_start") >= cfg.min_track_seconds)
        & (F.col("music_end") - F.col("cut_seconds") >= cfg.min_track_seconds)
    )
    cut = cut.withColumn("duration_seconds", (F.col("run_end") - F.col("run_start")) * ws).withColumn(
        "contrast_db",
        F.greatest(F.lit(0.0), F.coalesce("_context", "silence_db") - F.col("mean_db")),
    )
    return cut.withColumn("score", gap_score(cfg)).select(
        "capture_id",
        F.col("run_start").alias("start_ix"), F.col("run_end").alias("end_ix"), "cut_ix",
        (F.col("run_start") * ws).alias("start_seconds"),
        F.least("music_end", F.col("run_end") * ws).alias("end_seconds"),
        "cut_seconds",
        seconds_to_sample(F.col("cut_seconds"), F.lit(rate)).alias("cut_sample"),
        "duration_seconds", "minimum_db", "mean_db", "contrast_db", "score",
    )


def gap_score(cfg: SegmentSettings):
    """Weighted duration, depth and contrast, in 0..1; the weights are fixed values."""
    span = max(0.5, 3.0 - cfg.min_gap_seconds)
    long = clip((F.least(F.col("duration_seconds"), F.lit(cfg.max_gap_seconds)) - cfg.min_gap_seconds) / span, 0, 1)
    deep = clip((F.col("silence_db") - F.col("minimum_db")) / 20.0, 0, 1)
    even = clip((F.col("silence_db") - F.col("mean_db")) / 12.0, 0, 1)
    clear = clip(F.col("contrast_db") / 20.0, 0, 1)
    return clip(0.15 + 0.25 * long + 0.20 * deep + 0.20 * even + 0.20 * clear, 0, 1)


def joined_side_gaps(cands: DataFrame, max_break: float = 0.75, chunk_seconds: float = 600.0) -> DataFrame:
    """Join gaps at most `max_break` seconds apart: a side change split by a needle transient."""
    best = F.max(F.struct(F.col("score"), (-F.col("start_seconds")).alias("_neg"), F.col("cut_seconds"),
                          F.col("cut_sample"), F.col("mean_db")))
    measures = {
        "_best": (best, F.max),
        "minimum_db": (F.min("minimum_db"), F.min),
        "_weighted": (F.sum(F.col("mean_db") * F.col("duration_seconds")), F.sum),
        "_measured": (F.sum("duration_seconds"), F.sum),
        "contrast_db": (F.max("contrast_db"), F.max),
    }
    runs = coalesce_runs(cands, ["capture_id"], "start_seconds", "end_seconds", max_break, measures, chunk_seconds)
    mean = F.when(F.col("_measured") > 0, F.col("_weighted") / F.col("_measured")).otherwise(F.col("_best.mean_db"))
    return runs.select(
        "capture_id", "start_seconds", "end_seconds", F.col("_best.cut_seconds").alias("cut_seconds"),
        F.col("_best.cut_sample").alias("cut_sample"),
        F.when(F.col("n_parts") > 1, F.col("end_seconds") - F.col("start_seconds")).otherwise(F.col("_measured"))
        .alias("duration_seconds"),
        "minimum_db", mean.alias("mean_db"), "contrast_db", F.col("_best.score").alias("score"), "n_parts",
    )
