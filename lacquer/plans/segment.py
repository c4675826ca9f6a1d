"""From samples to tracks, and refitting tracks to a release."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK, TASK_ROWS, SegmentSettings
from ..functions.levels import seconds_to_sample
from ..operators import choice, envelope, gaps, refit
from ..operators import tracks as tr
from ..operators import validate as va
from ..operators.ordered import long_keys, maybe_long
from ..session import stage


def segment_captures(samples: DataFrame, captures: DataFrame, cfg: SegmentSettings) -> dict[str, DataFrame]:
    """Envelope, thresholds, bounds, candidates, chosen cuts and tracks of every capture.

    samples: (capture_id, sample_ix, amp); captures: (capture_id, duration_seconds). The envelope is written
    once; everything after it reads that table, not the samples. A capture in which nothing sustained is
    found becomes one track over its whole length, without candidates.
    """
    raw = envelope.rms_envelope(samples, cfg.window_samples)
    env = stage(envelope.smooth(raw, cfg.smoothing_windows, cfg.chunk).select("capture_id", "win_ix", "db"))
    levels = stage(envelope.thresholds(env, cfg.margin_db))
    bounds = stage(gaps.music_bounds(env, levels, captures, cfg))
    cands = stage(gaps.gap_candidates(env, gaps.quiet_runs(env, levels, bounds, cfg), cfg))
    chosen = choice.choose_automatic(cands, bounds, cfg)
    selected = stage(cands.join(chosen, ["capture_id", "cut_ix"]))
    whole = captures.join(bounds.select("capture_id", "music_start", "music_end"), "capture_id", "left").select(
        "capture_id",
        seconds_to_sample(F.coalesce("music_start", F.lit(0.0)), F.lit(cfg.rate)).alias("start_sample"),
        seconds_to_sample(F.coalesce("music_end", "duration_seconds"), F.lit(cfg.rate)).alias("end_sample"),
    )
    return {
        "envelope": env, "levels": levels, "bounds": bounds,
        "candidates": choice.merge_selected(cands, selected),
        "selected": selected,
        "tracks": tr.build_tracks(selected, whole, cfg.rate),
        "waveform": envelope.summarize_waveform(env, cfg.waveform_points),
    }


def segment_admitted(samples: DataFrame, captures: DataFrame, metadata: DataFrame, cfg: SegmentSettings) -> dict[str, DataFrame]:
    """segment_captures() for the captures that pass admission; the samples of the others are never looked at.

    metadata: what admission() reads, with capture_id. `rejected` has the other captures with their reasons; a capture
    without metadata is rejected too.
    """
    judged = va.admission(metadata).select("capture_id", "reasons")
    judged = captures.select("capture_id").join(judged, "capture_id", "left").withColumn(
        "reasons", F.coalesce("reasons", F.array(F.lit("capture_metadata_missing"))))
    judged = stage(judged)
    good = judged.where(F.size("reasons") == 0).select("capture_id")
    out = segment_captures(samples.join(good, "capture_id", "left_semi"), captures.join(good, "capture_id", "left_semi"), cfg)
    return {**out, "rejected": judged.where(F.size("reasons") > 0)}


def refit_topology(
    release: DataFrame, music: DataFrame, cands: DataFrame, rate: int, minimum_seconds: float, previous: DataFrame, limit: int = CHUNK
) -> dict[str, DataFrame]:
    """Fit a release's track count and durations to a side's measured gaps.

    release: (project_id, number, side, duration); music: (project_id, music_start, music_end) in samples;
    cands: (project_id, candidate_index, start_seconds, end_seconds, cut_seconds, cut_sample, duration_seconds,
    score); previous: (project_id, previous_tracks). Projects whose range cannot hold the tracks are listed in
    `refused`. The rows of a project with at most `limit` of them meet in one task, once for all steps; longer and odd
    ones go through the steps one by one.
    """
    key = ["project_id"]
    rows = refit.tagged(release, music, cands)
    each = release.select(*key).unionByName(cands.select(*key))
    crowded = maybe_long(each, key, limit)
    long = None if crowded is None else long_keys(crowded, key, limit)
    short = rows if long is None else rows.join(F.broadcast(long.select(*key)), key, "left_anti")
    parts = -(-each.count() // TASK_ROWS)
    parts = max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    done = stage(refit.refit_at_once(short, rate, minimum_seconds, parts))
    name = F.col("project_id").cast("string").alias("capture_id")
    b = done.where(F.col("boundary").isNotNull()).select(
        name, "boundary", "raw_sample", "chosen_sample", "track_count", "music_start", "music_end", F.bround("score", 6).alias("match_score"),
        F.col("candidate_index").cast(cands.schema["candidate_index"].dataType).alias("candidate_index"), "target_sample", "fitting_target", "side_change", "mode")
    whole = ["project_id", "track_count", "music_start", "music_end"]
    ok = done.where(F.col("status").isin(refit.FITTED, refit.NO_SPACING) & (F.coalesce("boundary", F.lit(1)) == 1)).select(*whole)
    refused = done.where(F.col("status").isin(refit.NO_ROOM, refit.NO_SPACING)).select(
        *key, F.when(F.col("status") == refit.NO_ROOM, "range_cannot_hold_tracks").otherwise("spacing_cannot_be_met").alias("reason"))
    boundaries = _judged(b, rate)
    bounds = done.where((F.col("status") == refit.FITTED) & (F.coalesce("boundary", F.lit(1)) == 1)).select(
        name, F.col("music_start").alias("start_sample"), F.col("music_end").alias("end_sample"))
    sure = ["capture_id", F.col("chosen_sample").alias("cut_sample"), F.col("confidence").alias("score")]
    tracks = tr.build_tracks(boundaries.select(*sure), bounds, rate, short=True)
    later = done.where(F.col("status") == refit.DEFERRED).select(*key)
    if long is not None or not later.isEmpty():
        later = stage(later if long is None else later.unionByName(long.select(*key)))
        mine = lambda df: df.join(later, key, "left_semi")
        b, more, gone, bounds = _refit_in_steps(mine(release), mine(music), mine(cands), rate, minimum_seconds)
        more_boundaries = stage(_judged(b, rate))
        tracks = tracks.unionByName(tr.build_tracks(more_boundaries.select(*sure), bounds, rate))
        boundaries, ok, refused = boundaries.unionByName(more_boundaries), ok.unionByName(more.select(*whole)), refused.unionByName(gone)
    op = ok.join(previous, key).select(*key, F.when(F.col("track_count") == F.col("previous_tracks"), "refit").when(
        F.col("track_count") > F.col("previous_tracks"), "split").otherwise("merge").alias("operation"))
    return {"boundaries": boundaries, "tracks": tracks, "operations": op, "refused": refused}


def _judged(b: DataFrame, rate: int) -> DataFrame:
    """Adds residual, warnings, confidence and uncertain to boundaries beside what they were matched with."""
    residual = (F.col("chosen_sample") - F.col("target_sample")) / F.lit(float(rate))
    b = b.withColumn("residual", residual)
    none = F.col("match_score").isNull()
    average = (F.col("music_end") - F.col("music_start")) / F.lit(float(rate)) / F.col("track_count")
    rules = {
        "no_measured_gap": none,
        "weak_gap": F.col("match_score") < 0.55,
        "side_change_without_gap": F.col("side_change") & none,
        "moved_for_spacing": F.col("chosen_sample") != F.col("raw_sample"),
        "target_projected": F.col("fitting_target") != F.col("target_sample"),
        "differs_from_duration": F.abs("residual") > F.greatest(F.lit(2.0), average * 0.08),
        "imputed_durations": F.col("mode") == "partial-imputed",
    }
    # one constant list for each set of broken rules, so that no row builds its own
    names = list(rules)
    lists = [[n for i, n in enumerate(names) if k >> i & 1] for k in range(1 << len(names))]
    table = F.array(*(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in lists))
    which = reduce(add, (F.when(rule, F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(rules.values())))
    sure = F.when(none, F.when(F.col("target_sample").isNotNull(), 0.18).otherwise(0.08)).otherwise(
        0.52 + 0.43 * F.col("match_score") + F.when(F.col("side_change"), 0.03).otherwise(0.0)
        - F.least(F.lit(0.18), F.coalesce(F.abs("residual"), F.lit(0.0)) / 120.0))
    b = b.withColumn("warnings", F.get(table, which)).withColumn("confidence", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 6))
    return b.withColumn("uncertain", (F.size("warnings") > 0) | (F.col("confidence") < 0.6))


def _refit_in_steps(
    release: DataFrame, music: DataFrame, cands: DataFrame, rate: int, minimum_seconds: float
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Boundaries to be judged, projects with room, refused ones and the bounds of the others, for projects of any length."""
    key = ["project_id"]
    minimum = int(-(-minimum_seconds * rate // 1))
    spans = music.select(*key, ((F.col("music_end") - F.col("music_start")) / rate).alias("span_seconds"))
    count = release.groupBy(*key).agg(F.count(F.lit(1)).alias("track_count"))
    room = music.join(count, key).withColumn("_fits", F.col("music_end") - F.col("music_start") >= F.col("track_count") * minimum)
    refused = room.where(~F.col("_fits")).select(*key, F.lit("range_cannot_hold_tracks").alias("reason"))
    ok = stage(room.where("_fits").select(*key, "track_count", "music_start", "music_end"))
    eff = stage(tr.effective_durations(release.join(ok.select(*key), key, "left_semi"), spans, minimum_seconds))
    known = eff.where("effective is not null")
    targets = stage(tr.feasible_targets(tr.duration_targets(known, music), minimum))
    # The fitted durations are the distances between feasible targets; a project's tracks are few (its count is declared).
    fit = targets.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("number", "feasible"))).alias("_t"))
    sides = eff.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("number", "side"))).alias("_s"))
    p = ok.join(fit, key, "left").join(sides, key)
    ends = F.concat(F.array("music_start"), F.coalesce(F.transform("_t", lambda t: t["feasible"]), F.array().cast("array<bigint>")), F.array("music_end"))
    p = p.withColumn("_ends", ends).withColumn(
        "durations", F.when(F.size("_ends") == F.col("track_count") + 1, F.transform(
            F.sequence(F.lit(1), F.col("track_count").cast("int")),
            lambda i: (F.element_at("_ends", i + 1) - F.element_at("_ends", i)) / F.lit(float(rate)))))
    sided = F.exists("_s", lambda s: F.coalesce(s["side"], F.lit("")) != "")
    params = p.select(
        F.col("project_id").cast("string").alias("capture_id"), (F.col("music_start") / rate).alias("core_start"),
        (F.col("music_end") / rate).alias("core_end"), "track_count", "durations",
        F.when(sided, F.transform("_s", lambda s: s["side"])).alias("sides"))
    near = cands.withColumn("capture_id", F.col("project_id").cast("string")).withColumn("cut_ix", F.col("candidate_index"))
    chosen = stage(choice.choose_exact_count(near, params, rate, minimum_seconds))
    short = ok.select(F.col("project_id").cast("string").alias("capture_id"), (F.col("track_count") - 1).alias("needed")).join(
        chosen.groupBy("capture_id").agg(F.count(F.lit(1)).alias("got")), "capture_id", "left").where(
        F.coalesce("got", F.lit(0)) < F.col("needed"))
    refused = refused.unionByName(short.select(F.col("capture_id").cast(refused.schema["project_id"].dataType).alias("project_id"),
                                               F.lit("spacing_cannot_be_met").alias("reason")))
    whole = chosen.join(short.select("capture_id"), "capture_id", "left_anti")
    grid = whole.join(params.select("capture_id", "track_count"), "capture_id").join(
        ok.select(F.col("project_id").cast("string").alias("capture_id"), "music_start", "music_end"), "capture_id")
    grid = tr.feasible_targets(grid.withColumn("number", F.col("boundary")).withColumn("target", F.col("cut_sample")), minimum, ["capture_id"])
    match = choice.match_candidates(
        whole, near.select("capture_id", "candidate_index", "start_seconds", "end_seconds", "duration_seconds", "cut_sample", "score"), rate
    ).withColumnRenamed("score", "match_score")
    wanted = targets.select(F.col("project_id").cast("string").alias("capture_id"), F.col("number").alias("boundary"),
                            F.col("target").alias("target_sample"), F.col("feasible").alias("fitting_target"))
    change = release.select(F.col("project_id").cast("string").alias("capture_id"), F.col("number"), F.lower(F.coalesce("side", F.lit(""))).alias("_l"))
    after = change.select("capture_id", (F.col("number") - 1).alias("boundary"), F.col("_l").alias("_r"))
    change = change.withColumnRenamed("number", "boundary").join(after, ["capture_id", "boundary"]).select(
        "capture_id", "boundary", (F.col("_l") != F.col("_r")).alias("side_change"))
    mode = eff.groupBy(F.col("project_id").cast("string").alias("capture_id")).agg(F.max("mode").alias("mode"))
    b = (
        grid.select("capture_id", "boundary", F.col("cut_sample").alias("raw_sample"), F.col("feasible").alias("chosen_sample"),
                    "track_count", "music_start", "music_end")
        .join(match.select("capture_id", "boundary", "match_score", "candidate_index"), ["capture_id", "boundary"], "left")
        .join(wanted, ["capture_id", "boundary"], "left").join(change, ["capture_id", "boundary"]).join(mode, "capture_id")
    )
    bounds = ok.select(F.col("project_id").cast("string").alias("capture_id"), F.col("music_start").alias("start_sample"), F.col("music_end").alias("end_sample"))
    return b, ok, refused, bounds.join(short.select("capture_id"), "capture_id", "left_anti")
