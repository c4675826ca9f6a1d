"""Sample-level event detection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK
from .intervals import overlapping
from .ordered import coalesce_runs, windowed


def derivatives(samples: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """First difference (0 at the start) and second-difference magnitude (null at both ends)."""
    exprs = {"_p": lambda w: F.lag("amp").over(w), "_f": lambda w: F.lead("amp").over(w)}
    out = windowed(samples, keys, "sample_ix", 1, 1, exprs, chunk)
    return (
        out.withColumn("derivative", F.col("amp") - F.coalesce("_p", "amp"))
        .withColumn("curvature", F.abs((F.col("amp") - F.col("_p")) - (F.col("_f") - F.col("amp"))))
        .withColumn("before", F.col("_p")).withColumn("after", F.col("_f")).drop("_p", "_f")
    )


# Fixed values of event detection.
CLIP_PADDING = 16
MAX_EVENT = 128
MAX_IMPULSE = 16
MIN_IMPULSE_CONFIDENCE = 0.15
HALO = 1024


def group_events(flagged: DataFrame, keys: list[str], max_gap: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Flagged samples (keys, sample_ix, score) to half-open events; the peak is the first best score."""
    peak = F.max(F.struct(F.col("score"), (-F.col("sample_ix")).alias("neg_ix")))
    src = flagged.withColumn("start_ix", F.col("sample_ix")).withColumn("end_ix", F.col("sample_ix") + 1)
    runs = coalesce_runs(src, keys, max_gap=max_gap, measures={"_peak": (peak, F.max)}, chunk=chunk)
    return runs.select(
        *keys, "start_ix", "end_ix", (-F.col("_peak.neg_ix")).alias("peak_ix"), F.col("_peak.score").alias("confidence")
    )


def clipped_runs(
    samples: DataFrame, keys: list[str], full_scale: float = 1.0, ratio: float = 0.9999,
    max_gap: int = 16, chunk: int = CHUNK,
) -> DataFrame:
    """Runs at full scale, bridging up to `max_gap` samples. Long ones stay events; event_records() says which can be
    repaired."""
    hot = samples.where(F.abs("amp") >= full_scale * ratio)
    scored = hot.withColumn("score", F.least(F.lit(1.0), F.abs("amp") / full_scale))
    return group_events(scored, keys, max_gap, chunk)


def merge_channels(events: DataFrame, keys: list[str] = ["capture_id"]) -> DataFrame:
    """Events of several channels with the very same bounds become one: best confidence, earliest peak."""
    best = F.max(F.struct(F.col("confidence"), (-F.col("peak_ix")).alias("neg_ix")))
    out = events.groupBy(*keys, "start_ix", "end_ix").agg(
        best.alias("_b"), F.array_sort(F.collect_set("channel")).alias("channels")
    )
    return out.select(
        *keys, "start_ix", "end_ix", (-F.col("_b.neg_ix")).alias("peak_ix"), F.col("_b.confidence").alias("confidence"),
        "channels",
    )


def haloed_blocks(blocks: DataFrame, halo: int = HALO) -> DataFrame:
    """Blocks with up to `halo` samples of each neighbour: (own_start, own_end, first_sample, samples).

    Only the edge slices travel to the neighbour block; blocks must be at least `halo` long.
    """
    size = F.col("n")
    piece = lambda block, start, xs: F.struct(
        block.alias("block_ix"), start.cast("bigint").alias("start"), xs.alias("xs"))
    tail_n = F.least(F.lit(halo), size)
    sent = blocks.select(
        "capture_id", "channel",
        F.explode(F.array(
            piece(F.col("block_ix"), F.col("start_sample"), F.col("samples")),
            piece(F.col("block_ix") + 1, F.col("start_sample") + size - tail_n,
                  F.slice("samples", size - tail_n + 1, tail_n)),
            piece(F.col("block_ix") - 1, F.col("start_sample"), F.slice("samples", F.lit(1), tail_n)),
        )).alias("p"),
        (F.col("block_ix")).alias("_from"),
        F.col("start_sample").alias("_s"), (F.col("start_sample") + size).alias("_e"),
    )
    own = F.col("p.block_ix") == F.col("_from")
    got = sent.groupBy("capture_id", "channel", F.col("p.block_ix").alias("block_ix")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("p.start").alias("start"), F.col("p.xs").alias("xs")))).alias("_ps"),
        F.max(F.when(own, F.col("_s"))).alias("own_start"), F.max(F.when(own, F.col("_e"))).alias("own_end"),
    )
    return got.where("own_start is not null").select(
        "capture_id", "channel", "block_ix", "own_start", "own_end",
        F.element_at("_ps", 1)["start"].alias("first_sample"),
        F.flatten(F.transform("_ps", lambda x: x["xs"])).alias("samples"),
    )


def local_median_mad(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and MAD of centred windows at every quarter window and at the end, interpolated between."""
    half = window // 2
    at = np.unique(np.r_[np.arange(0, values.size, max(1, window // 4)), values.size - 1])
    offsets = np.abs(at[:, None] + np.arange(-half, half + 1)[None, :])
    if values.size > 1:
        period = 2 * (values.size - 1)
        folded = offsets % period
        offsets = np.where(folded >= values.size, period - folded, folded)
    else:
        offsets = np.zeros_like(offsets)
    near = values[offsets]
    mid = np.median(near, axis=1)
    spread = np.median(np.abs(near - mid[:, None]), axis=1)
    everywhere = np.arange(values.size)
    return np.interp(everywhere, at, mid), np.interp(everywhere, at, spread)


def impulse_scores(x: np.ndarray, sigma: float = 10.0, window: int = 65, min_ratio: float = 0.25) -> np.ndarray:
    """Confidence per sample, 0 where the sample is no two-sided excursion above its local threshold."""
    score = np.zeros(x.size)
    if x.size < 3:
        return score
    step = np.diff(x)
    rise, fall = step[:-1], step[1:]
    bend = np.abs(rise - fall)
    mid, spread = local_median_mad(bend, window)
    tiny = np.finfo(float).eps * 32.0 * max(1.0, np.abs(x).max())
    limit = mid + sigma * np.maximum(1.4826 * spread, tiny)
    small, large = np.minimum(np.abs(rise), np.abs(fall)), np.maximum(np.abs(rise), np.abs(fall))
    two_sided = (rise * fall < 0) & (large > tiny) & (small >= min_ratio * large)
    hit = two_sided & (bend > limit)
    score[1:-1][hit] = np.clip(1.0 - limit[hit] / bend[hit], 0.0, 1.0)
    return score


def impulse_events(
    blocks: DataFrame, halo: int = HALO, sigma: float = 10.0, min_ratio: float = 0.25
) -> DataFrame:
    """Impulses per channel from the block table; an event belongs to the block that owns its peak. Those over
    MAX_IMPULSE samples stay events that cannot be repaired."""

    def scan(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                score = impulse_scores(np.asarray(r.samples), sigma, min_ratio=min_ratio)
                hit = np.flatnonzero(score)
                for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                    if not run.size:
                        continue
                    peak = run[np.argmax(score[run])]
                    if r.own_start <= r.first_sample + peak < r.own_end:
                        rows.append((r.capture_id, r.channel, r.first_sample + run[0], r.first_sample + run[-1] + 1,
                                     r.first_sample + peak, score[peak]))
            yield pd.DataFrame(rows, columns=["capture_id", "channel", "start_ix", "end_ix", "peak_ix", "confidence"])

    schema = "capture_id string, channel int, start_ix bigint, end_ix bigint, peak_ix bigint, confidence double"
    return haloed_blocks(blocks, halo).mapInPandas(scan, schema)


def suppress_near_clips(impulses: DataFrame, clips: DataFrame, padding: int = CLIP_PADDING, bucket: int = 4096) -> DataFrame:
    """Drop an impulse when a clipped run on a channel they share lies within `padding` samples."""
    imp = impulses.withColumn("channel", F.explode("channels"))
    clip = clips.select(
        "capture_id", F.explode("channels").alias("channel"),
        (F.col("start_ix") - padding).alias("r_start"), (F.col("end_ix") + padding).alias("r_end"),
    )
    hit = overlapping(imp, clip, ["capture_id", "channel"], bucket).select("capture_id", "start_ix", "end_ix").distinct()
    return impulses.join(hit, ["capture_id", "start_ix", "end_ix"], "left_anti")


def event_id(source, kind, start, end, peak, channels):
    """clk- and 20 hex digits of the hash of the event's identity, keys in order."""
    text = F.format_string(
        '{"channels":[%s],"detector":"impulse-scan","end_frame_exclusive":%d,"peak_frame":%d,'
        '"source_sha256":"%s","start_frame":%d,"type":"%s"}',
        F.array_join(channels.cast("array<string>"), ","), end, peak, source, start, kind,
    )
    return F.concat(F.lit("clk-"), F.substring(F.sha2(text, 256), 1, 20))


def event_records(events: DataFrame, lengths: DataFrame, padding: int = CLIP_PADDING) -> DataFrame:
    """Repair window, repairability and identity of each event (with `kind`); lengths: (capture_id, sample_count)."""
    e = events.join(lengths, "capture_id")
    pad = F.when(F.col("kind") == "clipped", F.lit(padding)).otherwise(F.lit(0))
    e = e.withColumn("start_frame", F.greatest(F.lit(0), F.col("start_ix") - pad)).withColumn(
        "end_frame", F.least("sample_count", F.col("end_ix") + pad)
    )
    ok = (
        (F.col("start_frame") >= 1) & (F.col("end_frame") < F.col("sample_count"))
        & (F.col("start_frame") <= F.col("peak_ix")) & (F.col("peak_ix") < F.col("end_frame"))
        & (F.col("end_frame") - F.col("start_frame") <= MAX_EVENT)
        & ((F.col("kind") != "impulse") | (F.col("end_ix") - F.col("start_ix") <= MAX_IMPULSE))
    )
    ident = event_id(
        F.sha2("capture_id", 256), F.col("kind"), F.col("start_frame"), F.col("end_frame"), F.col("peak_ix"), F.col("channels")
    )
    return e.select(
        "capture_id", "kind", ident.alias("event_id"), F.col("start_ix").alias("detected_start"),
        F.col("end_ix").alias("detected_end"), "start_frame", "end_frame", F.col("peak_ix").alias("peak_frame"),
        "channels", F.bround("confidence", 8).alias("confidence"), ok.alias("repairable"),
    )


def top_events(records: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """The best k events per capture (clipped first, confidence, earlier start, id), first per salt, then overall."""
    order = [
        (F.col("kind") == "clipped").desc(), F.col("confidence").desc(), F.col("start_frame").asc(), F.col("event_id").desc()
    ]
    salted = records.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)))
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy("capture_id", "_salt").orderBy(*order)))
    best = some.where(F.col("_r") <= k).withColumn(
        "_r", F.row_number().over(Window.partitionBy("capture_id").orderBy(*order))
    )
    return best.where(F.col("_r") <= k).drop("_r", "_salt")


def scan_summary(records: DataFrame, retained: DataFrame) -> DataFrame:
    found = records.groupBy("capture_id").agg(F.count(F.lit(1)).alias("detected"))
    kept = retained.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("retained"),
        F.count_if(F.col("kind") == "clipped").alias("clipped"),
        F.count_if(F.col("kind") == "impulse").alias("impulse"),
        F.count_if("repairable").alias("repairable"),
    )
    return found.join(kept, "capture_id").withColumn("truncated", F.col("detected") > F.col("retained"))


def coverage_ledger(scans: DataFrame, music: DataFrame) -> DataFrame:
    """What a scan covered of the music: scans (capture_id, scan_start, scan_end, detected, retained),
    music (capture_id, music_start, music_end)."""
    j = scans.join(music, "capture_id")
    covered = F.greatest(
        F.lit(0), F.least("scan_end", "music_end") - F.greatest("scan_start", "music_start")
    )
    whole = (F.col("scan_start") <= F.col("music_start")) & (F.col("scan_end") >= F.col("music_end"))
    lead = F.when(
        F.col("scan_start") > F.col("music_start"),
        F.struct(F.col("music_start").alias("start_frame"), F.least("scan_start", "music_end").alias("end_frame")),
    )
    rest = F.when(
        F.col("scan_end") < F.col("music_end"),
        F.struct(F.greatest("scan_end", "music_start").alias("start_frame"), F.col("music_end").alias("end_frame")),
    )
    complete = whole & (F.col("detected") <= F.col("retained"))
    return j.select(
        "capture_id", (F.col("music_end") - F.col("music_start")).alias("music_frames"),
        covered.alias("scanned_frames"),
        (covered * 100.0 / (F.col("music_end") - F.col("music_start"))).alias("scanned_percent"),
        (F.col("detected") > F.col("retained")).alias("truncated"),
        F.array_compact(F.array(lead, rest)).alias("unreviewed"),
        F.when(complete, "complete").when(covered > 0, "partial").otherwise("exploratory").alias("status"),
    )


def invalid_events(records: DataFrame, lengths: DataFrame) -> DataFrame:
    """Stored events whose bounds, channel order or identity do not hold, with the reasons."""
    r = records.join(lengths, "capture_id")
    again = event_id(
        F.sha2("capture_id", 256), F.col("kind"), F.col("start_frame"), F.col("end_frame"), F.col("peak_frame"), F.col("channels")
    )
    reasons = F.array_compact(F.array(
        F.when(
            (F.col("start_frame") < 0) | (F.col("end_frame") <= F.col("start_frame")) | (F.col("end_frame") > F.col("sample_count")),
            "bounds_invalid"),
        F.when((F.col("peak_frame") < F.col("start_frame")) | (F.col("peak_frame") >= F.col("end_frame")), "peak_outside"),
        F.when(F.array_sort(F.array_distinct("channels")) != F.col("channels"), "channels_invalid"),
        F.when(again != F.col("event_id"), "identity_mismatch"),
    ))
    return r.withColumn("reasons", reasons).where(F.size("reasons") > 0)
