"""Scanning captures for short events and repairing the approved ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import impulses as imp
from ..operators import overlaid
from ..operators import repair as rep
from ..operators import validate as va
from ..operators.ordered import coalesce_runs
from ..session import stage


def scan_events(blocks: DataFrame, lengths: DataFrame, music: DataFrame, full_scale: float = 1.0) -> dict[str, DataFrame]:
    """All clipped runs and impulses of every capture, a summary, what the scan covered of the music, and records
    whose bounds or identity do not hold (none, unless a stage was damaged).

    blocks: the block table, blocks at least 1024 samples long; lengths: (capture_id, sample_count);
    music: (capture_id, music_start, music_end).
    """
    flat = blocks.select("capture_id", "channel", "start_sample", F.posexplode(F.transform(
        "samples", lambda x, i: F.when(F.abs(x) >= full_scale * 0.9999, x))).alias("_p", "amp")).where("amp is not null")
    hot = flat.select("capture_id", "channel", (F.col("start_sample") + F.col("_p")).alias("sample_ix"), "amp")
    clips = stage(imp.merge_channels(imp.clipped_runs(hot, ["capture_id", "channel"], full_scale)))
    found = imp.impulse_events(blocks).where(F.col("confidence") >= imp.MIN_IMPULSE_CONFIDENCE)
    hits = imp.suppress_near_clips(stage(imp.merge_channels(found)), clips)
    both = clips.withColumn("kind", F.lit("clipped")).unionByName(hits.withColumn("kind", F.lit("impulse")))
    records = stage(imp.event_records(both, lengths))
    summary = imp.scan_summary(records, records)
    reach = blocks.groupBy("capture_id").agg(F.min("start_sample").alias("scan_start"), F.max(F.col("start_sample") + F.col("n")).alias("scan_end"))
    scans = reach.join(summary.select("capture_id", "detected", "retained"), "capture_id", "left").fillna(0, ["detected", "retained"])
    return {"records": records, "summary": summary, "ledger": imp.coverage_ledger(scans, music), "invalid": imp.invalid_events(records, lengths)}


def repair_events(blocks: DataFrame, retained: DataFrame, decisions: DataFrame, block: int) -> dict[str, DataFrame]:
    """Fill the approved, repairable events and lay the patches over the blocks.

    decisions: (capture_id, event_id, decision, protected_class). A capture whose decisions are not complete is
    not repaired, nor one whose approved windows touch on a channel; the problems are listed. `outside` holds changed samples outside the patches and must be empty.
    """
    cands = retained.select(F.col("capture_id").alias("scan"), "event_id", "repairable")
    problems = (va.decision_problems(cands, decisions.withColumnRenamed("capture_id", "scan")))
    near = coalesce_runs(
        retained.join(decisions.where("decision = 'approved'").select("capture_id", "event_id"), ["capture_id", "event_id"], "left_semi").select(
            "capture_id", F.explode("channels").alias("channel"), F.col("start_frame").alias("start_ix"), F.col("end_frame").alias("end_ix")),
        ["capture_id", "channel"])
    touching = near.where("n_parts > 1").select(F.col("capture_id").alias("scan"), F.lit(None).cast("string").alias("event_id"),
                                                F.array(F.lit("repair_windows_touch")).alias("reasons")).distinct()
    problems = stage(problems.unionByName(touching))
    bad = problems.select(F.col("scan").alias("capture_id")).distinct()
    approved = retained.where("repairable").join(decisions.where("decision = 'approved'").select("capture_id", "event_id"), ["capture_id", "event_id"], "left_semi")
    approved = stage(approved.join(bad, "capture_id", "left_anti"))
    patches = stage(rep.fill_events(approved, blocks, block))
    out = stage(overlaid.overlay_blocks(blocks, patches, block))
    wins = patches.where("patch is not null").select("capture_id", "channel", F.col("start_frame").alias("start_ix"), F.col("end_frame").alias("end_ix"))
    stray = overlaid.measured_blocks(out, wins, block).where("changed_outside > 0")
    outside = stray.select("capture_id", "channel", F.explode("stray").alias("sample_ix"))
    return {"problems": problems, "patches": patches, "blocks": out.drop("original"), "outside": outside}
