"""Noise evidence and removal previews over many scopes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import impulses as imp
from ..operators import noise as nz
from ..operators import overlaid
from ..operators import regions as rg
from ..operators import spectral as sx
from ..session import stage
from ..sources.blocks import to_blocks


def evidence_windows(references: DataFrame, scopes: DataFrame, window: int, short: bool = False) -> DataFrame:
    """Windows of the reference regions, and of the program: what the scope holds outside them. The last window of a
    region ends with it, so every sample of a region that holds a window is measured.

    references: (capture_id, label, start_sample, end_sample); scopes: (capture_id, scope_start, scope_end).
    """
    ref = references.select("capture_id", F.col("label").alias("region"), F.lit("reference").alias("role"), "start_sample", "end_sample")
    hole = rg.complement(references.withColumnRenamed("capture_id", "scope_id"), scopes.withColumnRenamed("capture_id", "scope_id"))
    prog = hole.select(F.col("scope_id").alias("capture_id"), F.lit("program").alias("region"), F.lit("program").alias("role"), "start_sample", "end_sample")
    t = rg.tiles(ref.unionByName(prog), window, window, True, short=short)
    return t.select("capture_id", "region", "role", F.col("tile_start").alias("start_ix"), F.col("tile_end").alias("end_ix"), *["complete"] * short)


def unmeasured(short: DataFrame, partial: DataFrame, scopes: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """`regions`: what could not be measured, (capture_id, region, role, reason); `settled`: the captures that abstain
    for it, since a reference is short or a window of one has a hole, or nothing at all was measured."""
    key = ["capture_id", "region", "role"]
    listed = short.select(*key, F.lit("region_shorter_than_window").alias("reason")).unionByName(
        partial.select(*key, F.lit("window_incomplete").alias("reason"))).distinct()
    bare = scopes.select("capture_id").distinct().join(evidence.select("capture_id").distinct(), "capture_id", "left_anti")
    why = listed.where("role = 'reference'").select("capture_id", "reason").unionByName(
        bare.join(listed.select("capture_id", "reason"), "capture_id", "left").select("capture_id", F.coalesce("reason", F.lit("no_samples_in_scope")).alias("reason")))
    return {"regions": listed, "settled": why.groupBy("capture_id").agg(F.min("reason").alias("global_reason"))}


def noise_evidence(blocks: DataFrame, references: DataFrame, scopes: DataFrame, rate: int, window: int, block: int) -> dict[str, DataFrame]:
    """Hum and rumble evidence per region and channel, and one decision each per capture."""
    if not sx.resolves_mains(rate, window):
        raise ValueError(f"windows of {window} samples at {rate} a second have no bin at a mains line")
    w = stage(evidence_windows(references, scopes, window, short=True))
    planned = w.where("complete").drop("complete")
    found = stage(sx.cut_windows(blocks, planned, block, ["region", "role"], partial=True))
    cut = found.where("complete").drop("complete")
    hum = stage(nz.hum_evidence(sx.measured(cut, sx.hum_features(rate), sx.HUM_SCHEMA)))
    rumble = stage(nz.rumble_evidence(sx.measured(cut, sx.rumble_features(rate), sx.RUMBLE_SCHEMA)))
    key = ["capture_id", "region", "role", "start_ix", "end_ix"]
    holes = planned.join(found.where("complete").select(key).distinct(), key, "left_anti").unionByName(found.where("not complete").select(key))
    missing = unmeasured(w.where("not complete"), holes, scopes, hum)
    settled = nz.global_reasons(blocks, scopes).join(missing["settled"].withColumnRenamed("global_reason", "_m"), "capture_id", "full")
    settled = stage(settled.select("capture_id", F.coalesce("global_reason", "_m").alias("global_reason")))
    return {"hum_evidence": hum, "rumble_evidence": rumble, "hum": nz.unless_settled(nz.decide_hum(hum), settled),
            "rumble": nz.unless_settled(nz.decide_rumble(rumble), settled), "unmeasured": missing["regions"]}


def hiss_evidence(blocks: DataFrame, references: DataFrame, rate: int, window: int, block: int, clipping: float = 0.999,
                  lower: float = 6000.0, upper: float = 18000.0) -> dict[str, DataFrame]:
    """Reference windows only, in the band from `lower` to `upper` Hz; a clipped sample anywhere in the capture invalidates it."""
    ref = references.select("capture_id", F.col("label").alias("region"), F.lit("reference").alias("role"), "start_sample", "end_sample")
    t = rg.tiles(ref, window, window, True).select("capture_id", "region", "role", F.col("tile_start").alias("start_ix"), F.col("tile_end").alias("end_ix"))
    cut = sx.cut_windows(blocks, t, block, ["region", "role"])
    ev = stage(nz.hiss_evidence(stage(sx.measured(cut, sx.hiss_features(rate, lower, upper), sx.HISS_SCHEMA))))
    clipped = blocks.groupBy("capture_id").agg(F.max(F.exists("samples", lambda x: F.abs(x) >= clipping)).alias("clipped"))
    return {"evidence": ev, "decision": nz.decide_hiss(ev, clipped)}


def crackle_evidence(blocks: DataFrame, references: DataFrame, scopes: DataFrame, rate: int) -> DataFrame:
    """Conservative impulses (12 sigma, at most 8 samples) in the scope, against those inside the references."""
    ev = stage(imp.merge_channels(imp.impulse_events(blocks, sigma=12.0, min_ratio=0.35).where("end_ix - start_ix <= 8")))
    n = blocks.groupBy("capture_id").agg((F.max("channel") + 1).alias("channel_count"))
    ref = references.select("capture_id", F.col("start_sample").alias("start_ix"), F.col("end_sample").alias("end_ix"))
    return nz.crackle_metrics(ev, ref, scopes.join(n, "capture_id"), rate)


def preview_hum(samples: DataFrame, blocks: DataFrame, references: DataFrame, scopes: DataFrame, frequencies: list[float], rate: int,
                window: int, block: int, fade: int) -> dict[str, DataFrame]:
    """Fit the lines on the references, subtract them in the scope, and report what was removed.

    `laid` are the blocks of the samples with `original` beside the cleaned ones, `samples` their rows.
    """
    ref = rg.tiles(references, window, window, True).select("capture_id", F.col("tile_start").alias("start_ix"), F.col("tile_end").alias("end_ix"))
    lines = stage(nz.fit_lines(sx.cut_windows(blocks, ref, block, []), frequencies, rate))
    laid = stage(overlaid.remove_lines(to_blocks(samples, block), lines, scopes, rate, fade))
    out = overlaid.sample_rows(laid)
    return {"lines": lines, "laid": laid, "samples": out, "metrics": nz.removal_metrics(out), "loudness": nz.loudness_match(out, window)}


def preview_rumble(blocks: DataFrame, scopes: DataFrame, rate: int, block: int, cutoff: float = 12.0, order: int = 2,
                   pad_seconds: float = 2.0, fade: int = 64) -> DataFrame:
    w = scopes.select("capture_id", F.col("scope_start").alias("start_ix"), F.col("scope_end").alias("end_ix"))
    return nz.high_pass(sx.cut_windows(blocks, w, block, []), rate, cutoff, order, round(pad_seconds * rate), fade)


def preview_hiss(blocks: DataFrame, references: DataFrame, scopes: DataFrame, rate: int, block: int, lower: float, upper: float,
                 frame: int = 2048, hop: int = 512, fade_ms: float = 100.0) -> DataFrame:
    """Removed signal of gentle spectral subtraction, from the references' median spectrum: (capture_id, channel,
    sample_ix, removed). Scopes are worked on in stretches of a block, which bring the frames over their edges along."""
    tile = rg.tiles(references, frame, hop, True).select("capture_id", F.col("tile_start").alias("start_ix"), F.col("tile_end").alias("end_ix"))
    psd = stage(nz.reference_psd(sx.cut_windows(blocks, tile, block, [])))
    w = overlaid.stretches(scopes, frame, hop, max(block, 4 * frame))
    cut = sx.cut_windows(blocks, w, block, ["scope_start", "scope_end", "own_start", "own_end"])
    out = nz.subtract_noise(cut, psd, rate, lower, upper, frame, hop, round(rate * fade_ms / 1000))
    return out.select("capture_id", "channel", "own_start", F.posexplode("removed").alias("_i", "removed")).select(
        "capture_id", "channel", (F.col("own_start") + F.col("_i")).alias("sample_ix"), "removed")


def preview_crackle(blocks: DataFrame, evidence: DataFrame, events: DataFrame, block: int) -> dict[str, DataFrame]:
    """Patches for the events of captures whose crackle evidence was accepted, laid over the blocks, and one gated
    render a capture: what changed, the gains for listening, and accepted or refused with reasons. A capture whose
    events all failed to fill is refused."""
    from ..operators import repair as rep

    ok = evidence.where("status = 'proposed'").select("capture_id")
    e = events.join(ok, "capture_id", "left_semi").select(
        "capture_id", F.concat_ws("-", "start_ix", "end_ix").alias("event_id"), F.col("start_ix").alias("start_frame"), F.col("end_ix").alias("end_frame"), "channels")
    patches = stage(rep.fill_events(e, blocks, block, 256, 16))
    laid = stage(overlaid.overlay_blocks(blocks.join(ok, "capture_id", "left_semi"), patches, block))
    windows = e.select("capture_id", F.explode("channels").alias("channel"), F.col("start_frame").alias("start_ix"), F.col("end_frame").alias("end_ix"))
    render = overlaid.gated_render(overlaid.render_metrics(laid, windows, block))
    return {"patches": patches, "laid": laid, "render": render}
