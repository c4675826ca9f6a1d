"""Impulses, clipped runs, suppression, repair and overlays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacquer.operators import impulses as imp
from lacquer.operators import repair as rep
from lacquer.plans.events import repair_events, scan_events
from lacquer.sources.blocks import read_range, to_blocks


def crackle(seed=713, n=16000):
    rng = np.random.default_rng(seed)
    x = 0.05 * np.sin(2 * np.pi * 40 * np.arange(n) / 8000) + rng.normal(0, 1e-4, n)
    at = np.arange(700, n - 500, 1300)
    x[at] += np.where(np.arange(at.size) % 2, -0.38, 0.42)
    return x, at


def samples(spark, chans, capture="c"):
    rows = [(capture, c, i, float(v)) for c, x in enumerate(chans) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "capture_id string, channel int, sample_ix bigint, amp double")


def test_median_mad_anchors_match_direct_computation():
    x = np.random.default_rng(1).normal(size=200)
    mid, mad = imp.local_median_mad(x, 33)
    pad = np.pad(x, 16, mode="reflect")
    for a in (0, 8, 64, 199):
        w = pad[a : a + 33]
        assert np.isclose(mid[a], np.median(w)) and np.isclose(mad[a], np.median(np.abs(w - np.median(w))))


@pytest.mark.parametrize("block", [2048, 4096, 16384])
def test_impulses_are_found_once_across_block_edges(spark, block):
    x, at = crackle()
    got = imp.impulse_events(to_blocks(samples(spark, [x]), block)).collect()
    assert sorted(r.peak_ix for r in got if r.confidence > 0.5) == at.tolist()


def test_clipped_runs_bridge_and_long_ones_stay(spark):
    x = np.zeros(2000)
    x[100:110], x[115:120], x[500:700] = 1.0, -1.0, 1.0
    got = imp.clipped_runs(samples(spark, [x]), ["capture_id", "channel"], chunk=64).collect()
    assert [(r.start_ix, r.end_ix, r.peak_ix, r.confidence) for r in got] == [(100, 120, 100, 1.0), (500, 700, 500, 1.0)]
    ev = imp.clipped_runs(samples(spark, [x]), ["capture_id", "channel"], chunk=64).withColumn("kind", F.lit("clipped")).withColumn("channels", F.array("channel"))
    rec = imp.event_records(ev, spark.createDataFrame([("c", 2000)], "capture_id string, sample_count bigint"))
    assert {(r.detected_start, r.repairable) for r in rec.collect()} == {(100, True), (500, False)}


def test_equal_bounds_merge_over_channels_and_near_clips_win(spark):
    ev = spark.createDataFrame([("c", 0, 5, 7, 5, 0.4), ("c", 1, 5, 7, 6, 0.6), ("c", 0, 50, 51, 50, 0.5), ("c", 1, 200, 201, 200, 0.5)],
                               "capture_id string, channel int, start_ix bigint, end_ix bigint, peak_ix bigint, confidence double")
    m = imp.merge_channels(ev)
    first = m.where("start_ix = 5").first()
    assert (first.peak_ix, first.confidence, first.channels) == (6, 0.6, [0, 1])
    clips = spark.createDataFrame([("c", 67, 80, [0]), ("c", 30, 34, [1]), ("c", 205, 210, [0])], "capture_id string, start_ix bigint, end_ix bigint, channels array<int>")
    left = sorted(r.start_ix for r in imp.suppress_near_clips(m, clips, bucket=8).collect())
    assert left == [5, 50, 200]
    near = clips.withColumn("start_ix", F.when(F.col("start_ix") == 67, 66).otherwise(F.col("start_ix")))
    assert sorted(r.start_ix for r in imp.suppress_near_clips(m, near, bucket=8).collect()) == [5, 200]


def test_fill_is_close_to_a_sine_and_bounded():
    t = np.arange(1200)
    x = 0.5 * np.sin(2 * np.pi * t / 37)
    fill = rep.fill_window(x[:512], x[540:1052], 28)
    assert np.abs(fill - x[512:540]).max() < 0.02
    assert (rep.fill_window(np.zeros(9), np.zeros(9), 5) == 0).all()
    assert np.allclose(rep.fill_window(np.array([1.0, 1.0]), np.array([3.0, 3.0]), 3), [1.5, 2.0, 2.5])


def test_only_approved_windows_change(spark):
    x, at = crackle()
    block = 4096
    blocks = to_blocks(samples(spark, [x, x * 0.91]), block)
    n = spark.createDataFrame([("c", x.size)], "capture_id string, sample_count bigint")
    music = spark.createDataFrame([("c", 0, x.size)], "capture_id string, music_start bigint, music_end bigint")
    out = scan_events(blocks, n, music)
    assert [r.status for r in out["ledger"].collect()] == ["complete"] and out["invalid"].count() == 0
    kept = out["records"].where("confidence > 0.5")
    assert kept.count() == at.size
    first = kept.agg(F.min("start_frame")).first()[0]
    dec = kept.select("capture_id", "event_id", F.when(F.col("start_frame") == first, "rejected").otherwise("approved").alias("decision"), F.lit(None).cast("string").alias("protected_class"))
    done = repair_events(blocks, kept, dec, block)
    assert done["problems"].count() == 0 and done["outside"].count() == 0
    fixed = np.concatenate([r.samples for r in done["blocks"].where("channel = 0").orderBy("block_ix").collect()])
    moved = np.flatnonzero(fixed != x)
    assert moved.size >= at.size - 1 and first not in moved and np.abs(fixed[moved] - 0.05 * np.sin(2 * np.pi * 40 * moved / 8000)).max() < 0.02
    part = repair_events(blocks, kept, dec.where(F.col("decision") == "approved"), block)
    assert [r.reasons for r in part["problems"].collect()] == [["undecided"]] and part["patches"].count() == 0


def test_top_events_are_a_total_order(spark):
    rows = [("c", "clipped" if i % 9 == 0 else "impulse", f"e{i}", i * 10, round(0.2 + (i * 37 % 50) / 100, 8)) for i in range(120)]
    df = spark.createDataFrame(rows, "capture_id string, kind string, event_id string, start_frame bigint, confidence double")
    got = {r.event_id for r in imp.top_events(df, 25, salts=4).collect()}
    want = sorted(rows, key=lambda r: (r[1] != "clipped", -r[4], r[3]))[:25]
    assert got == {r[2] for r in want}


def test_range_reads_report_missing_frames(spark):
    b = to_blocks(samples(spark, [np.arange(100.0)]), 16)
    whole = read_range(b, 10, 50, 16).orderBy("sample_ix").collect()
    assert [r.amp for r in whole] == list(range(10, 50)) and all(r.complete for r in whole)
    assert not read_range(b, 90, 120, 16).first().complete


def test_filling_by_block_equals_filling_by_event(spark):
    """Windows inside a block, over its edges, at the ends of the capture and longer than a block's edges; samples are
    moved by block, not by event."""
    from lacquer.operators import repair as rep

    rng = np.random.default_rng(21)
    x = np.sin(np.arange(700) / 9) + 0.01 * rng.normal(size=700)
    samples = spark.createDataFrame([("a", c, i, float(v + c)) for c in (0, 1) for i, v in enumerate(x)], "capture_id string, channel int, sample_ix bigint, amp double")
    blocks = to_blocks(samples, 64)
    wins = [(0, 4), (3, 9), (60, 70), (64, 66), (128, 128 + 50), (200, 330), (300, 303), (301, 305), (690, 699), (695, 700)]
    events = spark.createDataFrame([("a", f"e{i}", s, e, [0, 1] if i % 2 else [0]) for i, (s, e) in enumerate(wins)],
                                   "capture_id string, event_id string, start_frame bigint, end_frame bigint, channels array<int>")
    want = {(r.channel, r.event_id): r.patch for r in rep.patches(rep.event_contexts(events, blocks, 64, 20), 6).collect()}
    out = rep.fill_events(events, blocks, 64, 20, 6)
    got = {(r.channel, r.event_id): r.patch for r in out.collect()}
    assert set(got) == set(want) and len(got) == 15 and "samples" not in out.columns
    for k, v in want.items():
        assert (got[k] is None) == (v is None)
        assert v is None or np.allclose(got[k], v)
