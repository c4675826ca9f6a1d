"""Gap detection, boundary choice and topology on hand-made envelopes and tones."""

from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacquer.config import SegmentSettings
from lacquer.operators import choice, envelope, gaps
from lacquer.operators import tracks as tr
from lacquer.plans.segment import refit_topology, segment_captures
from lacquer.session import stage


def gap_fixture(spark, clicks=True):
    """Lead, three loud stretches with two gaps, and a tail, in 50 ms windows; two one-window clicks inside the gaps."""
    db = [-58.0] * 20 + [-16.0] * 80 + [-56.0] * 24 + [-18.0] * 80 + [-57.0] * 28 + [-17.0] * 80 + [-59.0] * 20
    if clicks:
        db[108], db[216] = -8.0, -9.0
    return spark.createDataFrame([("side", i, v) for i, v in enumerate(db)], "capture_id string, win_ix bigint, rms_db double")


CFG = SegmentSettings(rate=1000, window_samples=50, smoothing_windows=3, min_gap_seconds=0.5, min_track_seconds=2.0)


@pytest.mark.parametrize("chunk", [16, 65536])
def test_clicks_do_not_split_a_gap(spark, chunk):
    cfg = replace(CFG, chunk=chunk)
    env = envelope.smooth(gap_fixture(spark), cfg.smoothing_windows, cfg.chunk)
    th = envelope.thresholds(env, cfg.margin_db)
    dur = spark.createDataFrame([("side", 16.6)], "capture_id string, duration_seconds double")
    b = gaps.music_bounds(env, th, dur, cfg)
    got = gaps.gap_candidates(env, gaps.quiet_runs(env, th, b, cfg), cfg).orderBy("start_ix").collect()
    assert len(got) == 2
    assert 5.0 < got[0].cut_seconds < 6.3 and 10.2 < got[1].cut_seconds < 11.6
    assert all(0.3 < g.score <= 1.0 and g.contrast_db > 10 for g in got)


def test_silence_becomes_one_track(spark):
    s = spark.createDataFrame([("quiet", i, 0.0) for i in range(3000)], "capture_id string, sample_ix bigint, amp double")
    cap = spark.createDataFrame([("quiet", 3.0)], "capture_id string, duration_seconds double")
    out = segment_captures(s, cap, CFG)
    assert [(t.number, t.start_sample, t.end_sample) for t in out["tracks"].collect()] == [(1, 0, 3000)]
    assert out["candidates"].count() == 0


def test_three_tones_give_three_tracks(spark):
    rng, rate = np.random.default_rng(7), 1000
    parts = []
    for gap, hz, tone in ((1.5, 44, 4.0), (1.2, 66, 4.5), (1.4, 55, 3.8)):
        parts += [np.zeros(int(gap * rate)), 0.25 * np.sin(2 * np.pi * hz * np.arange(int(tone * rate)) / rate)]
    x = np.concatenate([*parts, np.zeros(int(1.2 * rate))])
    x = x + rng.uniform(-0.0025, 0.0025, x.size)
    s = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(x)], "capture_id string, sample_ix bigint, amp double")
    cap = spark.createDataFrame([("t", x.size / rate)], "capture_id string, duration_seconds double")
    out = segment_captures(s, cap, replace(CFG, lead_in_seconds=0.5, tail_seconds=0.5))
    t = out["tracks"].orderBy("number").collect()
    assert len(t) == 3
    assert abs(t[0].end_sample - 6100) < 700 and abs(t[1].end_sample - 11900) < 800
    assert all(a.end_sample == b.start_sample for a, b in zip(t, t[1:]))


def test_most_boundaries_first_then_score():
    assert choice.best_spaced(np.array([10.0, 20.0, 30.0]), np.array([0.6, 1.0, 0.6]), 15.0) == [0, 2]
    rng = np.random.default_rng(9)
    for _ in range(60):
        cuts, score = np.sort(rng.uniform(0, 30, 8)), rng.uniform(0.5, 1, 8)
        sets = [c for n in range(9) for c in combinations(range(8), n) if all(cuts[b] - cuts[a] >= 4 for a, b in zip(c, c[1:]))]
        best = max(sets, key=lambda c: (len(c), sum(score[list(c)])))
        assert tuple(choice.best_spaced(cuts, score, 4.0)) == best


def test_exact_count_equals_brute_force():
    rng = np.random.default_rng(10)
    for _ in range(25):
        cuts = np.sort(rng.uniform(1, 99, 7))
        pts = [{"cut": float(c), "start": float(c) - 0.4, "end": float(c) + 0.4, "score": float(s), "ix": i} for i, (c, s) in enumerate(zip(cuts, rng.uniform(0.2, 1, 7)))]
        got = choice.choose_points(pts, 0.0, 100.0, 4, None, 5.0)
        targets = [25.0, 50.0, 75.0]
        allp = choice.distinct_points([p for p in pts if 5 <= p["cut"] <= 95] + [{"cut": t, "start": t, "end": t, "score": 0.08, "ix": -1} for t in targets])
        value = lambda c: sum(allp[i]["score"] - 0.75 * choice.target_distance(allp[i], t) / 8.0 for i, t in zip(c, targets))
        ok = [c for c in combinations(range(len(allp)), 3) if all(allp[b]["cut"] - allp[a]["cut"] >= 5 for a, b in zip(c, c[1:])) and allp[c[0]]["cut"] >= 5 and allp[c[-1]]["cut"] <= 95]
        best = max(ok, key=value)
        assert [g["ix"] for g in got] == [allp[i]["ix"] for i in best]


def test_infeasible_count_keeps_what_fits():
    pts = [{"cut": 10.0, "start": 9.0, "end": 11.0, "score": 0.9, "ix": 0}]
    got = choice.choose_points(pts, 0.0, 20.0, 9, None, 8.0)
    assert [g["ix"] for g in got] == [0]


def test_sides_are_split_before_tracks(spark):
    pts = [("c", float(i), c, c - 1, c + 1, s) for i, (c, s) in enumerate([(20.0, 0.6), (50.0, 0.9), (81.0, 0.6)])]
    cands = spark.createDataFrame(
        [p for k in "cde" for p in [(k, *q[1:]) for q in pts]],
        "capture_id string, cut_ix double, cut_seconds double, start_seconds double, end_seconds double, score double")
    params = spark.createDataFrame(
        [("c", 0.0, 100.0, 4, [20.0, 30.0, 31.0, 19.0], ["A", "a ", "B", "B"]), ("d", 0.0, 100.0, 4, None, None), ("e", 0.0, 100.0, 3, None, ["A", "B", "A"]),
         ("f", 0.0, 100.0, 2, None, None)],
        "capture_id string, core_start double, core_end double, track_count int, durations array<double>, sides array<string>")
    got = {}
    for r in choice.choose_exact_count(cands, params, 1000, 5.0).orderBy("capture_id", "boundary").collect():
        got.setdefault(r.capture_id, []).append((round(r.cut_seconds, 3), r.measured))
    assert [m for _, m in got["c"]] == [True] * 3 and [round(c) for c, _ in got["c"]] == [20, 50, 81]
    assert len(got["d"]) == 3 and len(got["e"]) == 2 and got["f"] == [(50.0, False)]
    spans = params.select("capture_id", choice.side_spans(F.col("sides"), F.col("track_count")).alias("s"))
    assert {r.capture_id: r.s and [tuple(x) for x in r.s] for r in spans.collect()} == {"c": [(0, 2), (2, 4)], "d": None, "e": None, "f": None}


def test_fallback_measures_from_the_cut():
    """Two long gaps hold the first target; the one whose cut is nearer is taken, whatever its gap reaches over."""
    pts = [{"cut": 3.0, "start": 2.9, "end": 8.0, "score": 0.5, "ix": 0}, {"cut": 6.0, "start": 5.9, "end": 6.1, "score": 0.5, "ix": 1}]
    got = choice.choose_points(pts, 0.0, 9.0, 9, None, 2.9)
    near = lambda c: min(abs(c - k) for k in range(1, 9))
    assert all(near(g["cut"]) <= 1e-9 for g in got) and len(got) == 2


def test_too_many_tracks_take_one_pass():
    """20,000 points and 12,000 tracks that cannot fit: the work grows with the points, not with points times tracks."""
    import time

    rng = np.random.default_rng(5)
    cuts = np.cumsum(rng.uniform(0.1, 1.0, 20000))
    pts = [{"cut": float(c), "start": float(c) - 0.05, "end": float(c) + 0.05, "score": 0.5, "ix": float(i)} for i, c in enumerate(cuts)]
    began = time.process_time()
    got = choice.choose_points(pts, 0.0, float(cuts[-1]) + 1, 12000, None, 2.6)
    assert time.process_time() - began < 5
    apart = np.diff([0.0, *(g["cut"] for g in got), float(cuts[-1]) + 1])
    assert apart.min() >= 2.6 and len(got) > 3500


def test_targets_keep_their_distance(spark):
    rows = [("p", n, 0, 1000, 5, t) for n, t in ((1, 10), (2, 20), (3, 900), (4, 995))]
    df = spark.createDataFrame(rows, "project_id string, number bigint, music_start bigint, music_end bigint, track_count bigint, target bigint")
    got = [r.feasible for r in tr.feasible_targets(df, 100).orderBy("number").collect()]
    prev, want = 0, []
    for i, t in enumerate((10, 20, 900, 995)):
        prev = min(1000 - (5 - i - 1) * 100, max(prev + 100, t))
        want.append(prev)
    assert got == want


def test_refit_follows_measured_gaps(spark):
    rel = spark.createDataFrame([(1, 1, "A", 60.0), (1, 2, "A", 40.0), (1, 3, "A", None), (2, 1, "", 5.0), (2, 2, "", 5.0)], "project_id bigint, number bigint, side string, duration double")
    music = spark.createDataFrame([(1, 0, 150000), (2, 0, 1500)], "project_id bigint, music_start bigint, music_end bigint")
    cands = spark.createDataFrame([(1, 0, 60.0, 62.0, 61.0, 61000, 2.0, 0.9), (1, 1, 99.5, 101.5, 100.5, 100500, 2.0, 0.8)],
                                  "project_id bigint, candidate_index bigint, start_seconds double, end_seconds double, cut_seconds double, cut_sample bigint, duration_seconds double, score double")
    prev = spark.createDataFrame([(1, 2), (2, 2)], "project_id bigint, previous_tracks bigint")
    out = refit_topology(rel, music, cands, 1000, 1.0, prev)
    b = out["boundaries"].orderBy("boundary").collect()
    assert [x.candidate_index for x in b] == [0, 1] and all("imputed_durations" in x.warnings for x in b)
    assert [(r.project_id, r.reason) for r in out["refused"].collect()] == [(2, "range_cannot_hold_tracks")]
    assert out["operations"].where("project_id = 1").first().operation == "split"
    assert out["tracks"].agg(F.max("end_sample")).first()[0] == 150000


def test_points_in_chunks_are_chosen_as_in_one_task(spark):
    """Captures of many points, dense ones and infeasible ones, with and without sides and known durations."""
    rng = np.random.default_rng(12)
    cands, params = [], []
    for k in range(14):
        n, hi = int(rng.integers(2, 220)), float(rng.integers(300, 4000) if k % 3 else rng.integers(90, 130))
        cuts = np.sort(rng.uniform(0, hi, n))
        cuts[1::7] = cuts[0::7][: len(cuts[1::7])] + 0.02
        cands += [(f"c{k}", float(i), float(c), float(c) - 0.4 * (i % 3), float(c) + 0.4 * (i % 3), float(s)) for i, (c, s) in enumerate(zip(cuts, rng.uniform(0.2, 1, n).round(1)))]
        count = int(rng.integers(1, 8)) if k % 3 else int(hi / 18)
        sides = (["A"] * (count // 2) + ["B"] * (count - count // 2)) if k % 4 == 1 else None
        params.append((f"c{k}", 1.0, hi - 1.0, count, [float(x) for x in rng.uniform(10, 90, count)] if k % 5 == 2 else None, sides))
    cands = spark.createDataFrame(cands, "capture_id string, cut_ix double, cut_seconds double, start_seconds double, end_seconds double, score double").repartition(4)
    params = spark.createDataFrame(params, "capture_id string, core_start double, core_end double, track_count int, durations array<double>, sides array<string>")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    whole = rows(choice.choose_exact_count(cands, params, 1000, 25.0))
    assert rows(choice.choose_exact_count(cands, params, 1000, 25.0, limit=0)) == whole and len(whole) > 40


@pytest.mark.parametrize("near, chunk", [(0.05, 1.0), (0.3, 0.3), (0.5, 7.0)])
def test_collapse_equals_the_fold(spark, near, chunk):
    from lacquer.operators.points import collapse_points

    rng = np.random.default_rng(4)
    rows = [(k, float(c), float(s)) for k in "ab" for c, s in zip(rng.uniform(0, 40, 600).round(2), rng.uniform(0, 1, 600).round(1))]
    rows += [("c", 0.04 * i, (i * 7 % 13) / 13) for i in range(3000)] + [("d", 5.0, 0.5)]  # c is one endless chain
    got = {}
    for r in collapse_points(spark.createDataFrame(rows, "capture_id string, cut_seconds double, score double").repartition(3), near, chunk).collect():
        got.setdefault(r.capture_id, []).append((r.cut_seconds, r.score))
    for k in "abcd":
        kept = []
        for c, s in sorted(((c, s) for q, c, s in rows if q == k), key=lambda p: (p[0], -p[1])):
            if kept and c - kept[-1][0] < near:
                if s > kept[-1][1]:
                    kept[-1] = (c, s)
            else:
                kept.append((c, s))
        assert sorted(got[k]) == kept


def test_side_labels_are_folded_once(spark):
    p = spark.createDataFrame([(["A", " a", "b"], 3)], "sides array<string>, n int")
    got = p.select(choice.side_spans(F.col("sides"), F.col("n")).alias("s"))
    assert [tuple(x) for x in got.first().s] == [(0, 2), (2, 3)]
    assert got._jdf.queryExecution().analyzed().toString().count("upper(") == 1


def odd_projects(spark):
    """Releases with all kinds of sides, durations, numbers, ranges and gaps; half of the projects are regular."""
    rng = np.random.default_rng(31)
    rel, music, cands, prev = [], [], [], []
    for k in range(260):
        p, odd = f"p{k}", k % 2 == 1
        n = int(rng.integers(1, 9)) if k % 26 else 40
        cut = max(1, n // 2)
        sides = [["A"] * cut + ["B"] * (n - cut), [None] * n, [" a", "A "] * n, ["A", "b", "C", "d", "E", "f", "G", "h", "I"] * 5, ["A"] * cut + [" "] * (n - cut)][k % 5]
        known = [1.0, 0.0, 0.7, 0.9][k % 4]
        lengths = [float(x) if rng.random() < known else None for x in rng.uniform(1, 12, n)]  # no halves: single steps add up in any order
        numbers = list(range(1, n + 1))
        if odd and k % 13 == 1:
            numbers[-1] += int(rng.integers(0, 2))
        if odd and k % 17 == 1:
            lengths[0] = 0.0
        rel += [(p, i, s, x) for i, s, x in zip(numbers, sides, lengths)]
        start = int(rng.integers(0, 3000))
        span = int(n * rng.uniform(0.9, 8) * 1000) + (0 if k % 7 else 400)
        if k % 41:
            music.append((p, start, start + span) if k % 43 else (p, None, start + span))
        if k % 47 == 3:
            music.append((p, start, start + span))
        m = int(rng.integers(0, 2 * n + 2)) if k % 52 else 130
        cuts = np.sort(rng.uniform(start, start + span, m).round(-1 if k % 3 else 0)) / 1000
        if k % 6 == 0 and m > 1:
            cuts[1::3] = cuts[0::3][: len(cuts[1::3])] + 0.03
        for i, c in enumerate(cuts):
            half = 0.6 if k % 4 else float(rng.choice([0.0, 0.1, 0.3, 1.2]))
            score = round(float(rng.uniform(0.2, 1)), 1) if not (odd and k % 19 == 1 and i == 0) else None
            cands.append((p, i, float(c) - half, float(c) + half, float(c), int(c * 1000), 2 * half, score))
        prev.append((p, int(rng.integers(1, 9))))
    return (
        spark.createDataFrame(rel, "project_id string, number bigint, side string, duration double").repartition(3),
        spark.createDataFrame(music, "project_id string, music_start bigint, music_end bigint"),
        spark.createDataFrame(cands, "project_id string, candidate_index int, start_seconds double, end_seconds double, cut_seconds double, cut_sample bigint, duration_seconds double, score double").repartition(3),
        spark.createDataFrame(prev, "project_id string, previous_tracks bigint"))


def test_short_projects_are_refitted_in_one_pass(spark, monkeypatch):
    from lacquer.plans import segment

    rel, music, cands, prev = odd_projects(spark)
    even = lambda df: df.where("cast(substring(project_id, 2) as int) % 10 in (2, 6)")
    staged = []
    monkeypatch.setattr(segment, "stage", lambda df: staged.append(1) or stage(df))
    monkeypatch.setattr(segment, "_refit_in_steps", None, raising=False)
    out = refit_topology(even(rel), even(music), even(cands), 1000, 1.0, prev)
    assert out["boundaries"].count() > 50 and len(staged) == 1


def test_one_pass_refits_as_the_steps_do(spark):
    """Same boundaries, tracks, operations and refusals for regular and odd projects, in small batches too."""
    from lacquer.operators import refit

    rel, music, cands, prev = odd_projects(spark)
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df.collect())
    steps, once = (refit_topology(rel, music, cands, 1000, 1.0, prev, limit=n) for n in (0, 1 << 16))
    assert {r.status for r in refit.refit_at_once(refit.tagged(rel, music, cands), 1000, 1.0).select("status").distinct().collect()} == {0, 1, 2, 3}
    for name in ("boundaries", "tracks", "operations", "refused"):
        assert rows(once[name]) == rows(steps[name]) and rows(once[name])
    parts = refit.tagged(rel, music, cands)
    assert rows(refit.refit_at_once(parts, 1000, 1.0, 1, batch_rows=50)) == rows(refit.refit_at_once(parts, 1000, 1.0, 5))


def test_equal_problems_are_chosen_as_alone(monkeypatch):
    from lacquer.operators import refit

    rng = np.random.default_rng(8)
    lo, hi, count, own, points, ends = [], [], [], [], [], [0]
    for _ in range(400):
        n, m = int(rng.integers(1, 5)), int(rng.integers(0, 6))
        cuts = np.sort(rng.uniform(0, 6 * n, m).round(1))
        half = rng.choice([0.0, 0.4, 1.5], m)
        points += sorted((float(c), float(c - h), float(c + h), float(s), float(i)) for i, (c, h, s) in enumerate(zip(cuts, half, rng.uniform(0.2, 1, m).round(1))))
        ends.append(len(points))
        lo.append(0.3), hi.append(6.0 * n - 0.2), count.append(n), own.append(rng.uniform(0.5, 9, n).tolist())
    count, known = np.array(count), rng.random(400) < 0.6
    args = np.array(lo), np.array(hi), count, np.concatenate(own), np.cumsum(count) - count, known, np.array(points), np.array(ends[:-1]), np.array(ends[1:])
    for spacing in (1.0, 3.0, 5.7):
        good, got = refit.exact_choices(*args, spacing)
        at = 0
        for q in range(400):
            pts = [dict(zip(choice.POINT, p)) for p in points[ends[q] : ends[q + 1]]]
            want = choice.choose_points(pts, lo[q], hi[q], int(count[q]), own[q] if known[q] else None, spacing)
            assert good[q] == (len(want) == count[q] - 1)
            if good[q]:
                assert [tuple(x) for x in got[at : at + count[q] - 1].tolist()] == [tuple(p[c] for c in choice.POINT) for p in want]
            at += count[q] - 1
        assert good.sum() > 20
