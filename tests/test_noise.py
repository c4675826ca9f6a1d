"""Noise decisions on made signals, and endpoint proposals on made features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacquer.operators import noise as nz
from lacquer.operators import spectral as sx
from lacquer.plans import endpoints, evidence, noise
from lacquer.sources.blocks import to_blocks

RATE, BLOCK = 2000, 8192


def blocks_of(spark, sides):
    rows = []
    for cid, x in sides.items():
        for k in range(0, x.size, BLOCK):
            rows.append((cid, 0, k // BLOCK, k, len(x[k : k + BLOCK]), x[k : k + BLOCK].tolist()))
    return spark.createDataFrame(rows, "capture_id string, channel int, block_ix bigint, start_sample bigint, n int, samples array<double>")


def side(kind, seed=3):
    rng, n = np.random.default_rng(seed), 24 * RATE
    t = np.arange(n) / RATE
    x = rng.normal(0, 1e-5, n)
    if kind.startswith("hum"):
        for h, a in ((1, 0.0020), (2, 0.0008), (3, 0.0004)):
            x += a * np.sin(2 * np.pi * int(kind[3:]) * h * t + h)
    if kind == "tone":
        x += 0.002 * np.sin(2 * np.pi * 60 * t)
    if kind == "rumble":
        f = np.fft.rfftfreq(n, 1 / RATE)
        spec = np.fft.rfft(rng.normal(0, 1, n))
        x += 0.02 * np.fft.irfft(np.where((f >= 6) & (f <= 28), spec, 0), n=n)
    music = (t >= 4) & (t < 20)
    return x + np.where(music, 0.04 * np.sin(2 * np.pi * 440 * t), 0)


def regions(spark, names):
    ref = [(c, lab, a * RATE, b * RATE) for c in names for lab, a, b in (("lead_in", 0, 4), ("lead_out", 20, 24))]
    refs = spark.createDataFrame(ref, "capture_id string, label string, start_sample bigint, end_sample bigint")
    scopes = spark.createDataFrame([(c, 0, 24 * RATE) for c in names], "capture_id string, scope_start bigint, scope_end bigint")
    return refs, scopes


def test_hum_and_rumble_are_told_apart(spark):
    names = ["hum50", "hum60", "tone", "rumble", "clean"]
    b = blocks_of(spark, {n: side(n) for n in names})
    out = noise.noise_evidence(b, *regions(spark, names), RATE, 2 * RATE, BLOCK)
    hum = {r.capture_id: r for r in out["hum"].collect()}
    rum = {r.capture_id: r for r in out["rumble"].collect()}
    assert (hum["hum50"].status, hum["hum50"].fundamental_hz, hum["hum60"].fundamental_hz) == ("proposed", 50, 60)
    assert {1, 2} <= set(hum["hum60"].harmonics) and 0.5 < hum["hum60"].confidence <= 0.95
    assert hum["tone"].reason == "isolated_tone_or_musical_bass_ambiguous" and hum["clean"].status == "abstained"
    assert rum["rumble"].status == "proposed" and rum["clean"].status == "abstained"


def test_hum_preview_takes_the_line_out(spark):
    x = side("hum60")
    b = blocks_of(spark, {"h": x})
    refs, scopes = regions(spark, ["h"])
    s = spark.createDataFrame([("h", 0, i, float(v)) for i, v in enumerate(x[: 4 * RATE])], "capture_id string, channel int, sample_ix bigint, amp double")
    out = noise.preview_hum(s, b, refs, scopes, [60.0, 120.0, 180.0], RATE, 2 * RATE, BLOCK, 200)
    lines = out["lines"].first().lines
    assert np.isclose(np.hypot(lines[0].c, lines[0].s), 0.0020, rtol=0.01)
    r = out["samples"].where("sample_ix > 1000").agg(F.max(F.abs("amp")).alias("rest"), F.max(F.abs(F.col("amp") + F.col("removed") - F.col("original"))).alias("err")).first()
    assert r.rest < 2e-4 and r.err <= 1e-12


def test_hiss_needs_broadband_noise(spark):
    rate, rng = 48000, np.random.default_rng(5)
    n = 6 * rate
    tone = 0.01 * np.sin(2 * np.pi * 9000 * np.arange(n) / rate)
    b = blocks_of(spark, {"noise": rng.normal(0, 1e-3, n), "tone": tone})
    refs = spark.createDataFrame([(c, lab, s * rate, (s + 2) * rate) for c in ("noise", "tone") for lab, s in (("a", 0), ("b", 3))], "capture_id string, label string, start_sample bigint, end_sample bigint")
    got = {r.capture_id: r for r in noise.hiss_evidence(b, refs, rate, rate, BLOCK)["decision"].collect()}
    assert got["noise"].status == "proposed" and got["tone"].reason == "music_like_tonality_or_bright_content"


def test_high_pass_removes_slow_movement(spark):
    t = np.arange(8 * RATE) / RATE
    b = blocks_of(spark, {"r": np.sin(2 * np.pi * 3 * t) + 0.1 * np.sin(2 * np.pi * 200 * t)})
    sc = spark.createDataFrame([("r", 0, 8 * RATE)], "capture_id string, scope_start bigint, scope_end bigint")
    y = np.asarray(noise.preview_rumble(b, sc, RATE, BLOCK, pad_seconds=1.0).first().filtered)
    mid = slice(2 * RATE, 6 * RATE)
    assert np.abs(y[mid] - 0.1 * np.sin(2 * np.pi * 200 * t[mid])).max() < 0.02


def test_subtraction_is_gentle(spark):
    x = np.random.default_rng(6).normal(0, 1e-3, 3 * RATE)
    b = blocks_of(spark, {"n": x})
    refs = spark.createDataFrame([("n", "a", 0, RATE)], "capture_id string, label string, start_sample bigint, end_sample bigint")
    sc = spark.createDataFrame([("n", 0, 3 * RATE)], "capture_id string, scope_start bigint, scope_end bigint")
    rows = noise.preview_hiss(b, refs, sc, RATE, BLOCK, 200.0, 900.0, 256, 64).orderBy("sample_ix").collect()
    gone = np.array([r.removed for r in rows])
    assert len(rows) == x.size and 0 < np.sqrt(np.mean(gone**2)) < 0.2 * np.sqrt(np.mean(x**2))


def features(spark, scope, energies, seconds=1.0, flat=0.2, rate=1000):
    rows = [(scope, i, int(i * rate * seconds), int((i + 1) * rate * seconds), float(e), float(e) + 6.0, 2.0, 500.0, flat if e > -50 else 0.9, 0.1, 0.0, 0.001, 0)
            for i, e in enumerate(energies)]
    return spark.createDataFrame(rows, "scope_id string, win_ix bigint, start_sample bigint, end_sample bigint, rms_db double, peak_db double, crest double, centroid_hz double, flatness double, high_ratio double, flux double, derivative_peak double, impulses int")


@pytest.mark.parametrize("chunk", [3000, 1 << 24])
def test_endpoints_agree_across_families(spark, chunk):
    e = [-60] * 4 + [-53] * 3 + [-20] * 13 + [-53] * 4 + [-60] * 6
    f = features(spark, "s", e).withColumn("flatness", F.when(F.col("rms_db") > -60, 0.5).otherwise(0.9))
    r = endpoints.propose_endpoints(f.unionByName(features(spark, "silent", [-70] * 30)), 1000, endpoints.EndpointConfig(window_chunk=chunk))
    got = {x.scope_id: x for x in r.collect()}
    assert (got["s"].status, got["s"].proposed_start, got["s"].proposed_end) == ("proposed", 4000, 24000)
    assert "quiet_tonal_extent_protected" in got["s"].reasons and 0.5 <= got["s"].confidence <= 0.95
    assert got["silent"].reasons == ["silence_or_insufficient_dynamic_range"]


def test_truncated_scope_abstains(spark):
    r = endpoints.propose_endpoints(features(spark, "cut", [-20] * 15 + [-60] * 15), 1000).first()
    assert (r.status, r.reasons) == ("abstained", ["scope_boundary_truncated_or_transition_ambiguous"])


def test_flux_is_zero_first_and_counts_rises(spark):
    df = spark.createDataFrame([("a", 0, [0.5, 0.5]), ("a", 1, [0.9, 0.1]), ("a", 2, [0.9, 0.1])], "k string, win_ix bigint, spectrum array<double>")
    assert np.allclose([r.flux for r in sx.with_flux(df, ["k"]).orderBy("win_ix").collect()], [0.0, 0.4, 0.0])


def test_evidence_window_sees_the_needle(spark):
    rate = 4000
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(0, 1e-5, 2000), 0.3 * np.sin(2 * np.pi * 300 * np.arange(2000) / rate)]
    x[2000] += 0.6
    b = to_blocks(spark.createDataFrame([("c", ch, i, float(v)) for ch in (0, 1) for i, v in enumerate(x)], "capture_id string, channel int, sample_ix bigint, amp double"), 1024)
    req = spark.createDataFrame([("c", "q", 0, 4000)], "capture_id string, request_id string, start_ix bigint, end_ix bigint")
    out = evidence.evidence_windows(b, req, rate, 1024, points=40, bands=16)
    f = out["focus"].first()
    assert "rises" in f.observations and f.change_db > 40
    assert any(t.hint == "needle_drop_candidate" and abs(t.offset - 2000) < 5 for t in f.transients)
    s = out["spectrogram"].first()
    assert len(s.dbfs) == 16 and max(map(max, s.dbfs)) <= 0.0 and out["waveform"].count() == 80


def hiss_in_one_piece(x, psd, rate, lower, upper, frame, hop, fade):
    """The same subtraction over a whole scope at once, as loops over its frames."""
    taper, hz = np.sqrt(np.hanning(frame)), np.fft.rfftfreq(frame, 1 / rate)
    band, total, weight = (hz >= lower) & (hz <= upper), np.zeros(x.size), np.zeros(x.size)
    for f in sorted({*range(0, x.size - frame + 1, hop), x.size - frame}):
        weight[f : f + frame] += taper**2
        spec = np.fft.rfft(x[f : f + frame] * taper)
        p = np.abs(spec) ** 2
        y = np.fft.irfft(np.where(band, spec, 0), n=frame)
        flat = np.exp(np.log(np.maximum(p[band], 1e-300)).mean()) / p[band].mean()
        if flat >= 0.2625 and p[band].max() / p[band].sum() <= 0.08 and np.abs(y).max() / np.sqrt(np.mean(y**2)) <= 8.75:
            gain = np.where(band, np.maximum(np.sqrt(np.maximum(1 - 0.2 * psd / p, 0)), 10 ** (-1.5 / 20)), 1)
            total[f : f + frame] += np.fft.irfft(spec * (1 - gain), n=frame) * taper
    out = np.where(weight > 1e-15, total / np.maximum(weight, 1e-15), total)
    edge = np.minimum(np.arange(x.size), np.arange(x.size)[::-1])
    return out * np.where(edge < fade, 0.5 - 0.5 * np.cos(np.pi * np.minimum(edge, fade - 1) / (fade - 1)), 1)


@pytest.mark.parametrize("block", [512, 1024, 8192])
def test_subtraction_over_stretches_equals_one_piece(spark, block):
    n, frame, hop = 5003, 256, 64
    x = np.random.default_rng(8).normal(0, 1e-3, n)
    s = spark.createDataFrame([("n", 0, i, float(v)) for i, v in enumerate(x)], "capture_id string, channel int, sample_ix bigint, amp double")
    refs = spark.createDataFrame([("n", "a", 0, 1000)], "capture_id string, label string, start_sample bigint, end_sample bigint")
    sc = spark.createDataFrame([("n", 0, n)], "capture_id string, scope_start bigint, scope_end bigint")
    rows = noise.preview_hiss(to_blocks(s, block), refs, sc, 1000, block, 100.0, 450.0, frame, hop).orderBy("sample_ix").collect()
    starts = sorted({*range(0, 1000 - frame + 1, hop), 1000 - frame})
    psd = np.median([np.abs(np.fft.rfft(x[f : f + frame] * np.sqrt(np.hanning(frame)))) ** 2 for f in starts], axis=0)
    want = hiss_in_one_piece(x, psd, 1000, 100.0, 450.0, frame, hop, 100)
    got = np.array([r.removed for r in rows])
    assert [r.sample_ix for r in rows] == list(range(n)) and np.abs(got - want).max() < 1e-15 and np.abs(want).max() > 0 and got[0] == got[-1] == 0


def test_patches_over_block_edges(spark):
    from lacquer.operators import overlaid

    x = np.arange(1000, dtype=float)
    s = spark.createDataFrame([(k, 0, i, float(v)) for k in "ab" for i, v in enumerate(x)], "capture_id string, channel int, sample_ix bigint, amp double")
    b = to_blocks(s, 64)
    patches = spark.createDataFrame([("a", 0, 60, [-1.0] * 200), ("a", 0, 300, [-2.0]), ("a", 0, 990, [-3.0] * 40), ("a", 0, 400, None), ("a", 0, 500, [500.0])],
                                    "capture_id string, channel int, start_frame bigint, patch array<double>")
    laid = overlaid.overlay_blocks(b, patches, 64)
    want = x.copy()
    want[60:260], want[300], want[990:] = -1, -2, -3
    got = {(r.capture_id, r.sample_ix): r for r in overlaid.sample_rows(laid).collect()}
    assert all(got["a", i].amp == want[i] and got["b", i].amp == x[i] and got["a", i].original == x[i] for i in range(1000))
    windows = spark.createDataFrame([("a", 0, 60, 260), ("a", 0, 100, 280), ("a", 0, 299, 301)], "capture_id string, channel int, start_ix bigint, end_ix bigint")
    m = {r.capture_id: r for r in overlaid.gated_render(overlaid.render_metrics(laid, windows, 64)).collect()}
    gone = x - want
    assert (m["a"].samples, m["a"].changed, m["a"].changed_outside, m["a"].max_removed) == (1000, 211, 10, gone.max())
    assert np.isclose(m["a"].removed_rms, np.sqrt(np.mean(gone**2))) and m["a"].reasons == ["changed_outside_events"] and m["a"].status == "refused"
    assert np.isclose(m["a"].proposed_gain, 1.01) and np.isclose(m["a"].monitor_gain, 0.05 / np.sqrt(np.mean(gone**2)))
    assert m["b"].reasons == ["no_bounded_change"] and m["b"].monitor_gain == 100.0


def test_short_and_incomplete_references_abstain(spark):
    """A reference shorter than a window, one with a hole, and a scope without samples say why nothing is proposed."""
    x = side("hum50")
    b = blocks_of(spark, {"short": x, "hole": x, "whole": x}).where("capture_id <> 'hole' or start_sample <> 0")
    refs, scopes = regions(spark, ["short", "hole", "whole", "empty"])
    refs = refs.withColumn("end_sample", F.when((F.col("capture_id") == "short") & (F.col("label") == "lead_in"), RATE).otherwise(F.col("end_sample")))
    out = noise.noise_evidence(b, refs, scopes, RATE, 2 * RATE, BLOCK)
    got = {r.capture_id: (r.status, r.reason) for r in out["hum"].collect()}
    assert got["whole"][0] == "proposed" and got["short"] == ("abstained", "region_shorter_than_window")
    assert got["empty"] == got["hole"] == ("abstained", "window_incomplete")
    listed = {(r.capture_id, r.region, r.reason) for r in out["unmeasured"].collect()}
    assert ("short", "lead_in", "region_shorter_than_window") in listed
