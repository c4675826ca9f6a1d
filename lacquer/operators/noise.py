"""Stationary-noise evidence, decisions and previews.

Evidence groups are (scope, region, channel). Their medians are exact quantiles, so a region may hold any number of
windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlaid import overlap_added
from .quantiles import median, median_mad, medians
from .spectral import TINY, cosine
from .validate import codes

KEY = ["capture_id", "region", "role", "channel"]


def spread(c: str):
    return F.max(c) - F.min(c)


def hum_evidence(windows: DataFrame, persistence: float = 0.75) -> DataFrame:
    """Medians, persistence, peak spread and persistent harmonics of both mains frequencies per region and channel."""
    aggs = [F.count(F.lit(1)).alias("windows"), spread("rms_db").alias("rms_spread")]
    for b in (50, 60):
        ok = F.array_contains(f"clear_{b}", 1) & (F.size(f"clear_{b}") >= 2)
        peak = F.when(ok, F.col(f"peak_{b}"))
        aggs += [F.avg(ok.cast("double")).alias(f"persistence_{b}"),
                 F.coalesce(F.max(peak) - F.min(peak), F.lit(0.0)).alias(f"spread_{b}")]
        aggs += [F.avg(F.array_contains(f"clear_{b}", h).cast("double")).alias(f"_h{b}_{h}") for h in (1, 2, 3, 4)]
    g = windows.groupBy(*KEY).agg(*aggs).join(medians(windows, KEY, ["rms_db", "score_50", "score_60"]), KEY)
    for b in (50, 60):
        g = g.withColumn(f"harmonics_{b}", F.array_compact(F.array(*[F.when(F.col(f"_h{b}_{h}") >= persistence, F.lit(h)) for h in (1, 2, 3, 4)])))
    return g.drop(*[f"_h{b}_{h}" for b in (50, 60) for h in (1, 2, 3, 4)])


def rumble_evidence(windows: DataFrame) -> DataFrame:
    return windows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("windows"), spread("rms_db").alias("rms_spread"), spread("ratio_db").alias("ratio_spread"),
        F.avg(F.col("qualifies").cast("double")).alias("persistence"),
    ).join(medians(windows, KEY, ["rms_db", "ratio_db", "share", "flatness", "concentration"]), KEY)


def hiss_evidence(windows: DataFrame) -> DataFrame:
    """Medians and spreads, the scaled median profile, and the median likeness of the windows to it."""
    bins = median(windows.select(*KEY, F.posexplode("profile").alias("bin", "p")), [*KEY, "bin"], "p", "v")
    prof = bins.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("_p"))
    vals = F.transform("_p", lambda x: x["v"])
    total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
    prof = prof.select(*KEY, F.when(total > TINY, F.transform(vals, lambda x: x / total)).otherwise(vals).alias("median_profile"))
    like = windows.join(prof, KEY).withColumn("_s", cosine(F.col("profile"), F.col("median_profile")))
    agg = like.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("windows"), spread("high_db").alias("high_spread"), spread("flatness").alias("flatness_spread"),
        F.avg(F.col("qualifies").cast("double")).alias("persistence"))
    middle = medians(like.withColumnRenamed("_s", "similarity"), KEY, ["rms_db", "high_db", "flatness", "concentration", "crest", "sub_spread", "similarity"])
    return agg.join(middle, KEY).join(prof, KEY)


def decide_hum(evidence: DataFrame) -> DataFrame:
    """One decision per capture: every reference must choose the same mains frequency, and the program confirm it."""
    e, ref, prog = evidence, F.col("role") == "reference", F.col("role") == "program"
    fit = {b: (F.col(f"persistence_{b}") >= 0.75) & (F.col(f"spread_{b}") <= 1.0) & F.array_contains(f"harmonics_{b}", 1) & (F.size(f"harmonics_{b}") >= 2) for b in (50, 60)}
    lead = F.col("score_50") - F.col("score_60")
    e = e.withColumn("choice", F.when(fit[50] & (lead >= 4.0), 50).when(fit[60] & (-lead >= 4.0), 60))
    alone = F.array_contains("harmonics_50", 1) | F.array_contains("harmonics_60", 1)
    e = e.withColumn("why", F.when(F.col("choice").isNotNull(), None).when(fit[50] | fit[60], "50_60_identity_ambiguous")
                     .when(alone, "isolated_tone_or_musical_bass_ambiguous").otherwise("line_not_persistent_across_references"))
    when = lambda cond, x: F.when(cond, x)
    first = F.min(F.when(ref & F.col("why").isNotNull(), F.struct("region", "channel", "why")))
    aggs = [
        F.min(when(ref, F.col("windows"))).alias("rw"), F.min(when(prog, F.col("windows"))).alias("pw"),
        F.max(when(ref, F.col("rms_db"))).alias("rl"), F.max(when(ref, F.col("rms_spread"))).alias("rs"), first["why"].alias("why"),
        F.min(when(ref, F.col("choice"))).alias("lo"), F.max(when(ref, F.col("choice"))).alias("hi"),
        F.min(when(ref, F.abs(lead))).alias("margin"), F.count_if(ref).alias("refs"),
    ]
    for b in (50, 60):
        aggs += [F.min(when(ref, F.col(f"persistence_{b}"))).alias(f"rp_{b}"), F.min(when(prog, F.col(f"persistence_{b}"))).alias(f"pp_{b}")]
        aggs += [F.array_compact(F.array(*[F.when(F.min(F.when(ref, F.array_contains(f"harmonics_{b}", h).cast("int"))) == 1, F.lit(h)) for h in (1, 2, 3, 4)])).alias(f"common_{b}")]
    g = e.groupBy("capture_id").agg(*aggs)
    g = g.withColumn("base", F.when(F.col("lo") == F.col("hi"), F.col("lo")))
    pick = lambda n: F.when(F.col("base") == 50, F.col(n + "_50")).otherwise(F.col(n + "_60"))
    reason = (
        F.when(F.coalesce(F.col("rw") < 2, F.lit(True)), "insufficient_reference_windows").when(F.coalesce(F.col("pw") < 2, F.lit(True)), "insufficient_program_windows")
        .when(F.col("rl") > -24.0, "reference_level_suggests_program_audio").when(F.col("rs") > 8.0, "reference_signal_is_temporally_unstable")
        .when(F.col("why").isNotNull(), F.col("why")).when(F.col("base").isNull(), "channels_or_references_disagree")
        .when(pick("pp") < 0.25, "line_not_confirmed_in_program_windows")
        .when(~F.array_contains(pick("common"), 1) | (F.size(pick("common")) < 2), "harmonics_do_not_agree_across_channels")
    )
    g = g.withColumn("abstained", reason)
    ok = F.col("abstained").isNull()
    sure = F.least(F.lit(0.95), 0.55 + 0.20 * pick("rp") + 0.10 * pick("pp") + 0.10 * F.least(F.lit(1.0), F.col("margin") / 12.0))
    return g.select("capture_id", F.when(ok, "proposed").otherwise("abstained").alias("status"), F.when(ok, F.bround(sure, 9)).otherwise(0.0).alias("confidence"),
                    F.when(ok, F.col("base")).alias("fundamental_hz"), F.when(ok, pick("common")).alias("harmonics"),
                    F.coalesce("abstained", F.lit("stationary_line_and_harmonics_agree")).alias("reason"))


def decide_rumble(evidence: DataFrame) -> DataFrame:
    ref, prog = F.col("role") == "reference", F.col("role") == "program"
    flag = (F.col("persistence") >= 0.75) & (F.col("ratio_spread") <= 8.0)
    musical = (F.col("ratio_db") >= 5.0) & ((F.col("flatness") < 0.08) | (F.col("concentration") > 0.22))
    g = evidence.groupBy("capture_id").agg(
        F.min(F.when(ref, F.col("windows"))).alias("rw"), F.min(F.when(prog, F.col("windows"))).alias("pw"), F.max(F.when(ref, F.col("rms_db"))).alias("rl"),
        F.max(F.when(ref, F.col("rms_spread"))).alias("rs"), F.max(F.when(ref, flag)).alias("any"), F.min(F.when(ref, flag)).alias("all"),
        F.max(F.when(ref, musical)).alias("musical"), F.min(F.when(prog, F.col("persistence"))).alias("pp"), F.min("persistence").alias("least"))
    reason = (
        F.when(F.coalesce(F.col("rw") < 2, F.lit(True)), "insufficient_reference_windows").when(F.coalesce(F.col("pw") < 2, F.lit(True)), "insufficient_program_windows")
        .when(F.col("rl") > -24.0, "reference_level_suggests_program_audio").when(F.col("rs") > 8.0, "reference_signal_is_temporally_unstable")
        .when(F.col("any") & ~F.col("all"), "channels_or_references_disagree")
        .when(~F.col("all") & F.col("musical"), "plausible_low_frequency_music_or_tone").when(~F.col("all"), "diffuse_rumble_not_persistent_across_references")
        .when(F.col("pp") < 0.25, "rumble_not_confirmed_in_program_windows"))
    g = g.withColumn("abstained", reason)
    ok = F.col("abstained").isNull()
    return g.select("capture_id", F.when(ok, "proposed").otherwise("abstained").alias("status"),
                    F.when(ok, F.bround(F.least(F.lit(0.95), 0.60 + 0.30 * F.col("least")), 9)).otherwise(0.0).alias("confidence"),
                    F.coalesce("abstained", F.lit("diffuse_stationary_low_frequency_energy_agrees")).alias("reason"))


def global_reasons(blocks: DataFrame, scopes: DataFrame, silence_db: float = -88.0, clip: float = 0.999) -> DataFrame:
    """(capture_id, global_reason): clipping or silence, which settle a scope before any spectrum; null otherwise.

    Each block gives one row of sums over what lies in the scope; no sample becomes a row.
    """
    lo = F.greatest(F.lit(0), F.col("scope_start") - F.col("start_sample"))
    hi = F.least(F.col("n"), F.col("scope_end") - F.col("start_sample"))
    own = blocks.join(scopes, "capture_id").where(hi > lo).withColumn("_x", F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")))
    part = own.select(
        "capture_id", F.array_max(F.transform("_x", F.abs)).alias("peak"), F.size("_x").alias("n"),
        F.aggregate("_x", F.lit(0.0), lambda a, x: a + x * x).alias("energy"))
    g = part.groupBy("capture_id").agg(F.max("peak").alias("peak"), (F.sum("energy") / F.sum("n")).alias("ms"))
    level = 20.0 * F.log10(F.greatest(F.sqrt("ms"), F.lit(TINY)))
    return g.select("capture_id", F.when(F.col("peak") >= clip, "clipping_invalidates_evidence").when(level < silence_db, "silence").alias("global_reason"))


def unless_settled(decision: DataFrame, settled: DataFrame) -> DataFrame:
    """Clipping or silence anywhere in a scope abstains whatever its spectra say, and so does a settled capture without
    a decision. settled: (capture_id, global_reason)."""
    j = decision.join(settled.where("global_reason is not null"), "capture_id", "full")
    off = F.col("global_reason").isNotNull()
    keep = {"status": F.when(off, "abstained").otherwise(F.col("status")), "confidence": F.when(off, 0.0).otherwise(F.col("confidence")),
            "reason": F.coalesce("global_reason", "reason")}
    keep |= {c: F.when(~off, F.col(c)) for c in ("fundamental_hz", "harmonics") if c in decision.columns}
    return j.withColumns(keep).select(decision.columns)


def decide_hiss(evidence: DataFrame, clipped: DataFrame, minimum_regions: int = 2) -> DataFrame:
    """clipped: (capture_id, clipped BOOLEAN). Profiles are compared with the first one of the capture, then pairwise
    through their least likeness, over the few regions and channels of a scope."""
    prof = F.collect_list("median_profile")
    g = evidence.groupBy("capture_id").agg(
        F.count_distinct("region").alias("regions"), F.min("windows").alias("windows"), F.min("high_db").alias("high_lo"), F.max("high_db").alias("high_hi"),
        F.max("rms_db").alias("rms"), F.min("flatness").alias("flat_lo"), F.max("flatness").alias("flat_hi"), F.max("concentration").alias("conc"),
        F.max("crest").alias("crest"), F.max("sub_spread").alias("sub"), F.min("persistence").alias("persist"), F.max("high_spread").alias("hs"),
        F.max("flatness_spread").alias("fs"), F.min("similarity").alias("sim"), prof.alias("_p")).join(clipped, "capture_id", "left")
    pairs = F.array_min(F.flatten(F.transform("_p", lambda a: F.transform("_p", lambda b: cosine(a, b)))))
    g = g.withColumn("pair", pairs)
    reason = (
        F.when(F.coalesce("clipped", F.lit(False)), "clipping_invalidates_hiss_evidence").when(F.col("regions") < minimum_regions, "insufficient_reference_regions")
        .when(F.col("windows") < 2, "insufficient_reference_windows").when(F.col("high_lo") < -82.0, "silence_or_signal_below_analysis_floor")
        .when(F.col("rms") > -24.0, "reference_level_suggests_program_audio").when((F.col("flat_lo") < 0.35) | (F.col("conc") > 0.04), "music_like_tonality_or_bright_content")
        .when((F.col("crest") > 7.0) | (F.col("sub") > 5.0), "transient_or_temporally_unstable_reference")
        .when((F.col("persist") < 0.75) | (F.col("hs") > 6.0) | (F.col("fs") > 0.25) | (F.col("sim") < 0.92), "reference_spectra_not_stationary")
        .when((F.col("high_hi") - F.col("high_lo") > 6.0) | (F.col("flat_hi") - F.col("flat_lo") > 0.25) | (F.col("pair") < 0.92), "channels_or_references_disagree"))
    g = g.withColumn("abstained", reason)
    ok = F.col("abstained").isNull()
    margin = F.least(F.lit(1.0), F.col("flat_lo") / 0.35 - 1.0, F.col("persist") / 0.75 - 1.0)
    sure = F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.55 + 0.20 * margin + 0.20 * (F.col("pair") - 0.92) / 0.08))
    return g.select("capture_id", F.when(ok, "proposed").otherwise("abstained").alias("status"), F.when(ok, F.bround(sure, 9)).otherwise(0.0).alias("confidence"),
                    F.coalesce("abstained", F.lit("stationary_broadband_noise_agrees")).alias("reason"))


def crackle_metrics(events: DataFrame, references: DataFrame, scopes: DataFrame, rate: int) -> DataFrame:
    """Counts, density, repaired share and reasons. events: merged over channels with start_ix, end_ix, peak_ix,
    confidence, channels; references: (capture_id, start_ix, end_ix); scopes: (capture_id, scope_start, scope_end, channel_count).
    """
    from ..functions.hashing import set_hash
    from .intervals import points_in

    e = events.join(scopes, "capture_id").where((F.col("start_ix") >= F.col("scope_start") + 1) & (F.col("end_ix") < F.col("scope_end")))
    hit = points_in(e.select("capture_id", "peak_ix"), references, ["capture_id"], "peak_ix", how="left_semi").groupBy("capture_id").agg(F.count(F.lit(1)).alias("reference_events"))
    text = F.concat_ws(":", "start_ix", "end_ix", "peak_ix", F.array_join(F.col("channels").cast("array<string>"), ","))
    n = e.groupBy("capture_id").agg(F.count(F.lit(1)).alias("events"), F.sum((F.col("end_ix") - F.col("start_ix")) * F.size("channels")).alias("repaired"))
    out = scopes.join(n, "capture_id", "left").join(hit, "capture_id", "left").join(median(e, ["capture_id"], "confidence", "median_confidence"), "capture_id", "left")
    out = out.join(set_hash(e.withColumn("_t", text), ["capture_id"], "_t", "event_set_sha256"), "capture_id", "left").fillna(0, ["events", "repaired", "reference_events"])
    frames = F.col("scope_end") - F.col("scope_start")
    out = out.withColumn("events_per_second", F.col("events") / (frames / float(rate))).withColumn("repaired_share", F.col("repaired") / (frames * F.col("channel_count")))
    reasons = codes(
        (F.col("events") < 4, "insufficient_conservative_crackle_events"),
        (F.col("reference_events") < 2, "insufficient_noise_reference_crackle_evidence"), (F.col("events_per_second") < 0.10, "crackle_density_below_configured_minimum"),
        (F.col("events_per_second") > 80.0, "crackle_density_exceeds_conservative_limit"), (F.col("repaired_share") > 0.005, "proposed_repair_fraction_exceeds_conservative_limit"))
    return out.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "proposed").otherwise("abstained")).drop("scope_start", "scope_end", "channel_count")


def fit_lines(cut: DataFrame, frequencies: list[float], rate: int) -> DataFrame:
    """Least-squares cosine and sine of each frequency per window, then the medians per capture and channel."""

    @F.pandas_udf("array<double>")
    def fit(xs: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for x, s in zip(xs, start):
            phase = 2.0 * np.pi * np.outer(np.arange(s, s + len(x)), frequencies) / rate
            design = np.concatenate([np.cos(phase), np.sin(phase), np.ones((len(x), 1))], axis=1)
            out.append(np.linalg.lstsq(design, np.asarray(x), rcond=None)[0][:-1].tolist())
        return pd.Series(out)

    per = cut.select("capture_id", "channel", F.posexplode(fit("samples", "start_ix")).alias("k", "v"))
    med = median(per, ["capture_id", "channel", "k"], "v", "v")
    n = len(frequencies)
    freq = F.element_at(F.array(*[F.lit(float(f)) for f in frequencies]), (F.col("k") % n + 1).cast("int"))
    cos = F.max(F.when(F.col("k") < n, F.col("v")))
    sin = F.max(F.when(F.col("k") >= n, F.col("v")))
    g = med.groupBy("capture_id", "channel", (F.col("k") % n).alias("_f"), freq.alias("hz")).agg(cos.alias("c"), sin.alias("s"))
    return g.groupBy("capture_id", "channel").agg(F.array_sort(F.collect_list(F.struct("hz", "c", "s"))).alias("lines"))


def high_pass(cut: DataFrame, rate: int, cutoff: float, order: int, pad: int, fade: int) -> DataFrame:
    """Zero-phase high-pass of each scope window (at most 90 s) with reflected padding, blended in at the edges."""

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            x = np.asarray(x)
            if x.size <= 2 * max(pad, fade):
                out.append(None)
                continue
            wide = np.pad(x, pad, mode="reflect")
            r = (np.fft.rfftfreq(wide.size, 1.0 / rate) / cutoff) ** (2 * order)
            y = np.fft.irfft(np.fft.rfft(wide) * (r / (1.0 + r)), n=wide.size)[pad:-pad]
            env = np.ones(x.size)
            env[:fade] = 0.5 - 0.5 * np.cos(np.linspace(0.0, np.pi, fade))
            env[-fade:] = env[:fade][::-1]
            out.append((x + env * (y - x)).tolist())
        return pd.Series(out)

    return cut.withColumn("filtered", run("samples"))


def reference_psd(frames: DataFrame) -> DataFrame:
    """Median power per bin of root-Hann reference frames, per capture and channel."""

    @F.pandas_udf("array<double>")
    def power(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: (np.abs(np.fft.rfft(np.asarray(x) * np.sqrt(np.hanning(len(x))))) ** 2).tolist())

    bins = frames.select("capture_id", "channel", F.posexplode(power("samples")).alias("bin", "p"))
    med = median(bins, ["capture_id", "channel", "bin"], "p", "p")
    return med.groupBy("capture_id", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "p"))), lambda x: x["p"]).alias("psd"))


def subtract_noise(cut: DataFrame, psd: DataFrame, rate: int, lower: float, upper: float, frame: int, hop: int, fade: int,
                   strength: float = 0.20, most_db: float = 1.5) -> DataFrame:
    """What gentle spectral subtraction would remove, per stretch of a scope: (capture_id, channel, scope_start,
    own_start, removed array<double>), faded over `fade` samples at the scope's ends.

    cut: samples of stretches(); unsafe (tonal or transient) frames remove nothing.
    """
    least, hz = 10.0 ** (-most_db / 20.0), np.fft.rfftfreq(frame, 1.0 / rate)
    band = (hz >= lower) & (hz <= upper)

    def removed(x: np.ndarray, taper: np.ndarray, noise: np.ndarray):
        spec = np.fft.rfft(x * taper)
        p = np.abs(spec) ** 2
        inside = p[band]
        if inside.size == 0 or inside.sum() <= TINY:
            return None
        flat = np.exp(np.log(np.maximum(inside, TINY)).mean()) / max(inside.mean(), TINY)
        y = np.fft.irfft(np.where(band, spec, 0.0), n=frame)
        crest = np.abs(y).max() / max(np.sqrt(np.mean(y**2)), TINY)
        if flat < 0.35 * 0.75 or inside.max() / inside.sum() > 0.08 or crest > 8.75:
            return None
        keep = np.sqrt(np.maximum(1.0 - strength * noise / np.maximum(p, TINY), 0.0))
        gain = np.where(band, np.maximum(keep, least), 1.0)
        return np.fft.irfft(spec * (1.0 - gain), n=frame) * taper

    return overlap_added(cut, psd.withColumnRenamed("psd", "side"), frame, hop, fade, removed)


def band_powers(cut: DataFrame, rate: int, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Hann-tapered power of each named band per window."""
    names = list(bands)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(xs: pd.Series) -> pd.DataFrame:
        rows = []
        for x in xs:
            p, hz = np.abs(np.fft.rfft(np.asarray(x) * np.hanning(len(x)))) ** 2, np.fft.rfftfreq(len(x), 1.0 / rate)
            rows.append([float(p[(hz >= a) & (hz <= b)].sum()) for a, b in bands.values()])
        return pd.DataFrame(rows, columns=names)

    return cut.withColumn("_b", run("samples")).select(*[c for c in cut.columns if c != "samples"], "_b.*")


def loudness_match(overlaid: DataFrame, window: int, floor_db: float = -55.0, most_db: float = 3.0, most_mad: float = 1.0, least: int = 2) -> DataFrame:
    """Median of the per-window level ratios of original to proposed, with its MAD; refused beyond the limits.

    overlaid: (capture_id, sample_ix, original, amp). Windows are counted per capture with exact quantiles.
    """

    w = overlaid.groupBy("capture_id", F.expr(f"sample_ix div {window}").alias("win_ix")).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("original") ** 2)).alias("a"), F.sqrt(F.avg(F.col("amp") ** 2)).alias("b"))
    db = lambda c: 20.0 * F.log10(F.greatest(F.col(c), F.lit(TINY)))
    loud = w.where((F.col("n") == window) & (db("a") >= floor_db) & (db("b") >= floor_db)).select("capture_id", (db("a") - db("b")).alias("ratio_db"))
    m = median_mad(loud, ["capture_id"], "ratio_db", "gain_db", "mad_db", "windows")
    return m.withColumn("reasons", codes(
        (F.col("windows") < least, "too_few_loud_windows"), (F.abs("gain_db") > most_db, "gain_beyond_limit"), (F.col("mad_db") > most_mad, "match_unstable"))
    ).withColumn("linear_gain", F.pow(F.lit(10.0), F.col("gain_db") / 20.0))


def removal_metrics(overlaid: DataFrame) -> DataFrame:
    """Removed level, peak and energy share per channel, and their extremes per capture beside them."""
    gone = F.col("original") - F.col("amp")
    g = overlaid.groupBy("capture_id", "channel").agg(
        F.avg(gone * gone).alias("_ms"), F.max(F.abs(gone)).alias("removed_peak"), F.sum(gone * gone).alias("_e"), F.sum(F.col("original") ** 2).alias("_o"))
    return g.select("capture_id", "channel", F.greatest(F.lit(-400.0), 20.0 * F.log10(F.greatest(F.sqrt("_ms"), F.lit(TINY)))).alias("removed_db"),
                    "removed_peak", (F.col("_e") / F.greatest("_o", F.lit(TINY))).alias("energy_ratio"))
