"""Where a side's music begins and ends: two evidence families that must agree, or an abstention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fixed_text, ordered_hash
from ..operators.ordered import coalesce_runs, windowed
from ..operators.quantiles import exact_quantiles
from ..session import stage



@dataclass(frozen=True)
class EndpointConfig:
    """Fixed default thresholds."""

    waveform_margin_db: float = 10.0
    spectral_margin_db: float = 4.0
    maximum_flatness: float = 0.78
    flux_activity: float = 0.08
    minimum_range_db: float = 8.0
    minimum_active_ms: int = 1500
    maximum_bridge_ms: int = 500
    minimum_context_ms: int = 750
    maximum_spread_ms: int = 5000
    needle_radius_ms: int = 2500
    transient_sigma: float = 12.0
    minimum_derivative: float = 0.02
    window_chunk: int = 1 << 24

    def samples(self, rate: int, ms: int) -> int:
        return (rate * ms + 999) // 1000


def family_runs(f: DataFrame, levels: DataFrame, rate: int, cfg: EndpointConfig) -> DataFrame:
    """Bridged runs of every activity mask in one pass: (scope_id, family, start_sample, end_sample)."""
    j = f.join(levels, "scope_id")
    wave = (F.col("rms_db") >= F.col("floor_db") + cfg.waveform_margin_db) & (F.col("peak_db") >= F.col("floor_db") + cfg.waveform_margin_db + 2.0)
    shaped = F.col("flatness") <= cfg.maximum_flatness
    spec = (F.col("rms_db") >= F.col("floor_db") + cfg.spectral_margin_db) & (shaped | (F.col("flux") >= cfg.flux_activity))
    more = (F.col("rms_db") >= F.col("floor_db") + max(1.0, cfg.spectral_margin_db / 2.0)) & shaped
    kinds = F.array_compact(F.array(F.when(wave, "waveform"), F.when(spec, "spectral"), F.when(more, "continuation")))
    rows = j.select("scope_id", F.col("start_sample"), F.col("end_sample"), F.explode(kinds).alias("family"))
    return coalesce_runs(rows, ["scope_id", "family"], "start_sample", "end_sample", cfg.samples(rate, cfg.maximum_bridge_ms), chunk=cfg.window_chunk)


def tonal_runs(f: DataFrame, cfg: EndpointConfig) -> DataFrame:
    quiet = f.where(F.col("flatness") <= min(0.25, cfg.maximum_flatness / 3.0))
    return coalesce_runs(quiet.select("scope_id", "start_sample", "end_sample"), ["scope_id"], "start_sample", "end_sample", 0, chunk=cfg.window_chunk)


def confirmations(f: DataFrame, anchors: DataFrame, rate: int, cfg: EndpointConfig) -> DataFrame:
    """Transient windows near an anchor whose level jumps by 9 dB: drop at the start, pickup at the end."""
    q = exact_quantiles(f, ["scope_id"], "derivative_peak", {"_m": 0.5}, method="lower")
    dev = f.join(q, "scope_id").select("scope_id", F.abs(F.col("derivative_peak") - F.col("_m")).alias("_d"))
    limit = q.join(exact_quantiles(dev, ["scope_id"], "_d", {"_mad": 0.5}, method="lower"), "scope_id").select(
        "scope_id", F.greatest(F.lit(cfg.minimum_derivative), F.col("_m") + cfg.transient_sigma * 1.4826 * F.greatest("_mad", F.lit(1e-12))).alias("_limit"))
    near = windowed(f, ["scope_id"], "win_ix", 2, 2, {
        "_b": lambda w: F.avg("rms_db").over(w.rowsBetween(-2, -1)), "_a": lambda w: F.avg("rms_db").over(w.rowsBetween(1, 2))})
    j = near.join(limit, "scope_id").where((F.col("impulses") > 0) & (F.col("derivative_peak") >= F.col("_limit"))).join(anchors, "scope_id")
    jump = F.coalesce("_a", "rms_db") - F.coalesce("_b", "rms_db")
    reach = cfg.samples(rate, cfg.needle_radius_ms)
    to = lambda a: F.abs(F.col("start_sample") - F.col(a))
    kind = F.when((jump >= 9.0) & (to("proposed_start") <= reach), "needle_drop_candidate").when((-jump >= 9.0) & (to("proposed_end") <= reach), "needle_pickup_candidate")
    j = j.withColumn("kind", kind).where("kind is not null")
    far = F.when(F.col("kind") == "needle_drop_candidate", to("proposed_start")).otherwise(to("proposed_end"))
    # Only windows within the radius of two anchors are left here, so a scope's rows are bounded by the radius.
    rows = j.select("scope_id", F.struct(F.col("start_sample").alias("sample"), "kind", far.alias("distance"), F.bround(F.least(F.lit(1.0), F.abs(jump) / 30.0), 9).alias("score")).alias("c"))
    return rows.groupBy("scope_id").agg(F.array_sort(F.collect_list("c")).alias("confirmations"))


def feature_hashes(f: DataFrame) -> DataFrame:
    """Ordered hash of each feature family and of their combination."""
    row = lambda *cs: F.concat_ws(",", "start_sample", "end_sample", *[fixed_text(F.col(c), 9) if c != "impulses" else F.col(c).cast("string") for c in cs])
    fams = {"waveform": ("rms_db", "peak_db", "crest"), "spectral": ("centroid_hz", "flatness", "high_ratio", "flux"), "transient": ("derivative_peak", "impulses")}
    out = None
    for name, cs in fams.items():
        h = ordered_hash(f, ["scope_id"], "win_ix", row(*cs), name + "_sha256")
        out = h if out is None else out.join(h, "scope_id")
    return out.withColumn("combined_sha256", F.sha2(F.concat_ws(",", *[n + "_sha256" for n in fams]), 256))


def propose_endpoints(features: DataFrame, rate: int, cfg: EndpointConfig = EndpointConfig()) -> DataFrame:
    """One proposal per scope.

    features: (scope_id, win_ix dense from 0, start_sample, end_sample, rms_db, peak_db, flatness, flux,
    derivative_peak, impulses), adjacent windows covering the scope.
    """
    f = stage(features)
    q = exact_quantiles(f, ["scope_id"], "rms_db", {"_p5": 0.05, "_p90": 0.90}, method="lower")
    span = f.groupBy("scope_id").agg(F.min("start_sample").alias("scope_start"), F.max("end_sample").alias("scope_end"))
    levels = stage(q.join(span, "scope_id").withColumn("floor_db", F.greatest(F.lit(-120.0), "_p5")).withColumn("range_db", F.col("_p90") - F.col("floor_db")))
    runs = stage(family_runs(f, levels.select("scope_id", "floor_db"), rate, cfg))
    sustained = runs.where(F.col("end_sample") - F.col("start_sample") >= cfg.samples(rate, cfg.minimum_active_ms))
    pick = lambda fam, agg, c: agg(F.when(F.col("family") == fam, F.col(c)))
    ext = sustained.groupBy("scope_id").agg(
        pick("waveform", F.min, "start_sample").alias("w0"), pick("waveform", F.max, "end_sample").alias("w1"),
        pick("spectral", F.min, "start_sample").alias("s0"), pick("spectral", F.max, "end_sample").alias("s1"))
    grown = runs.where("family = 'continuation'").join(ext, "scope_id").groupBy("scope_id").agg(
        F.min(F.when((F.col("start_sample") < F.col("s0")) & (F.col("end_sample") >= F.col("s0")), F.col("start_sample"))).alias("g0"),
        F.max(F.when((F.col("start_sample") <= F.col("s1")) & (F.col("end_sample") > F.col("s1")), F.col("end_sample"))).alias("g1"))
    e = levels.join(ext, "scope_id", "left").join(grown, "scope_id", "left").withColumn("s0", F.coalesce("g0", "s0")).withColumn("s1", F.coalesce("g1", "s1"))
    e = e.withColumn("proposed_start", F.when(F.col("w0").isNotNull() & F.col("s0").isNotNull(), F.least("w0", "s0"))).withColumn(
        "proposed_end", F.when(F.col("w1").isNotNull() & F.col("s1").isNotNull(), F.greatest("w1", "s1")))
    e = stage(e)
    anchors = e.select("scope_id", "proposed_start", "proposed_end").where("proposed_start is not null and proposed_end is not null")
    a = runs.where("family <> 'continuation'").join(anchors, "scope_id")
    ctx = a.groupBy("scope_id").agg(
        F.max(F.when((F.col("start_sample") < F.col("proposed_start")), F.least("end_sample", "proposed_start"))).alias("_before"),
        F.min(F.when((F.col("end_sample") > F.col("proposed_end")), F.greatest("start_sample", "proposed_end"))).alias("_after"))
    t = tonal_runs(f, cfg).join(anchors, "scope_id").groupBy("scope_id").agg(
        F.max(F.when((F.col("start_sample") < F.col("proposed_start")) & (F.col("end_sample") >= F.col("proposed_start")), F.col("proposed_start") - F.col("start_sample"))).alias("_tb"),
        F.max(F.when((F.col("start_sample") <= F.col("proposed_end")) & (F.col("end_sample") > F.col("proposed_end")), F.col("end_sample") - F.col("proposed_end"))).alias("_ta"))
    j = e.join(ctx, "scope_id", "left").join(t, "scope_id", "left").join(confirmations(f, anchors, rate, cfg), "scope_id", "left").join(feature_hashes(f), "scope_id")
    before = F.col("proposed_start") - F.coalesce("_before", "scope_start")
    after = F.coalesce("_after", "scope_end") - F.col("proposed_end")
    apart = F.greatest(F.abs(F.col("w0") - F.col("s0")), F.abs(F.col("w1") - F.col("s1")))
    most = cfg.samples(rate, cfg.maximum_spread_ms)
    j = j.withColumn("before", before).withColumn("after", after).withColumn("apart", apart)
    bridge, context = cfg.samples(rate, cfg.maximum_bridge_ms), cfg.samples(rate, cfg.minimum_context_ms)
    reason = (
        F.when(F.col("range_db") < cfg.minimum_range_db, "silence_or_insufficient_dynamic_range")
        .when(F.col("proposed_start").isNull() | F.col("proposed_end").isNull(), "insufficient_cross_family_evidence")
        .when(F.col("apart") > most, "contradictory_endpoint_families")
        .when((F.coalesce("_tb", F.lit(0)) > bridge) | (F.coalesce("_ta", F.lit(0)) > bridge), "quiet_intro_or_tail_transition_ambiguous")
        .when((F.col("before") < context) | (F.col("after") < context), "scope_boundary_truncated_or_transition_ambiguous")
        .when(F.col("proposed_end") <= F.col("proposed_start"), "invalid_or_ambiguous_endpoint_order"))
    j = j.withColumn("abstained", reason)
    ok = F.col("abstained").isNull()
    sure = 0.55 + 0.2 * (1.0 - F.col("apart") / float(max(1, most))) + 0.2 * F.least(F.lit(1.0), F.col("range_db") / 36.0)
    found = F.coalesce(F.size("confirmations"), F.lit(0)) > 0
    why = F.array_compact(F.array(
        F.lit("cross_family_endpoint_agreement"), F.when((F.col("s0") < F.col("w0")) | (F.col("s1") > F.col("w1")), "quiet_tonal_extent_protected"),
        F.when(found, "needle_morphology_confirms_structural_anchor_only"), F.lit("human_review_required")))
    return j.select(
        "scope_id", F.when(ok, "proposed").otherwise("abstained").alias("status"), F.when(ok, F.col("proposed_start")).alias("proposed_start"),
        F.when(ok, F.col("proposed_end")).alias("proposed_end"), F.when(ok, F.bround(F.least(F.lit(0.95), F.greatest(F.lit(0.5), sure)), 9)).otherwise(0.0).alias("confidence"),
        F.when(ok, why).otherwise(F.array("abstained")).alias("reasons"), "confirmations", "combined_sha256")
