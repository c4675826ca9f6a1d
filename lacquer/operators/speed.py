"""Playback-speed ratio estimation with robust statistics and abstention reasons."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .quantiles import median_mad

# Nominal turntable speeds in revolutions per minute: fixed values.
NOMINAL_RPM = [100.0 / 6.0, 100.0 / 3.0, 45.0, 78.26]


@dataclass(frozen=True)
class SpeedConfig:
    """Estimator thresholds; the defaults are fixed values."""

    minimum_tracks: int = 4
    minimum_tracks_per_side: int = 2
    minimum_reference_seconds: float = 45.0
    outlier_floor: float = 0.025
    outlier_multiplier: float = 3.5
    maximum_dispersion: float = 0.012
    maximum_side_delta: float = 0.015
    maximum_half_width: float = 0.015
    uncertainty_floor: float = 0.0005
    factor_minimum: float = 0.25
    factor_maximum: float = 2.0

    def __post_init__(self) -> None:
        if self.minimum_tracks < 3 or self.minimum_tracks_per_side < 1 or self.factor_minimum >= self.factor_maximum:
            raise ValueError("speed settings are out of range")


def side_key(side: Column) -> Column:
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(side, F.lit("")), r"\s+", " ")))
    return F.when(text == "", F.lit("(unspecified)")).otherwise(text)


def same_text(a: Column, b: Column) -> Column:
    flat = lambda x: F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))
    return flat(a) == flat(b)


def track_evidence(project: DataFrame, reference: DataFrame, cfg: SpeedConfig) -> DataFrame:
    """Project track i beside reference track i, with the first exclusion reason that holds.

    project: (project_id, ordinal, number, title, side, observed); reference: (project_id, ordinal, number,
    title, side, duration).
    """
    p = project.select("project_id", "ordinal", *[F.col(c).alias("p_" + c) for c in ("number", "title", "side", "observed")])
    r = reference.select("project_id", "ordinal", *[F.col(c).alias("r_" + c) for c in ("number", "title", "side", "duration")])
    j = p.join(r, ["project_id", "ordinal"], "full_outer")
    reason = (
        F.when(F.col("p_number").isNull() | F.col("r_number").isNull(), "track_missing")
        .when(F.col("p_number") != F.col("r_number"), "track_number_mismatch")
        .when(~same_text(F.col("p_title"), F.col("r_title")), "track_title_mismatch")
        .when(side_key(F.col("p_side")) != side_key(F.col("r_side")), "track_side_mismatch")
        .when(F.col("r_duration") < cfg.minimum_reference_seconds, "reference_duration_too_short")
        .when(F.col("p_observed") <= 0, "observed_duration_not_positive")
    )
    j = j.withColumn("exclusion", reason)
    log_factor = F.when(F.col("exclusion").isNull(), F.log(F.col("r_duration") / F.col("p_observed")))
    return j.select("project_id", "ordinal", F.coalesce("r_side", "p_side").alias("side"), "exclusion",
                    log_factor.alias("log_factor"))


def exclude_outliers(rows: DataFrame, cfg: SpeedConfig) -> DataFrame:
    """With three or more candidates, exclude logs farther than max(floor, 3.5 sigma) from the median."""
    rows = stage(rows)
    live = rows.where(F.col("exclusion").isNull())
    spread = median_mad(live, ["project_id"], "log_factor", "_c", "_mad", "_n")
    j = rows.join(spread, "project_id", "left")
    limit = F.greatest(F.lit(cfg.outlier_floor), cfg.outlier_multiplier * 1.4826 * F.col("_mad"))
    out = F.col("exclusion").isNull() & (F.col("_n") >= 3) & (F.abs(F.col("log_factor") - F.col("_c")) > limit)
    return j.withColumn("exclusion", F.when(out, "robust_log_outlier").otherwise(F.col("exclusion"))).drop("_c", "_mad", "_n")


def side_summaries(rows: DataFrame) -> DataFrame:
    live = rows.where(F.col("exclusion").isNull()).withColumn("side", side_key(F.col("side")))
    m = median_mad(live, ["project_id", "side"], "log_factor", "center_log", "_mad", "tracks")
    return m.select("project_id", "side", "tracks", "center_log", F.exp("center_log").alias("center_factor"),
                    (1.4826 * F.col("_mad")).alias("dispersion"))


def summarize(rows: DataFrame, cfg: SpeedConfig, safety: DataFrame | None = None, staged: bool = False) -> DataFrame:
    """One estimate per project: center, interval, dispersion, confidence, or the reasons for abstaining.

    `safety` may bring (project_id, safety_reasons array) found before the statistics. Rows that are not yet written
    (`staged`) are, since four steps read them.
    """
    rows = rows if staged else stage(rows)
    live = rows.where(F.col("exclusion").isNull())
    m = median_mad(live, ["project_id"], "log_factor", "center_log", "_mad", "tracks")
    sides = side_summaries(rows).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("sides"), F.min("tracks").alias("_few"),
        (F.max("center_log") - F.min("center_log")).alias("_delta"),
    )
    identity = rows.groupBy("project_id").agg(
        F.count_if(F.col("exclusion").isin("track_number_mismatch", "track_title_mismatch", "track_side_mismatch")).alias("_bad"),
        F.count_if(F.col("exclusion") == "track_missing").alias("_missing"),
    )
    e = identity.join(m, "project_id", "left").join(sides, "project_id", "left").fillna(0, ["tracks", "sides"])
    e = e.withColumn("dispersion", 1.4826 * F.col("_mad"))
    half = 1.96 * 1.2533 * F.greatest("dispersion", F.lit(cfg.uncertainty_floor)) / F.sqrt("tracks")
    e = e.withColumn("half_width", F.when(F.col("tracks") > 0, half)).withColumn("factor", F.exp("center_log"))
    has = F.col("tracks") > 0
    high = (F.col("tracks") >= 6) & (F.col("sides") >= 2) & (F.col("dispersion") <= 0.003) & (F.col("half_width") <= 0.004)
    medium = (F.col("tracks") >= cfg.minimum_tracks) & (F.col("dispersion") <= 0.01) & (F.col("half_width") <= 0.015)
    own = F.array_compact(F.array(
        F.when(F.col("_missing") > 0, "track_count_mismatch"),
        F.when(F.col("_bad") > 0, "reference_identity_mismatch"),
        F.when(F.col("tracks") < cfg.minimum_tracks, "insufficient_usable_tracks"),
        F.when(has & ~F.col("factor").between(cfg.factor_minimum, cfg.factor_maximum), "factor_outside_supported_range"),
        F.when(has & (F.col("dispersion") > cfg.maximum_dispersion), "track_ratios_inconsistent"),
        F.when(has & (F.col("half_width") > cfg.maximum_half_width), "confidence_interval_too_wide"),
        F.when((F.col("sides") >= 2) & (F.col("_few") < cfg.minimum_tracks_per_side), "insufficient_independent_tracks_per_side"),
        F.when((F.col("sides") >= 2) & (F.col("_delta") > cfg.maximum_side_delta), "side_estimates_disagree"),
        F.when(has & ~high & ~medium, "confidence_below_proposal_threshold"),
    ))
    e = e.withColumn("reasons", own)
    if safety is not None:
        e = e.join(safety, "project_id", "left").withColumn(
            "reasons", F.concat(F.coalesce("safety_reasons", F.array().cast("array<string>")), F.col("reasons")))
    ok = F.size("reasons") == 0
    return e.select(
        "project_id", "tracks", "sides", F.when(ok, "proposed").otherwise("abstained").alias("status"),
        F.when(~ok, "none").when(high, "high").otherwise("medium").alias("confidence"),
        F.when(ok, F.col("factor")).alias("proposed_factor"), F.col("factor").alias("center_factor"),
        F.exp(F.col("center_log") - F.col("half_width")).alias("lower"),
        F.exp(F.col("center_log") + F.col("half_width")).alias("upper"), "dispersion", "reasons",
    )


def rpm_hypotheses(estimates: DataFrame, factor: str = "center_factor") -> DataFrame:
    """All nominal speed pairs that explain the factor with a fine factor in 0.90..1.10, nearest first."""
    pairs = [("same-nominal-speed-unspecified", None, None, 1.0)]
    for a in NOMINAL_RPM:
        for b in NOMINAL_RPM:
            if a != b and 0.25 <= a / b <= 2.0:
                pairs.append((f"capture-{a:.12g}-rpm/intended-{b:.12g}-rpm", a, b, a / b))
    f = F.col(factor)
    options = F.array(*[
        F.struct(
            F.abs(F.log(f / F.lit(c))).alias("distance"), F.lit(label).alias("nominal_pair"),
            F.lit(a).cast("double").alias("capture_rpm"), F.lit(b).cast("double").alias("intended_rpm"),
            F.lit(c).alias("coarse_factor"), (f / F.lit(c)).alias("fine_factor"))
        for label, a, b, c in pairs
    ])
    fit = F.filter(options, lambda o: o["fine_factor"].between(0.90, 1.10))
    best = F.array_sort(fit)
    out = estimates.where(f.between(0.25, 2.0)).select("project_id", F.posexplode(best).alias("_r", "h"))
    return out.select(
        "project_id", (F.col("_r") + 1).alias("rank"), "h.nominal_pair", "h.capture_rpm", "h.intended_rpm",
        "h.coarse_factor", "h.fine_factor", ((F.col("h.fine_factor") - 1.0) * 100.0).alias("fine_delta_percent"),
    )


def boundary_review_status(current: DataFrame, receipts: DataFrame) -> DataFrame:
    """missing, stale, inadequate or current: a receipt's identity compared with the project's.

    Both carry (project_id, project_sha256, revision, state_sha256, source_sha256, ranges_sha256); receipts
    add all_reviewed and independent.
    """
    fields = ["project_sha256", "revision", "state_sha256", "source_sha256", "ranges_sha256"]
    r = receipts.select("project_id", *[F.col(c).alias("r_" + c) for c in fields], "all_reviewed", "independent",
                        F.lit(True).alias("_has"))
    j = current.join(r, "project_id", "left")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col("r_" + c))
    status = (
        F.when(F.col("_has").isNull(), "missing").when(~same, "stale")
        .when(~(F.col("all_reviewed") & F.col("independent")), "inadequate").otherwise("current")
    )
    return j.select("project_id", status.alias("status"))


def safety_reasons(status: DataFrame, independence: DataFrame) -> DataFrame:
    """Reasons that stop a proposal before any statistics: duration independence and boundary review.

    independence: (project_id, independent BOOLEAN NULL); null means that nobody confirmed it.
    """
    j = status.join(independence, "project_id", "left")
    review = F.when(F.col("status") != "current", F.concat(F.lit("boundary_review_evidence_"), F.col("status")))
    own = F.when(F.col("independent").isNull(), "reference_duration_independence_unconfirmed").when(
        ~F.col("independent"), "reference_durations_not_independent")
    return j.select("project_id", F.array_compact(F.array(own, review)).alias("safety_reasons"))


def release_identity(project: DataFrame, reference: DataFrame) -> DataFrame:
    """matched, mismatch or project-metadata-missing from artist (or album artist) and album."""
    p = project.select("project_id", F.coalesce(F.nullif("artist", F.lit("")), F.nullif("album_artist", F.lit(""))).alias("_a"),
                       F.nullif("album", F.lit("")).alias("_b"))
    j = p.join(reference.select("project_id", F.col("artist").alias("_ra"), F.col("album").alias("_rb")), "project_id")
    status = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "project-metadata-missing")
        .when(~same_text(F.col("_a"), F.col("_ra")) | ~same_text(F.col("_b"), F.col("_rb")), "mismatch")
        .otherwise("matched")
    )
    return j.select("project_id", status.alias("status"))
