"""Release identification by consensus over an album's tracks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .ordering import rank_by

# Facts that must agree wherever they are given.
FACTS = ["title", "release_group", "country", "date", "status"]
# What a pressing is identified by: fixed list.
PRESSING = ["country", "date", "label", "catalog_number", "barcode", "media_formats", "matrix_runout"]
MAX_MATCHES = 8192
MAX_REFERENCES = 32768
MAX_BYTES = 16 * 1024 * 1024


@dataclass(frozen=True)
class ConsensusConfig:
    minimum_tracks: int = 2
    minimum_coverage: float = 0.50
    minimum_score: float = 0.75
    minimum_margin: float = 0.10
    high_coverage: float = 0.75
    high_score: float = 0.90
    high_margin: float = 0.15

    def __post_init__(self) -> None:
        if self.minimum_tracks < 2 or not 0 <= self.minimum_coverage <= self.high_coverage <= 1:
            raise ValueError("consensus settings are out of range")


def best_per_track(obs: DataFrame) -> DataFrame:
    """First highest score of each (album, side, track, release): (score, position of that observation)."""
    best = F.max(F.struct("score", (-F.col("position")).alias("neg")))
    out = obs.groupBy("album", "side", "track", "release").agg(best.alias("_b"))
    return out.select("album", "side", "track", "release", F.col("_b.score").alias("score"), (-F.col("_b.neg")).alias("position"))


def release_facts(obs: DataFrame, facts: list[str] = FACTS) -> DataFrame:
    """Merged facts per (album, release) and the fields whose nonblank values differ.

    Two distinct values exist exactly when the least differs from the greatest, so no set is gathered.
    """
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    agg = obs.groupBy("album", "release").agg(
        *[F.min(blank(c)).alias("_lo_" + c) for c in facts], *[F.max(blank(c)).alias("_hi_" + c) for c in facts]
    )
    differ = F.array_compact(F.array(*[F.when(F.col("_lo_" + c) != F.col("_hi_" + c), F.lit(c)) for c in facts]))
    return agg.select("album", "release", *[F.coalesce("_lo_" + c, F.lit("")).alias(c) for c in facts], differ.alias("conflicts"))


def score_releases(best: DataFrame, albums: DataFrame) -> DataFrame:
    """Evidence, mean score, coverage and distinct sides per release; albums: (album, total_tracks, total_sides)."""
    per_side = best.groupBy("album", "release", "side").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    agg = per_side.groupBy("album", "release").agg(
        F.sum("s").alias("_s"), F.sum("n").alias("tracks"), F.count(F.lit(1)).alias("sides")
    ).join(albums, "album")
    return agg.select(
        "album", "release", F.round(F.col("_s") / F.col("total_tracks"), 9).alias("evidence"),
        F.round(F.col("_s") / F.col("tracks"), 9).alias("mean_score"), "tracks", "sides",
        F.round(F.col("tracks") / F.col("total_tracks"), 9).alias("coverage"), "total_tracks", "total_sides",
    )


def album_totals(obs: DataFrame) -> DataFrame:
    per_side = obs.select("album", "side", "track").distinct().groupBy("album", "side").agg(F.count(F.lit(1)).alias("n"))
    return per_side.groupBy("album").agg(F.sum("n").alias("total_tracks"), F.count(F.lit(1)).alias("total_sides"))


def rank_releases(scored: DataFrame) -> DataFrame:
    """Rank and margin to the next."""
    order = [F.col("evidence").desc(), F.col("tracks").desc(), F.col("sides").desc(), F.col("release").asc()]
    ranked = stage(rank_by(scored, ["album"], order))
    after = ranked.select("album", (F.col("rank") - 1).alias("rank"), F.col("evidence").alias("_next"))
    return ranked.join(after, ["album", "rank"], "left").select(
        *scored.columns, "rank", F.round(F.col("evidence") - F.col("_next"), 9).alias("margin"))


def volume_caps(obs: DataFrame) -> DataFrame:
    """Matches, references and payload bytes of an album against the admitted volume."""
    agg = obs.groupBy("album").agg(
        F.count(F.lit(1)).alias("matches"), F.sum(F.coalesce("references", F.lit(1))).alias("references"),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"),
    )
    return agg.withColumn("reasons", F.array_compact(F.array(
        F.when(F.col("matches") > MAX_MATCHES, "too_many_matches"),
        F.when(F.col("references") > MAX_REFERENCES, "too_many_release_references"),
        F.when(F.col("bytes") > MAX_BYTES, "evidence_too_large"),
    )))


def evidence_binding(obs: DataFrame, tracks: DataFrame, fields: list[str]) -> DataFrame:
    """Observations against the current track they name: (album, side, track) and every identity field."""
    now = tracks.select("album", "side", "track", *[F.col(c).alias("now_" + c) for c in fields], F.lit(True).alias("_has"))
    j = obs.join(now, ["album", "side", "track"], "left")
    stale = [F.when(F.col("_has") & ~F.col(c).eqNullSafe(F.col("now_" + c)), F.lit("stale_" + c)) for c in fields]
    reasons = F.array_compact(F.array(F.when(F.col("_has").isNull(), F.lit("unknown_track")), *stale))
    return j.withColumn("reasons", reasons).drop("_has", *["now_" + c for c in fields])


def decide(scored: DataFrame, facts: DataFrame, albums: DataFrame, cfg: ConsensusConfig) -> DataFrame:
    """One decision per album: proposed, ambiguous or abstained, with the reasons."""
    clean = scored.join(facts.where(F.size("conflicts") > 0).select("album", "release"), ["album", "release"], "left_anti")
    first = rank_releases(clean).where("rank = 1").withColumnRenamed("release", "top")
    conflicts = facts.groupBy("album").agg(F.count_if(F.size("conflicts") > 0).alias("_conflicts"))
    a = albums.select("album").join(conflicts, "album", "left").join(first, "album", "left")
    low = F.array_compact(F.array(
        F.when(F.col("tracks") < cfg.minimum_tracks, "insufficient_independent_track_support"),
        F.when(F.col("coverage") < cfg.minimum_coverage, "insufficient_album_track_coverage"),
        F.when(F.col("mean_score") < cfg.minimum_score, "recognition_scores_too_low"),
        F.when(F.col("sides") < F.col("total_sides"), "candidate_not_supported_across_independent_sides"),
    ))
    close = F.col("margin").isNotNull() & (F.col("margin") < cfg.minimum_margin)
    reasons = (
        F.when(F.col("_conflicts") > 0, F.array(F.lit("conflicting_network_release_facts_require_review")))
        .when(F.col("top").isNull(), F.array(F.lit("no_consistent_exact_release_candidates")))
        .when(F.size(low) > 0, low)
        .when(close, F.array(F.lit("top_release_candidates_are_not_separated")))
        .otherwise(F.array(F.lit("cross_track_release_consensus_requires_owner_review")))
    )
    refused = (F.col("_conflicts") > 0) | F.col("top").isNull() | (F.size(low) > 0)
    status = F.when(refused, "abstained").when(close, "ambiguous").otherwise("proposed")
    strong = (
        (F.col("coverage") >= cfg.high_coverage) & (F.col("mean_score") >= cfg.high_score)
        & (F.col("sides") == F.col("total_sides")) & (F.col("margin").isNull() | (F.col("margin") >= cfg.high_margin))
    )
    out = a.withColumn("status", status).withColumn("reasons", reasons)
    return out.select(
        "album", "status",
        F.when(F.col("status") == "abstained", "none").when(F.col("status") == "ambiguous", "low")
        .when(strong, "high").otherwise("medium").alias("confidence"),
        F.when(F.col("status") == "proposed", F.col("top")).alias("selected"), "margin", "reasons",
        F.col("top").alias("top_ranked"),
    )


def pressing_gaps(decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """Pressing facts that the top-ranked release leaves unknown."""
    top = decisions.select("album", F.col("top_ranked").alias("release")).join(facts, ["album", "release"], "left")
    known = [c for c in PRESSING if c in facts.columns]
    gaps = [
        F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) if c in known else F.lit(c) for c in PRESSING
    ]
    return top.select("album", "release", F.array_compact(F.array(*gaps)).alias("missing"))
