"""Release identification and speed estimation as whole jobs: guards first, statistics after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import consensus as con
from ..operators import speed as sp
from ..session import stage


def identify_releases(obs: DataFrame, tracks: DataFrame, fields: list[str], facts: list[str], cfg: con.ConsensusConfig) -> dict[str, DataFrame]:
    """Decisions per album, and the albums refused before any ranking: too much evidence, or evidence that does not
    belong to the tracks as they are now.

    obs: (album, side, track, release, score, position, references, bytes, `fields`, `facts`);
    tracks: (album, side, track, `fields`).
    """
    too_much = con.volume_caps(obs).where(F.size("reasons") > 0).select("album", F.explode("reasons").alias("reason"))
    stale = con.evidence_binding(obs, tracks, fields).where(F.size("reasons") > 0).select("album", F.explode("reasons").alias("reason"))
    refused = stage(too_much.union(stale).groupBy("album").agg(F.array_sort(F.collect_set("reason")).alias("reasons")))
    good = stage(obs.join(refused.select("album"), "album", "left_anti"))
    totals = con.album_totals(good)
    decisions = con.decide(con.score_releases(con.best_per_track(good), totals), con.release_facts(good, facts), totals, cfg)
    return {"refused": refused, "decisions": decisions}


def estimate_speeds(
    project: DataFrame, reference: DataFrame, status: DataFrame, independence: DataFrame, identity: DataFrame, cfg: sp.SpeedConfig
) -> dict[str, DataFrame]:
    """Track evidence, one estimate per project, and the nominal speeds that explain it.

    What stops a proposal whatever its ratios say comes first in the reasons: durations that are not known to be
    independent, a boundary review that is not current (status: boundary_review_status()), and release metadata that
    does not match (identity: release_identity()).
    """
    why = F.when(F.col("status") == "mismatch", "release_metadata_mismatch").when(F.col("status") == "project-metadata-missing", "project_release_metadata_missing")
    named = identity.select("project_id", F.array_compact(F.array(why)).alias("_named"))
    none = F.array().cast("array<string>")
    safety = sp.safety_reasons(status, independence).join(named, "project_id", "full").select(
        "project_id", F.concat(F.coalesce("safety_reasons", none), F.coalesce("_named", none)).alias("safety_reasons"))
    rows = stage(sp.exclude_outliers(sp.track_evidence(project, reference, cfg), cfg))
    estimates = stage(sp.summarize(rows, cfg, safety, staged=True))
    return {"tracks": rows, "estimates": estimates, "hypotheses": sp.rpm_hypotheses(estimates)}
