"""Album-level jobs: exceptions, publication comparison, navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity_text_ascii
from ..operators import drift as dr
from ..operators import validate as va
from ..session import stage
from ..sources import sinks


def album_workbench(pins, current, album_meta, side_meta, albums, side_tracks, fields, normal=identity_text_ascii) -> dict[str, DataFrame]:
    """Everything that stands between an album and its export, and one summary row per album."""
    drift = stage(dr.pin_drift(pins, current))
    conflicts = stage(dr.metadata_conflicts(album_meta, side_meta, fields, normal))
    missing = dr.missing_metadata(albums)
    return {"drift": drift, "conflicts": conflicts, "missing": missing,
            "summary": dr.album_exceptions(drift, conflicts, missing, side_tracks)}


def compare_publications(original, replay, semantic, audio=dr.AUDIO_FIELDS) -> dict[str, DataFrame]:
    """Mismatches of a replayed publication and their counts per code; no rows means it replays exactly."""
    diff = dr.inventory_diff(original, replay, semantic, audio)
    return {"mismatches": diff, "paths": dr.path_sets(original, replay), "summary": diff.groupBy("code").agg(F.count(F.lit(1)).alias("paths"))}


def navigation(tracks: DataFrame, rate: int) -> dict[str, DataFrame]:
    """Cue lines and chapters of albums whose navigation is sound; the others are listed with reasons."""
    tracks = stage(tracks)
    checked = stage(va.navigation_problems(tracks))
    good = tracks.join(checked.where(F.size("reasons") == 0).select("album"), "album", "left_semi")
    lines, chap = sinks.cue_lines(good, rate), sinks.chapters(good)
    summary = chap.select("album", F.length("chapters").alias("chapter_chars")).join(
        sinks.cue_line_counts(good), "album")
    return {"problems": checked.where(F.size("reasons") > 0), "cue": lines, "chapters": chap, "summary": summary}
