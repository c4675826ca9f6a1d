"""Pins against current state, plan and inventory differences, catalogue status, album readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import codes

# Pinned field and the message when it moved: fixed values.
PIN_DRIFT = {
    "project_revision": "project revision changed",
    "project_sha256": "project file changed",
    "editable_state_sha256": "editable project state changed",
    "source_sha256": "source audio changed",
    "project_speed_sha256": "reviewed project speed state changed",
    "speed_sha256": "album speed selection changed",
}
# Roles whose bytes must repeat exactly, and the audio facts that must agree: fixed values.
DETERMINISTIC_ROLES = ["full-capture-source", "input-snapshot", "album-artwork", "exact-chapters", "approximate-cue"]
AUDIO_FIELDS = [
    "codec_name", "sample_rate", "channels", "bits_per_raw_sample", "exact_sample_count", "presentation_sample_count",
    "decoded_pcm_sha256", "semantic_tags", "attached_picture_count", "embedded_artwork_sha256",
]


def pin_drift(pins: DataFrame, current: DataFrame) -> DataFrame:
    """What changed since each side was pinned. Both keyed by (album, label); pins carry `pinned`, current `recorded_source`."""
    now = current.select("album", "label", "recorded_source", *[F.col(f).alias("now_" + f) for f in PIN_DRIFT])
    j = pins.join(now, ["album", "label"], "left")
    moved = [(F.col("pinned") & ~F.col(f).eqNullSafe(F.col("now_" + f)), msg) for f, msg in PIN_DRIFT.items()]
    drift = codes(
        (~F.col("pinned"), "side is unpinned"), *moved,
        (F.coalesce((F.col("recorded_source") != "") & (F.col("recorded_source") != F.col("now_source_sha256")), F.lit(False)),
         "source no longer matches the side project"))
    return j.select("album", "label", "pinned", drift.alias("drift")).withColumn("ready", F.size("drift") == 0)


def field_mismatches(planned: DataFrame, current: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Identity fields that differ, and keys found on one side only: (keys, field, planned, current)."""
    a = planned.select(*keys, *[F.col(f).cast("string").alias("p_" + f) for f in fields], F.lit(True).alias("_p"))
    b = current.select(*keys, *[F.col(f).cast("string").alias("c_" + f) for f in fields], F.lit(True).alias("_c"))
    j = a.join(b, keys, "full_outer")
    both = F.col("_p").isNotNull() & F.col("_c").isNotNull()
    item = lambda cond, name, p, c: F.when(cond, F.struct(F.lit(name).alias("field"), p.alias("planned"), c.alias("current")))
    nil = F.lit(None).cast("string")
    rows = [item(F.col("_c").isNull(), "missing", nil, nil), item(F.col("_p").isNull(), "unexpected", nil, nil)]
    rows += [item(both & ~F.col("p_" + f).eqNullSafe(F.col("c_" + f)), f, F.col("p_" + f), F.col("c_" + f)) for f in fields]
    return j.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("m")).select(*keys, "m.*")


def inventory_diff(original: DataFrame, replay: DataFrame, semantic: list[str], audio: list[str] = AUDIO_FIELDS) -> DataFrame:
    """Mismatches of a replayed publication per path: (path, code, field).

    Both: path, role, sha256, size_bytes, validated_render BOOLEAN, has_audio BOOLEAN, semantic and audio columns.
    Bytes count only for roles that must repeat exactly and for validated restoration renders.
    """
    cols = ["role", "sha256", "size_bytes", "validated_render", "has_audio", *semantic, *audio]
    a = original.select("path", *[F.col(c).alias("o_" + c) for c in cols], F.lit(True).alias("_o"))
    b = replay.select("path", *[F.col(c).alias("r_" + c) for c in cols], F.lit(True).alias("_r"))
    j = a.join(b, "path", "full_outer")
    both = F.col("_o").isNotNull() & F.col("_r").isNotNull()
    differs = lambda c: ~F.col("o_" + c).eqNullSafe(F.col("r_" + c))
    exact = F.col("o_role").isin(*DETERMINISTIC_ROLES) | ((F.col("o_role") == "music-range-side") & F.coalesce("o_validated_render", F.lit(False)))
    item = lambda cond, code, field: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    rows = [item(~both | F.col("_o").isNull() | F.col("_r").isNull(), "inventory_path_mismatch", "")]
    rows += [item(both & differs(c), "inventory_semantics_mismatch", c) for c in ["role", *semantic]]
    rows += [item(both & exact & (differs("sha256") | differs("size_bytes")), "deterministic_bytes_mismatch", "")]
    rows += [item(both & F.col("o_has_audio") & ~F.col("r_has_audio"), "audio_verification_missing", "")]
    rows += [item(both & F.col("o_has_audio") & F.col("r_has_audio") & differs(c), "audio_identity_mismatch", c) for c in audio]
    return j.select("path", F.explode(F.array_compact(F.array(*rows))).alias("m")).select("path", "m.*")


def path_sets(original: DataFrame, replay: DataFrame) -> DataFrame:
    """Each path with its state: common, missing or unexpected."""
    j = original.select("path", F.lit(1).alias("_o")).distinct().join(replay.select("path", F.lit(1).alias("_r")).distinct(), "path", "full_outer")
    return j.select("path", F.when(F.col("_r").isNull(), "missing").when(F.col("_o").isNull(), "unexpected").otherwise("common").alias("state"))


def metadata_conflicts(album: DataFrame, sides: DataFrame, fields: list[str], normal) -> DataFrame:
    """Fields filled in both the album and a side whose normalized texts differ. `normal` maps a column to its key."""
    long = lambda df, keys, name: df.select(*keys, F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", name))
    a, s = long(album, ["album"], "album_value"), long(sides, ["album", "label"], "side_value")
    j = s.join(a, ["album", "field"])
    x, y = normal(F.col("album_value")), normal(F.col("side_value"))
    return j.where((x != "") & (y != "") & (x != y)).select("album", "label", "field", "album_value", "side_value")


def missing_metadata(albums: DataFrame) -> DataFrame:
    """Albums without an artist or a title: (album, field)."""
    blank = lambda *cs: F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in cs]).isNull()
    gaps = F.array_compact(F.array(
        F.when(blank("album_artist", "artist"), F.lit("album_artist")), F.when(blank("album_title", "title"), F.lit("album_title"))))
    return albums.select("album", F.explode(gaps).alias("field"))


def album_exceptions(drift: DataFrame, conflicts: DataFrame, missing: DataFrame, side_tracks: DataFrame) -> DataFrame:
    """Per album: tracks, readiness over its sides, blockers (drift and gaps) and reviews (conflicts)."""
    d = drift.groupBy("album").agg(F.count(F.lit(1)).alias("sides"), F.bool_and("ready").alias("sides_ready"), F.sum(F.size("drift")).alias("drift_items"))
    c = conflicts.groupBy("album").agg(F.count(F.lit(1)).alias("reviews"))
    m = missing.groupBy("album").agg(F.count(F.lit(1)).alias("gaps"))
    t = side_tracks.groupBy("album").agg(F.sum("tracks").alias("tracks"))
    out = d.join(t, "album", "left").join(c, "album", "left").join(m, "album", "left").fillna(0, ["reviews", "gaps", "tracks"])
    return out.select("album", "sides", "tracks", (F.col("drift_items") + F.col("gaps")).alias("blockers"), "reviews",
                      (F.col("sides_ready") & (F.col("gaps") == 0)).alias("ready"))


def storage_estimate(projects: DataFrame) -> DataFrame:
    """Peak bytes of an export: source, one stream budget per format, artwork per file, 1 MiB per file.

    projects: (project_id, source_bytes, samples, channels, bits, tracks, formats, artwork_bytes).
    """
    width = F.greatest(F.lit(2), F.floor((F.coalesce("bits", F.lit(32)) + 7) / 8))
    raw = (F.col("samples") * F.col("channels") * width).cast("bigint")
    stream = F.greatest("source_bytes", raw)
    files = F.col("tracks") * F.col("formats")
    mib = 1024 * 1024
    total = F.col("source_bytes") + stream * F.col("formats") + F.col("artwork_bytes") * (files + 1) + (files + 2) * mib
    return projects.select("project_id", total.cast("bigint").alias("export_bytes"), (stream + mib).cast("bigint").alias("restoration_bytes"))


def source_objects(sides: DataFrame) -> DataFrame:
    """Sides that share one source identity, numbered by their first side: (album, sha256, size_bytes, first_order, sides, object_id)."""
    from .ordering import rank_by

    g = sides.groupBy("album", "sha256", "size_bytes").agg(F.min("side_order").alias("first_order"), F.count(F.lit(1)).alias("sides"))
    n = F.col("rank").cast("string")
    number = F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0"))
    ranked = rank_by(g, ["album"], [F.col("first_order"), F.col("sha256")])
    return ranked.withColumn("object_id", F.concat(F.lit("source-"), number, F.lit("-"), F.substring("sha256", 1, 12))).drop("rank")


def duplicate_identities(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Artifacts whose content identity occurs more than once; counted by aggregation, so a hot identity is no hot task."""
    n = artifacts.groupBy(*keys, "artifact_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return artifacts.join(n, [*keys, "artifact_id"])


def catalog_status(artifacts: DataFrame, deps: DataFrame) -> DataFrame:
    """current, stale or invalid for every artifact, with the reasons; staleness is inherited along the chain.

    artifacts: (project, name, kind, artifact_id, sha256, stale_reason NULL); deps: (project, name, dep_kind,
    dep_name, dep_sha256). The chain is fixed (scan, recipe, then preview or render), so three passes settle it.
    """
    from ..session import stage

    n = artifacts.groupBy("project", "artifact_id").agg(F.count(F.lit(1)).alias("_copies"))
    base = stage(artifacts.join(n, ["project", "artifact_id"]).withColumn("_dup", F.col("_copies") > 1).drop("_copies"))
    done = base.where("kind = 'scan'").select(
        "project", "name", "kind", "sha256", "_dup", F.lit(False).alias("_bad"), F.lit("").alias("invalid"),
        F.coalesce("stale_reason", F.lit("")).alias("stale"))
    for kinds in (["recipe"], ["preview", "render"]):
        level = base.where(F.col("kind").isin(*kinds))
        target = done.where("not _dup").select(
            "project", F.col("name").alias("dep_name"), F.col("kind").alias("_dk"), F.col("sha256").alias("_ds"),
            F.col("_bad").alias("_db"), F.col("stale").alias("_dst"))
        d = deps.join(level.select("project", "name"), ["project", "name"], "left_semi").join(target, ["project", "dep_name"], "left")
        code = (
            F.when(F.col("_dk").isNull() | (F.col("_dk") != F.col("dep_kind")), "missing_dependency")
            .when(F.col("_db"), "invalid_dependency").when(F.col("_ds") != F.col("dep_sha256"), "dependency_hash_mismatch"))
        d = d.select("project", "name", code.alias("code"), F.when(F.col("_dst") != "", F.concat(F.lit("stale_"), F.col("dep_kind"), F.lit("_dependency"))).alias("st"))
        worst = d.groupBy("project", "name").agg(F.min("code").alias("_code"), F.min("st").alias("_st"))
        j = level.join(worst, ["project", "name"], "left")
        now = j.select(
            "project", "name", "kind", "sha256", "_dup", F.col("_code").isNotNull().alias("_bad"), F.coalesce("_code", F.lit("")).alias("invalid"),
            F.concat_ws(",", "stale_reason", "_st").alias("stale"))
        done = stage(done.unionByName(now))
    invalid = F.when(F.col("_dup"), "duplicate_artifact_identity").otherwise(F.col("invalid"))
    return done.select("project", "name", "kind", F.when(invalid != "", "invalid").when(F.col("stale") != "", "stale").otherwise("current").alias("status"),
                       F.when(invalid != "", invalid).otherwise(F.col("stale")).alias("reason"))


def latest_chain(status: DataFrame, artifacts: DataFrame, deps: DataFrame) -> DataFrame:
    """Newest current render of each project with its recipe and scan. artifacts carry created_at."""
    ok = status.where("status = 'current'").select("project", "name", "kind").join(artifacts.select("project", "name", "created_at"), ["project", "name"])
    newest = ok.where("kind = 'render'").groupBy("project").agg(F.max(F.struct("created_at", "name"))["name"].alias("render"))
    up = deps.select("project", F.col("name").alias("render"), F.col("dep_name").alias("recipe"))
    up2 = deps.select("project", F.col("name").alias("recipe"), F.col("dep_name").alias("scan"))
    return newest.join(up, ["project", "render"]).join(up2, ["project", "recipe"]).select("project", "render", "recipe", "scan")


def transitions(states: DataFrame, fields: dict[str, str], key: str = "project_id") -> DataFrame:
    """Reasons why each state differs from the one before it; states: (key, sequence dense from 0, fields)."""
    from .ordered import windowed

    prev = {f"_{f}": (lambda f: lambda w: F.lag(f).over(w))(f) for f in fields}
    out = windowed(states, [key], "sequence", 1, 0, prev)
    moved = [(F.col("sequence") > 0) & ~F.col(f).eqNullSafe(F.col("_" + f)) for f in fields]
    return out.withColumn("reasons", codes(*[(m, msg) for m, msg in zip(moved, fields.values())])).drop(*prev)


def album_context(sides: DataFrame, projects: DataFrame, sources: DataFrame) -> DataFrame:
    """Sides with their project and source joined into one identity row and its hash."""
    j = sides.join(projects, "project_id").join(sources, "source_id")
    text: Column = F.concat_ws("|", "album", "side_order", "label", "project_sha256", "source_sha256", F.col("sample_rate").cast("string"))
    return j.withColumn("side_sha256", F.sha2(text, 256))
