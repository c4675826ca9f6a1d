"""Schema steps of project documents: one select per version, applied in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURRENT = 4


def _state_text(version: str = "") -> Column:
    rows = F.transform("tracks", lambda t: F.concat_ws(":", t["number"].cast("string"), t["start_sample"].cast("string"), t["end_sample"].cast("string")))
    return F.array_join(rows, "\n")


def _baseline() -> Column:
    return F.struct(F.sha2(_state_text(), 256).alias("state_sha256"), F.lower("source.sha256").alias("source_sha256"))


def v1_to_v2(docs: DataFrame) -> DataFrame:
    """Sources gain an unknown sample count and an empty hash; tracks gain empty catalogue ids."""
    source = F.col("source").withField("sample_count", F.lit(None).cast("bigint")).withField("sha256", F.lit(""))
    tracks = F.transform("tracks", lambda t: t.withField("recording_id", F.lit("")).withField("track_id", F.lit("")))
    return docs.withColumn("source", source).withColumn("tracks", tracks).withColumn("schema_version", F.lit(2))


def v2_to_v3(docs: DataFrame) -> DataFrame:
    """The first analyzer state is sealed; history and checkpoints start empty at revision 1."""
    return (
        docs.withColumn("analyzer_baseline", _baseline())
        .withColumn("edit_history", F.array().cast("array<string>")).withColumn("checkpoints", F.array().cast("array<string>"))
        .withColumn("revision", F.lit(1)).withColumn("schema_version", F.lit(3))
    )


def v3_to_v4(docs: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return (
        docs.withColumn("analyzer_baseline", F.coalesce("analyzer_baseline", _baseline()))
        .withColumn("edit_history", F.coalesce("edit_history", empty)).withColumn("checkpoints", F.coalesce("checkpoints", empty))
        .withColumn("revision", F.coalesce("revision", F.lit(1))).withColumn("schema_version", F.lit(CURRENT))
    )


STEPS = {1: v1_to_v2, 2: v2_to_v3, 3: v3_to_v4}


def upgrade(docs: DataFrame, version: int) -> DataFrame:
    """Documents of one version brought to the current one, with the steps taken."""
    if not 1 <= version <= CURRENT:
        raise ValueError(f"schema versions are 1..{CURRENT}")
    taken = [f"{v}->{v + 1}" for v in range(version, CURRENT)]
    for v in range(version, CURRENT):
        docs = STEPS[v](docs)
    return docs.withColumn("steps", F.lit(",".join(taken)))


def upgrade_albums(sides: DataFrame, version: int) -> DataFrame:
    """Album sides v1 to v3: v2 adds the speed selection (inherit), v3 adds the project speed state to pins."""
    if version not in (1, 2, 3):
        raise ValueError("album versions are 1..3")
    out = sides
    if version < 2:
        out = out.withColumn("speed_mode", F.lit("inherit"))
    if version < 3:
        out = out.withColumn("project_speed_sha256", F.lit(None).cast("string")).withColumn("pinned", F.lit(False))
    return out.withColumn("album_version", F.lit(3))
