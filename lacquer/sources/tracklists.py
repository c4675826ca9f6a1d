"""Track lists as JSON or text, and reference duration lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEADING_NUMBER, NUMBER_FIELD, bare_title, duration, title_or_number
from .catalogs import parsed

# The metadata keys a track list may carry: fixed list.
METADATA_KEYS = ["artist", "album", "album_artist", "year", "genre", "side"]
JSON_SCHEMA = (
    "artist string, album string, album_artist string, year string, genre string, side string, "
    "tracks array<struct<title:string,name:string,duration:string,length:string,artist:string,side:string>>"
)


def read_documents(spark, path: str) -> DataFrame:
    """(document, body): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("document"), F.col("value").alias("body"))


def parse_json(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per track of a JSON list or of an object with `tracks`; `valid` is false where a duration is not."""
    wrapped = F.when(F.ltrim(body).startswith("["), F.concat(F.lit('{"tracks":'), F.col(body), F.lit("}"))).otherwise(F.col(body))
    keep = [c for c in docs.columns if c != body]
    j = docs.select(*keep, parsed(wrapped, JSON_SCHEMA).alias("_d"))
    meta = [F.coalesce(F.trim(F.col(f"_d.{k}")), F.lit("")).alias(f"list_{k}") for k in METADATA_KEYS]
    t = j.select(*keep, *meta, F.posexplode("_d.tracks").alias("_p", "t"))
    t = t.withColumn("_given", F.coalesce(F.nullif(F.col("t.duration"), F.lit("")), F.nullif(F.col("t.length"), F.lit(""))))
    t = t.withColumn("_s", duration(F.col("_given")))
    title = F.coalesce(F.nullif("t.title", F.lit("")), F.nullif("t.name", F.lit("")))
    return t.select(
        *keep, (F.col("_p") + 1).alias("position"),
        F.trim(F.coalesce(title, F.concat(F.lit("Track "), F.lpad((F.col("_p") + 1).cast("string"), 2, "0")))).alias("title"),
        F.col("_s.seconds").alias("duration"), (F.col("_given").isNull() | F.col("_s.valid")).alias("valid"),
        F.trim(F.coalesce("t.artist", F.lit(""))).alias("artist"), F.trim(F.coalesce("t.side", F.lit(""))).alias("side"),
        *[f"list_{k}" for k in METADATA_KEYS],
    )


def text_lines(docs: DataFrame, body: str = "body") -> DataFrame:
    """Meaningful lines with `kind` metadata or track; comments and blank lines are gone."""
    keep = [c for c in docs.columns if c != body]
    raw = docs.select(*keep, F.posexplode(F.split(F.regexp_replace(body, "^﻿", ""), r"\r\n|\r|\n")).alias("line_ix", "_l"))
    ln = raw.withColumn("line", F.trim("_l")).where("line <> '' and not startswith(line, '#')")
    key = F.replace(F.lower(F.trim(F.substring_index("line", ":", 1))), F.lit(" "), F.lit("_"))
    value = F.trim(F.expr("substring(line, instr(line, ':') + 1)"))
    meta = F.contains("line", F.lit(":")) & key.isin(*METADATA_KEYS) & (value != "")
    return ln.select(
        *keep, "line_ix", "line", F.when(meta, "metadata").otherwise("track").alias("kind"),
        F.when(meta, key).alias("key"), F.when(meta, value).alias("value"),
    )


def parse_text(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per track line: number dropped, last field taken as duration where it is one.

    The position counts track lines inside their document, over the array of its lines.
    """
    keep = [c for c in docs.columns if c != body]
    lines = text_lines(docs, body).where("kind = 'track'")
    f = lines.withColumn("_f", F.filter(F.transform(F.split("line", r"\t|\s*\|\s*"), lambda x: F.trim(x)), lambda x: x != ""))
    f = f.withColumns({"_any": F.size("_f") > 0, "_d": duration(F.try_element_at("_f", F.lit(-1)))})
    timed = (F.size("_f") > 1) & F.col("_d.valid")
    f = f.withColumn("duration", F.when(timed, F.col("_d.seconds"))).withColumn(
        "_f", F.when(timed, F.slice("_f", F.lit(1), F.size("_f") - 1)).otherwise(F.col("_f")))
    numbered = (F.size("_f") > 1) & F.element_at("_f", 1).rlike(NUMBER_FIELD)
    f = f.withColumn("_f", F.when(numbered, F.slice("_f", F.lit(2), F.size("_f"))).otherwise(F.col("_f")))
    f = f.withColumn("_t", bare_title(F.regexp_replace(F.array_join("_f", " | "), LEADING_NUMBER, "")))
    # A line without fields is left out here: a filter on it would have Spark cut each line into fields twice.
    track = F.when(F.col("_any"), F.struct("line_ix", "_t", "duration"))
    tracks = f.groupBy(*keep).agg(F.array_sort(F.collect_list(track)).alias("_a"))
    out = tracks.select(*keep, F.posexplode("_a").alias("_p", "t"))
    position = F.col("_p") + 1
    return out.select(*keep, position.alias("position"), title_or_number(F.col("t._t"), position).alias("title"), F.col("t.duration").alias("duration"))


def reference_reasons(tracks: DataFrame, provenance: DataFrame, key: str) -> DataFrame:
    """Why a reference list cannot be used: missing, invalid or oversized durations; unconfirmed provenance."""
    agg = tracks.groupBy(key).agg(
        F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("duration").isNull()).alias("_missing"),
        F.count_if(~F.col("valid")).alias("_bad"), F.count_if(F.col("duration") > 86400.0).alias("_long"))
    j = agg.join(provenance, key, "left")
    return j.select(key, "tracks", "independent", F.array_compact(F.array(
        F.when(F.col("_bad") > 0, "duration_invalid"), F.when(F.col("_missing") > 0, "duration_missing"),
        F.when(F.col("_long") > 0, "duration_too_long"), F.when(F.col("independent").isNull(), "provenance_unconfirmed"),
    )).alias("reasons"))
