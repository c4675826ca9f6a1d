"""Capture metadata and review receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stores import extra_keys

RECEIPT_SCHEMA = (
    "project_sha256 string, revision int, state_sha256 string, source_sha256 string, ranges_sha256 string, "
    "all_reviewed boolean, independent boolean"
)


def scan_files(spark, path: str, pattern: str = "*") -> DataFrame:
    """Size, modification time and content hash of every file under `path`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("size_bytes"),
        (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), F.sha2("content", 256).alias("sha256"))


def sample_count(duration_ts: Column, numerator: Column, denominator: Column, rate: Column) -> Column:
    """round(duration_ts * numerator * rate / denominator), halves to even."""
    return F.bround(duration_ts * numerator * rate / denominator).cast("bigint")


def parse_receipts(docs: DataFrame, body: str = "body") -> DataFrame:
    """Receipts with unknown and missing keys beside the typed fields."""
    names = [f.split()[0] for f in RECEIPT_SCHEMA.split(", ")]
    keyed = extra_keys(docs, names, body)
    return keyed.withColumn("_r", F.from_json(body, RECEIPT_SCHEMA)).select(
        *[c for c in keyed.columns if c != body], "_r.*")
