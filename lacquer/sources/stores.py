"""Document stores: content-addressed records, artifact names, sinks, schema steps, pins and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Artifact kinds by file name: fixed patterns.
ARTIFACTS = {
    "scan": r"^scan-([0-9a-z]{1,64})\.json$",
    "recipe": r"^recipe-([0-9a-z]{1,64})\.json$",
    "preview": r"^preview-([0-9a-z]{1,64})\.json$",
    "render": r"^render-([0-9a-z]{1,64})\.json$",
}
MAX_CHECKPOINTS = 20
MAX_HISTORY = 100
MAX_HISTORY_BYTES = 16 * 1024 * 1024


def read_records(spark, path: str) -> DataFrame:
    """(name, body) of a folder of hash-named records."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9a-f]{64})\.json$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("name"), F.col("value").alias("body"))


def verified_records(records: DataFrame, body: str = "body", name: str = "name") -> DataFrame:
    """Records with `intact`: the content's hash is the name."""
    return records.withColumn("sha256", F.sha2(body, 256)).withColumn("intact", F.col("sha256") == F.col(name))


def classify_artifacts(files: DataFrame, name: str = "file_name") -> DataFrame:
    kind, token = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, pattern in ARTIFACTS.items():
        hit = F.col(name).rlike(pattern)
        kind = F.when(hit, k).otherwise(kind)
        token = F.when(hit, F.regexp_extract(name, pattern, 1)).otherwise(token)
    return files.withColumn("kind", kind).withColumn("token", token).where("kind is not null")


def new_records(store: DataFrame, incoming: DataFrame, body: str = "body") -> DataFrame:
    """What an append would add: contents the store does not hold, each once."""
    fresh = incoming.withColumn("sha256", F.sha2(body, 256)).dropDuplicates(["sha256"])
    held = store.select(F.sha2(body, 256).alias("sha256")).distinct()
    return fresh.join(held, "sha256", "left_anti")


def append_records(store: DataFrame, incoming: DataFrame, path: str, body: str = "body") -> None:
    new_records(store, incoming, body).write.mode("append").parquet(path)


def export_records(store: DataFrame, body: str = "body") -> DataFrame:
    """Each content once with its hash; `write` sorts by hash. Also the form the count is taken from."""
    return store.withColumn("sha256", F.sha2(body, 256)).dropDuplicates(["sha256"])


def write_export(store: DataFrame, path: str, body: str = "body") -> DataFrame:
    """Writes the contents ordered by hash over files of consecutive ranges, none through one task, and returns the
    manifest of what was written: (file, first, last, records, offset, ordered).

    The manifest is read back from the files: `offset` counts the records of the files before, and `ordered` says that
    a file begins after the last one ended and that its records are sorted and distinct in themselves.
    """
    spark = store.sparkSession
    export_records(store, body).repartitionByRange("sha256").sortWithinPartitions("sha256").write.mode("errorifexists").parquet(path)
    return export_manifest(spark.read.parquet(path))


def export_manifest(export: DataFrame) -> DataFrame:
    """The manifest of a written export. Records are compared with the one before in the file's own order, in bounded
    batches; over the edges of files, and of their parts that were read apart, there is one row each."""
    import pandas as pd

    def runs(batches):
        last = {}
        for pdf in batches:
            for name, part in pdf.groupby(["file", "block"], sort=False):
                keys = part["sha256"].tolist()
                before = [last.get(name), *keys[:-1]]
                ok = all(b is None or b < k for b, k in zip(before, keys))
                last[name] = keys[-1]
                yield pd.DataFrame([(*name, keys[0], keys[-1], len(keys), ok)], columns=["file", "block", "first", "last", "records", "sorted"])

    rows = export.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), "sha256")
    parts = rows.mapInPandas(runs, "file string, block bigint, first string, last string, records bigint, sorted boolean").groupBy("file", "block").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("records").alias("records"), F.min("sorted").alias("sorted"))
    order = Window.orderBy("first")
    near = parts.withColumn("sorted", F.col("sorted") & F.coalesce(F.lag("last").over(order) < F.col("first"), F.lit(True))
                            & ((F.lag("file").over(order) != F.col("file")) | (F.lag("block").over(order) < F.col("block")) | F.lag("file").over(order).isNull()))
    files = near.groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("records").alias("records"), F.min("sorted").alias("sorted"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return files.select(
        F.element_at(F.split("file", "/"), -1).alias("file"), "first", "last", "records", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("offset"),
        (F.col("sorted") & F.coalesce(F.lag("last").over(order) < F.col("first"), F.lit(True))).alias("ordered"))


def without_records(store: DataFrame, doomed: DataFrame, body: str = "body") -> DataFrame:
    """The store after removing exactly the named hashes."""
    return store.withColumn("sha256", F.sha2(body, 256)).join(doomed.select("sha256").distinct(), "sha256", "left_anti")


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a proposal table once; an existing one is never replaced."""
    if fmt not in ("parquet", "json"):
        raise ValueError("format is parquet or json")
    df.write.mode("errorifexists").format(fmt).save(path)


def extra_keys(docs: DataFrame, allowed: list[str], body: str = "body") -> DataFrame:
    """Unknown and missing top-level keys of each JSON document."""
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    want = F.array(*[F.lit(k) for k in allowed])
    return docs.withColumn("unknown_keys", F.array_sort(F.array_except(keys, want))).withColumn(
        "missing_keys", F.array_sort(F.array_except(want, keys)))


PROJECT_SCHEMA = (
    "schema_version int, title string, "
    "source struct<filename:string,sample_rate:int,channels:int,bits_per_raw_sample:int,sample_count:bigint>, "
    "tracks array<struct<number:int,title:string,side:string,start_sample:bigint,end_sample:bigint>>, "
    "metadata map<string,string>"
)


def read_projects(docs: DataFrame, body: str = "body") -> DataFrame:
    """Strictly typed project documents; one that does not parse raises instead of yielding nulls."""
    return docs.withColumn("project", F.from_json(body, PROJECT_SCHEMA, {"mode": "FAILFAST"})).drop(body)


def pin_state(album: DataFrame, current: DataFrame, fields: list[str], selected: Column) -> DataFrame:
    """Refresh the pins of selected sides from the current state; other sides keep theirs.

    album: (album, label, fields...); current: the same keyed by (album, label). `reason` names labels that
    exist nowhere and those that the current state holds more than once; neither is repinned.
    """
    now = current.groupBy("album", "label").agg(
        F.count(F.lit(1)).alias("_has"), *[F.min(f).alias("now_" + f) for f in fields])
    j = album.join(now, ["album", "label"], "left")
    pick = selected & F.coalesce(F.col("_has") == 1, F.lit(False))
    return j.select(
        "album", "label", *[F.when(pick, F.col("now_" + f)).otherwise(F.col(f)).alias(f) for f in fields],
        F.when(selected & F.col("_has").isNull(), "unknown_label").when(selected & (F.col("_has") > 1), "repeated_label").alias("reason"),
        pick.alias("repinned"))


def latest_checkpoints(events: DataFrame, most: int = MAX_CHECKPOINTS) -> DataFrame:
    """State of each named checkpoint after all set and remove events, and `expired`: not among the `most` newest of
    its project.

    events: (project_id, name_key, sequence, action, state). The last event of a name wins.
    """
    last = events.groupBy("project_id", "name_key").agg(F.max(F.struct("sequence", "action", "state")).alias("e"))
    live = last.where("e.action = 'set'").select("project_id", "name_key", F.col("e.sequence").alias("sequence"), F.col("e.state").alias("state"))
    top = newest(live, most).select("project_id", "name_key", F.lit(False).alias("_in"))
    return live.join(top, ["project_id", "name_key"], "left").withColumn("expired", F.coalesce("_in", F.lit(True))).drop("_in")


def newest(rows: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """The `most` highest sequences per project: first per salt, then overall, so a hot project is cut down in parallel."""
    order = F.col("sequence").desc()
    s = rows.withColumn("_salt", F.pmod(F.col("sequence"), F.lit(salts)))
    some = s.withColumn("_r", F.row_number().over(Window.partitionBy("project_id", "_salt").orderBy(order))).where(F.col("_r") <= most)
    out = some.withColumn("_r", F.row_number().over(Window.partitionBy("project_id").orderBy(order))).where(F.col("_r") <= most)
    return out.drop("_r", "_salt")


def retained_history(history: DataFrame, most: int = MAX_HISTORY, most_bytes: int = MAX_HISTORY_BYTES) -> DataFrame:
    """The history with `expired`, true beyond the newest `most` entries of a project or beyond `most_bytes` summed up
    from the newest; the newest one never expires. Nothing is dropped.

    history: (project_id, sequence, bytes). Only the newest `most` of a project can stay, so only those are summed.
    """
    top = newest(history, most)
    run = Window.partitionBy("project_id").orderBy(F.col("sequence").desc()).rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("project_id").orderBy(F.col("sequence").desc())
    kept = top.withColumn("_b", F.sum("bytes").over(run)).withColumn("_n", F.row_number().over(first)).where(
        (F.col("_b") <= most_bytes) | (F.col("_n") == 1)).select("project_id", "sequence", F.lit(False).alias("_in"))
    return history.join(kept, ["project_id", "sequence"], "left").withColumn("expired", F.coalesce("_in", F.lit(True))).drop("_in")
