"""A training corpus from `documents`, in stages; each is written as Parquet and read again by the next.

Quality rules drop documents, line dedup takes spread lines out, the Jaccard join keeps one document of each group,
mixing takes each document as often as its source's weight asks, and byte-level BPE encodes what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacquer.llm import bpe, jaccard, lines, mixing, rules
from lacquer.session import shared_folder, stage, unstage

WEIGHTS = [1, 2, 3]


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named c0, c1, ..., so that no name of a stage's own can clash, and the new names."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), {c: f"c{i}" for i, c in enumerate(docs.columns)}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go.

    A null or empty text has no words, so it fails the base rules. Rows are judged each by itself: repeated rows go or
    stay together, an empty table gives an empty one, other columns pass through whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.kept_rows(docs, rules.learned(docs.select("doc_id", "text"), labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources go from documents that have lines of their own; n_chars is counted anew where a text
    changed.

    A null or empty text stays, a null source is a source, rows that repeat a doc_id are cleaned each by their own
    text, an empty table gives an empty one, other columns pass through whatever their names.
    """
    rows, at = plain(docs)
    text, n = at["text"], at["n_chars"]
    out = lines.remove_spread(rows, doc_id=at["doc_id"], text=text, site=at["source"], counts=("lines", "removed"))
    anew = F.when(F.col("removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n))
    return out.withColumn(n, anew).select(rows.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near-equal texts one row stays, that with the least doc_id.

    Rows that repeat a doc_id are linked each by its own text; of those equal in doc_id and text one stays, also
    where the text is null or empty. A row without doc_id stays, an empty table gives an empty one, other columns pass
    through whatever their names.
    """
    named, at = plain(docs)
    own, text = at["doc_id"], at["text"]
    rows = stage(named.withColumn("row", F.when(F.col(own).isNotNull(), F.monotonically_increasing_id())))
    found = jaccard.near_components(rows, doc_id="row", text=text, width=5, percent=80).where("doc_id is not null")
    # rows are numbered as they lie: which of a group stays rests on what they hold
    held = rows.where("row is not null").select(
        "row", F.struct(F.col(own).alias("id"), F.xxhash64(text).alias("tie"), F.xxhash64(*named.columns).alias("all"), "row").alias("held"))
    alone = F.col("n_shingles") == 0
    both = stage(found.withColumnRenamed("doc_id", "row").join(held, "row").select(
        "row", "held", F.when(~alone, F.col("component_id")).alias("c"), F.when(alone, F.col("held.id")).alias("i"),
        F.when(alone, F.col("held.tie")).alias("t"),
    ))
    stays = both.groupBy("c", "i", "t").agg(F.min("held").alias("held")).select("held.row")
    gone = stage(both.select("row").join(stays, "row", "left_anti"))
    unstage(both)
    return rows.join(gone, "row", "left_anti").select(named.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it is taken: not at all, once or repeated.

    A text that is null or has no words is not taken, a null source is a source; rows equal in doc_id, source and text
    are told apart by number and then by their other columns, an empty table gives an empty one, and other columns
    pass through whatever their names.
    """
    named, at = plain(docs)
    own, text, source = at["doc_id"], at["text"], at["source"]
    taken = mixing.mix(named, WEIGHTS, doc_id=own, text=text, source=source).where("copies > 0").select(
        F.col("doc_id").alias("i"), F.col("tie").alias("t"), F.col("source").alias("s"), F.col("nth"), F.col("copies"))
    taken = stage(taken.groupBy("i", "t", "s").agg(F.map_from_entries(F.collect_list(F.struct("nth", "copies"))).alias("copies")))
    rows = named.withColumn("tie", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    both = rows.join(taken, F.col(own).eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")) & F.col(source).eqNullSafe(F.col("s")))
    # rows equal in id, source and text are numbered, as mix() numbers them
    nth = F.row_number().over(Window.partitionBy("i", "t", "s").orderBy(F.xxhash64(*named.columns))).cast("long")
    numbered = both.withColumn("n", nth).withColumn("k", F.element_at("copies", F.col("n"))).where("k > 0")
    return numbered.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k")))).select(named.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with its document's columns but the text.

    A null or empty text has no ids. Rows never meet, so repeated rows give repeated ones and an empty table an empty
    one. Columns named n_tokens, ids, ids_sha256 or decoded_sha256 are replaced; others pass through.
    """
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix_sources), ("byte-level BPE", encode),
]

#: Decision lists are learned, and mixing and BPE are no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents. A stage's table goes when the next one has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, step in STAGES[:-1]:
        path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
