"""Navigation text, chapters and per-track samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK
from ..functions.levels import cue_time
from ..functions.text import cue_quoted
from ..operators.intervals import overlapping


def cue_starts(tracks: DataFrame, counted: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Adds whether a track is its album's first and whether it opens a side or a file.

    Reads (album, side_order, album_number, file_path) only: texts that are made behind it are not sorted. `counted` may
    name a cheaper table with the same rows for each album.
    """
    from ..operators.ordered import dense_index, long_keys, windowed

    before = {"_f": lambda w: F.lag("file_path").over(w), "_s": lambda w: F.lag("side_order").over(w)}
    order = ["side_order", "album_number"]
    if long_keys(tracks if counted is None else counted, ["album"], chunk) is None:
        w = Window.partitionBy("album").orderBy(*order)
        prev = tracks.select("*", F.row_number().over(w).alias("_ix"), *[f(w).alias(n) for n, f in before.items()])
        first = F.col("_ix") == 1
    else:
        ix = dense_index(tracks, ["album"], order, F.expr("side_order div 64"), "_ix", chunk=chunk, counted=counted)
        prev = windowed(ix, ["album"], "_ix", 1, 0, before, chunk)
        first = F.col("_ix") == 0
    return prev.withColumns({
        "_first": first, "_new_side": ~F.col("side_order").eqNullSafe(F.col("_s")), "_new_file": ~F.col("file_path").eqNullSafe(F.col("_f"))}).drop("_ix", "_f", "_s")


def cue_line_counts(tracks: DataFrame) -> DataFrame:
    """(album, cue_lines): how many lines cue_lines() gives an album, without writing them."""
    one = lambda c: F.col(c).cast("bigint")
    lines = 4 + 3 * one("_first") + one("_new_side") + one("_new_file")
    return cue_starts(tracks).groupBy("album").agg(F.sum(lines).alias("cue_lines"))


def cue_lines(tracks: DataFrame, rate: int) -> DataFrame:
    """Lines of each album's cue sheet with their place: (album, side_order, album_number, line_no, line).

    tracks: (album, side_order, label, album_number, title, artist, file_path, file_start, album_title,
    album_artist). A side's tracks share files in order; a FILE line opens each new one.
    """
    return started_lines(cue_starts(tracks), rate)


def started_lines(started: DataFrame, rate: int) -> DataFrame:
    """cue_lines() of tracks that come from cue_starts()."""
    first, new_side, new_file = F.col("_first"), F.col("_new_side"), F.col("_new_file")
    line = lambda n, text, cond=None: F.when(F.lit(True) if cond is None else cond, F.struct(F.lit(n).alias("line_no"), text.alias("line")))
    number = F.lpad(F.col("album_number").cast("string"), 2, "0")
    rows = F.array(
        line(0, F.lit('REM INDEX_PRECISION "75 fps approximate"'), first),
        line(1, F.concat(F.lit("PERFORMER "), cue_quoted(F.col("album_artist"))), first),
        line(2, F.concat(F.lit("TITLE "), cue_quoted(F.col("album_title"))), first),
        line(3, F.concat(F.lit("REM SIDE "), cue_quoted(F.col("label"))), new_side),
        line(4, F.concat(F.lit("FILE "), cue_quoted(F.col("file_path")), F.lit(" WAVE")), new_file),
        line(5, F.concat(F.lit("  TRACK "), number, F.lit(" AUDIO"))),
        line(6, F.concat(F.lit("    TITLE "), cue_quoted(F.col("title")))),
        line(7, F.concat(F.lit("    PERFORMER "), cue_quoted(F.col("artist")))),
        line(8, F.concat(F.lit("    INDEX 01 "), cue_time(F.col("file_start"), F.lit(rate)))),
    )
    lines = started.select("album", "side_order", "album_number", F.explode(rows).alias("l")).where("l is not null")
    return lines.select("album", "side_order", "album_number", "l.*")


def write_cues(lines: DataFrame, path: str) -> None:
    """One text file per album: an album has at most 99 tracks, so its sheet is one short value."""
    body = lines.groupBy("album").agg(F.array_sort(F.collect_list(F.struct("side_order", "album_number", "line_no", "line"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    body.select("album", text.alias("value")).write.mode("errorifexists").partitionBy("album").text(path)


def chapters(tracks: DataFrame) -> DataFrame:
    """Exact coordinates of an album as one JSON text: sides in order, their tracks in order (at most 99)."""
    t = F.struct("number", "start_sample", "end_sample")
    side = tracks.groupBy("album", "side_order", "label").agg(F.array_sort(F.collect_list(t)).alias("tracks"))
    return side.groupBy("album").agg(F.to_json(F.array_sort(F.collect_list(F.struct("side_order", "label", "tracks")))).alias("chapters"))


def track_blocks(blocks: DataFrame, tracks: DataFrame, block: int) -> DataFrame:
    """The part of each block that belongs to each track: the table of extracted tracks, still in blocks.

    tracks: (capture_id, number, start_sample, end_sample).
    """
    b = blocks.withColumn("start_ix", F.col("start_sample")).withColumn("end_ix", F.col("start_sample") + F.col("n"))
    t = tracks.select("capture_id", "number", F.col("start_sample").alias("r_start"), F.col("end_sample").alias("r_end"))
    j = overlapping(b, t, ["capture_id"], bucket=block)
    first, last = F.greatest("start_ix", "r_start"), F.least("end_ix", "r_end")
    return j.select(
        "capture_id", "channel", "number", "block_ix", (first - F.col("r_start")).alias("track_sample"), (last - first).cast("int").alias("n"),
        F.slice("samples", (first - F.col("start_ix") + 1).cast("int"), (last - first).cast("int")).alias("samples"))


def write_tracks(parts: DataFrame, path: str) -> None:
    parts.repartition("capture_id", "number", F.expr("block_ix div 64")).sortWithinPartitions("capture_id", "number", "track_sample").write.mode(
        "errorifexists").partitionBy("capture_id", "number").parquet(path)
