"""Release catalogue and recognition payloads as nested JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined_credit, plain_credit, side_code

CREDIT = "array<struct<name:string,joinphrase:string>>"
TRACK = f"struct<id:string,number:string,position:int,title:string,length:bigint,`artist-credit`:{CREDIT}>"
RELEASE_SCHEMA = (
    "id string, title string, date string, country string, status string, barcode string, score int, "
    f"`track-count` int, `artist-credit` {CREDIT}, "
    "`label-info` array<struct<label:struct<name:string>,`catalog-number`:string>>, "
    "`cover-art-archive` struct<artwork:boolean,front:boolean,back:boolean,count:int>, "
    f"media array<struct<position:int,format:string,title:string,`track-count`:int,tracks:array<{TRACK}>>>"
)
MATCH_SCHEMA = (
    f"results array<struct<score:string,recordings:array<struct<id:string,title:string,artists:{CREDIT},"
    "releasegroups:array<struct<id:string,title:string,type:string,releases:array<struct<id:string,title:string,"
    "country:string,date:string,status:string>>>>>>>>"
)


def parsed(body: Column, schema: str) -> Column:
    """The value of a JSON text, as a generator of one row: each text is then built and parsed once, where a plain column
    would be copied by Spark into the filters of later steps."""
    return F.explode(F.array(F.from_json(body, schema)))


def parse_releases(docs: DataFrame, body: str = "body") -> DataFrame:
    keep = [c for c in docs.columns if c != body]
    return docs.select(*keep, parsed(F.col(body), RELEASE_SCHEMA).alias("r")).where("r.id is not null")


def release_summary(parsed: DataFrame) -> DataFrame:
    """Compact facts: first label with any text, distinct formats in order, track count, artwork flags."""
    label = F.element_at(F.filter(
        "r.label-info", lambda x: (F.coalesce(x["label"]["name"], F.lit("")) != "") | (F.coalesce(x["catalog-number"], F.lit("")) != "")), 1)
    media = F.coalesce(F.col("r.media"), F.array().cast(f"array<struct<position:int,format:string,title:string,`track-count`:int,tracks:array<{TRACK}>>>"))
    formats = F.array_distinct(F.filter(F.transform(media, lambda m: F.trim(F.coalesce(m["format"], F.lit("")))), lambda f: f != ""))
    counted = F.aggregate(media, F.lit(0), lambda a, m: a + F.greatest(F.lit(0), F.coalesce(m["track-count"], F.lit(0))))
    art = F.col("r.cover-art-archive")
    off = F.lit(False)
    keep = [c for c in parsed.columns if c != "r"]
    return parsed.select(
        *keep, F.col("r.id").alias("release_id"), F.coalesce("r.title", F.lit("")).alias("title"),
        plain_credit(F.col("r.artist-credit")).alias("artist"), F.coalesce("r.date", F.lit("")).alias("date"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("r.score", F.lit(0)))).alias("score"),
        formats.alias("formats"), F.trim(F.coalesce(label["label"]["name"], F.lit(""))).alias("label"),
        F.trim(F.coalesce(label["catalog-number"], F.lit(""))).alias("catalog_number"),
        F.when(counted > 0, counted).otherwise(F.coalesce("r.track-count", F.lit(0))).alias("track_count"),
        F.coalesce(art["artwork"], off).alias("has_artwork"), F.coalesce(art["front"], off).alias("front"),
    )


def release_tracks(parsed: DataFrame) -> DataFrame:
    """Every track of every medium; sides come from the number, and only on vinyl media."""
    keep = [c for c in parsed.columns if c != "r"]
    m = parsed.select(*keep, F.col("r.id").alias("release_id"), F.col("r.artist-credit").alias("_ra"), F.posexplode("r.media").alias("_mp", "m"))
    t = m.select(*keep, "release_id", "_ra", F.coalesce(F.when(F.col("m.position") >= 1, F.col("m.position")), F.col("_mp") + 1).alias("medium"),
                 F.coalesce("m.format", F.lit("")).alias("format"), F.posexplode("m.tracks").alias("_tp", "t"))
    number = F.trim(F.coalesce(F.nullif("t.number", F.lit("")), (F.col("_tp") + 1).cast("string")))
    side, pos = side_code(number)
    vinyl = F.contains(F.lower("format"), F.lit("vinyl"))
    own = plain_credit(F.col("t.artist-credit"))
    return t.select(
        *keep, "release_id", "medium", "format", F.greatest(F.lit(1), F.coalesce("t.position", F.col("_tp") + 1)).alias("position"),
        number.alias("number"), F.trim(F.coalesce("t.title", F.lit(""))).alias("title"),
        F.when(own != "", own).otherwise(plain_credit(F.col("_ra"))).alias("artist"),
        F.bround(F.col("t.length") / 1000.0, 3).alias("duration"),
        F.when(vinyl, side).otherwise("").alias("side"), F.when(vinyl & (side != ""), pos).alias("side_position"),
    )


def parse_matches(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per (document, recording id, title, artist): best score and the union of its releases.

    Scores are clipped to 0..1, anything that is no finite number counts 0. A document is read once; what meets in a key
    comes from one document, so it is no more than one text holds.
    """
    keep = [c for c in docs.columns if c != body]
    r = docs.select(*keep, F.posexplode(F.from_json(body, MATCH_SCHEMA)["results"]).alias("_rp", "r"))
    raw = F.col("r.score").try_cast("double")
    score = F.when(raw.isNull() | F.isnan(raw) | (F.abs(raw) > 1e300), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    rec = r.select(*keep, "_rp", score.alias("score"), F.posexplode("r.recordings").alias("_cp", "c"))
    rec = rec.where(F.trim(F.coalesce("c.title", F.lit(""))) != "").select(
        *keep, "score", F.struct("_rp", "_cp").alias("_at"), F.coalesce(F.trim("c.id"), F.lit("")).alias("recording_mbid"),
        F.trim("c.title").alias("title"), joined_credit(F.col("c.artists")).alias("artist_credit"), F.col("c.releasegroups").alias("_g"))
    rec = rec.withColumn("_kt", F.lower("title")).withColumn("_ka", F.lower("artist_credit"))
    key = [*keep, "recording_mbid", "_kt", "_ka"]
    named = lambda x, g: F.struct(
        F.coalesce(x["id"], F.lit("")).alias("rid"), F.lower(F.coalesce(x["title"], F.lit(""))).alias("rt"), F.coalesce(g["id"], F.lit("")).alias("gid"))
    groups = F.filter("_g", lambda g: g["releases"].isNotNull())
    of_group = lambda g: F.transform(F.filter(g["releases"], lambda x: x.isNotNull()), lambda x: named(x, g))
    rel = F.filter(F.flatten(F.transform(groups, of_group)), lambda x: (x["rid"] != "") | (x["rt"] != ""))
    # The earliest of the best-scored spellings is shown.
    lead = F.max(F.struct("score", (-F.col("_at._rp")).alias("a"), (-F.col("_at._cp")).alias("b"), "title", "artist_credit"))
    best = rec.groupBy(*key).agg(lead.alias("_b"), F.array_distinct(F.flatten(F.collect_list(rel))).alias("_rel"))
    return best.select(
        *keep, "recording_mbid", F.col("_b.title").alias("title"), F.col("_b.artist_credit").alias("artist_credit"),
        F.col("_b.score").alias("score"), F.size("_rel").cast("bigint").alias("release_count"))


def match_releases(docs: DataFrame, body: str = "body") -> DataFrame:
    """Distinct (id, title without case, group) releases per document, the first spelling kept."""
    keep = [c for c in docs.columns if c != body]
    r = docs.select(*keep, F.posexplode(F.from_json(body, MATCH_SCHEMA)["results"]).alias("_a", "r"))
    c = r.select(*keep, "_a", F.posexplode("r.recordings").alias("_b", "c")).select(*keep, "_a", "_b", F.posexplode("c.releasegroups").alias("_c", "g"))
    x = c.select(*keep, "_a", "_b", "_c", F.coalesce("g.id", F.lit("")).alias("release_group"), F.posexplode("g.releases").alias("_d", "x"))
    x = x.select(*keep, "release_group", F.coalesce("x.id", F.lit("")).alias("release"), F.struct("_a", "_b", "_c", "_d", F.coalesce("x.title", F.lit("")).alias("title")).alias("_f"))
    return x.groupBy(*keep, "release", "release_group", F.lower("_f.title").alias("_t")).agg(F.min("_f")["title"].alias("title")).drop("_t")
