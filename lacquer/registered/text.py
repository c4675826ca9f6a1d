"""Text functions and document sources over lineitem, part, documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import TRACKS, table, tracks
from ..functions import text as tx
from ..sources import catalogs as cat
from ..sources import stores as st
from ..sources import tracklists as tl
from ..sources import upgrades as up
from .common import query

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


@query("b4_duration_parsing", """with x as (select l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity as q, l_partkey % 8 as k from lineitem)
  select l_orderkey, l_partkey, l_linenumber, l_extendedprice, case k when 0 then null when 1 then cast(q as varchar) when 2 then floor(q)::bigint || ':75' when 3 then floor(q)::bigint || ':05' when 4 then '1:' || lpad(floor(q)::bigint::varchar, 2, '0') || ':30.25'
    when 5 then 'nan' when 6 then '-' || q else '1:61:00' end as given,
   case k when 1 then q when 3 then floor(q) * 60 + 5 when 4 then 3600 + floor(q) * 60 + 30.25 end::double as seconds, case when k in (1, 3, 4, 6) then true else false end as valid from x""")
def b4(spark, d):
    q = F.floor("l_quantity").cast("bigint").cast("string")
    k = F.col("l_partkey") % 8
    given = (
        F.when(k == 1, F.col("l_quantity").cast("string")).when(k == 2, F.concat(q, F.lit(":75"))).when(k == 3, F.concat(q, F.lit(":05")))
        .when(k == 4, F.concat(F.lit("1:"), F.lpad(q, 2, "0"), F.lit(":30.25"))).when(k == 5, "nan")
        .when(k == 6, F.concat(F.lit("-"), F.col("l_quantity").cast("string"))).when(k == 7, "1:61:00"))
    li = table(spark, d, "lineitem").withColumn("given", given)
    dd = tx.duration(F.col("given"))
    return li.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "given", dd["seconds"].alias("seconds"), dd["valid"].alias("valid"))


@query("b5_title_cleanup", """select p_partkey, case when p_partkey % 5 = 4 then 'Track ' || lpad(cast(p_partkey % 90 as varchar), 2, '0') else p_name end as title from part""")
def b5(spark, d):
    k = F.col("p_partkey") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit("01. "), F.col("p_name"))).when(k == 1, F.concat(F.lit("A3) "), F.col("p_name")))
        .when(k == 2, F.concat(F.lit("7 "), F.col("p_name"))).when(k == 3, F.col("p_name")).otherwise(F.lit("12 | ")))
    return table(spark, d, "part").select("p_partkey", tx.clean_title(raw, F.col("p_partkey") % 90).alias("title"))


@query("b6_identity_text", r"""select doc_id, sha256(replace(lower(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))), 'ß', 'ss')) as identity_sha256 from documents""")
def b6(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(tx.identity_text(F.col("text")), 256).alias("identity_sha256"))


@query("b6_identity_text_ascii", r"""select doc_id, case when regexp_full_match(text, '[\x00-\x7F]*') then lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) end as identity from documents""")
def b6_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.identity_text_ascii(F.col("text")).alias("identity"))


@query("b7_first_nonblank", """select c_custkey, coalesce(nullif(case when c_custkey % 3 = 0 then '' else trim(c_mktsegment) end, ''), c_name) as value from customer""")
def b7(spark, d):
    c = table(spark, d, "customer")
    blank = F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", tx.first_nonblank(blank, F.col("c_name")).alias("value"))


@query("b8_artist_credit", """select p_partkey, case when p_size % 3 = 0 then p_brand || ' feat. ' || p_type when p_size % 3 = 1 then p_brand || ', ' || p_type else p_type end as credit,
   case when p_size % 3 = 0 then p_brand || ' feat. ' || p_type when p_size % 3 = 1 then p_brand || p_type else p_type end as plain from part""")
def b8(spark, d):
    k = F.col("p_size") % 3
    who = F.when(k == 2, F.lit("")).otherwise(F.col("p_brand"))
    phrase = F.when(k == 0, F.lit(" feat. "))
    arr = F.array(F.struct(who.alias("name"), phrase.alias("joinphrase")), F.struct(F.col("p_type").alias("name"), F.lit(None).cast("string").alias("joinphrase")))
    return table(spark, d, "part").withColumn("a", arr).select("p_partkey", tx.joined_credit(F.col("a")).alias("credit"), tx.plain_credit(F.col("a")).alias("plain"))


@query("b10_portable_names", r"""select page_id, case when n = '' then 'Track' else n end as safe from (select page_id, regexp_replace(trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g')), '[. ]+$', '') as n from pages)""")
def b10(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_name(F.col("url")).alias("safe"))


@query("b10_name_keys", "select page_id, lower(nfc_normalize(url)) as name_key from pages")
def b10_keys(spark, d):
    return table(spark, d, "pages").select("page_id", tx.name_key(F.col("url")).alias("name_key"))


@query("b12_cue_quoting", r"""select doc_id, '"' || replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '"', '''''') || '"' as quoted from documents""")
def b12(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.cue_quoted(F.col("text")).alias("quoted"))


@query("b14_stable_rounding", "select l_orderkey, l_partkey, case when round_even(l_extendedprice / 700 - 50, 9) = 0 then 0.0 else round_even(l_extendedprice / 700 - 50, 9) end::double as x from lineitem")
def b14(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", tx.stable_9(F.col("l_extendedprice") / 700 - 50).alias("x"))


@query("b14_fifteen_digits", "select l_orderkey, l_partkey, cast(format('{:.15g}', l_extendedprice / 700) as double) as x from lineitem")
def b14_digits(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", tx.stable_15(F.col("l_extendedprice") / 700).alias("x"))


@query("b25_side_code", """select l_orderkey, l_partkey, l_linenumber, case when l_partkey % 4 = 3 then '' else upper(l_returnflag) end as side, case when l_partkey % 4 <> 3 then l_linenumber end as position from lineitem""")
def b25(spark, d):
    k, n = F.col("l_partkey") % 4, F.col("l_linenumber").cast("string")
    f = F.col("l_returnflag")
    code = F.when(k == 0, F.concat(f, n)).when(k == 1, F.concat(F.lower(f), F.lit("-0"), n)).when(k == 2, F.concat(f, F.lit(" . 00"), n)).otherwise(n)
    side, pos = tx.side_code(code)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", side.alias("side"), pos.alias("position"))


@query("b28_partial_dates", """select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y') when 1 then strftime(o_orderdate, '%Y-%m') when 2 then strftime(o_orderdate, '%Y-%m-%d') end as d from orders""")
def b28(spark, d):
    k = F.col("o_orderkey") % 5
    t = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM"))
        .when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 3, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30")))
        .otherwise(F.date_format("o_orderdate", "MM/yyyy")))
    return table(spark, d, "orders").select("o_orderkey", tx.partial_date(t).alias("d"))


@query("b29_uuid_check", """select c_custkey, case when c_custkey % 3 = 0 then u end as id from (select c_custkey, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) as u from
   (select c_custkey, sha256(c_name) as h from customer))""")
def b29(spark, d):
    h = F.sha2("c_name", 256)
    u = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    k = F.col("c_custkey") % 3
    v = F.when(k == 0, u).when(k == 1, F.concat(u, F.lit("0"))).otherwise(F.concat(F.lit("{"), u, F.lit("}")))
    return table(spark, d, "customer").select("c_custkey", tx.uuid_or_null(v).alias("id"))


@query("b30_alias_durations", """select l_orderkey, l_partkey, coalesce(case when l_partkey % 2 = 0 then l_quantity end, case when l_partkey % 3 = 0 then l_quantity + 1 end, l_quantity) as value,
   l_partkey % 3 = 0 as conflict from lineitem""")
def b30(spark, d):
    s = F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity"))
    e = F.when(F.col("l_partkey") % 3 == 0, F.col("l_quantity") + 1)
    v, c = tx.aliased_duration(s, e, (F.col("l_quantity") * 1000).cast("bigint"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", v.alias("value"), c.alias("conflict"))


NAMED = TRACKS + """, nm as (select project_id, number, part, side, supplier, t.duration, p_name, p_brand from tracks t join part on p_partkey = part)"""


def named(spark, d, *more):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name", *more)
    return tracks(spark, d, p)


def clock(c):
    s = c.cast("bigint")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def text_docs(spark, d):
    line = F.concat(F.lpad(F.col("number").cast("string"), 2, "0"), F.lit(" | "), F.col("p_name"), F.lit(" | "), clock(F.col("duration")))
    t = named(spark, d).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("number", line.alias("l")))).alias("a"))
    return t.select("project_id", F.concat(F.lit("Artist: someone\n# a comment\n\n"), F.array_join(F.transform("a", lambda x: x["l"]), "\n")).alias("body"))


@query("a4_tracklist_text", "with" + NAMED + " select project_id, cast(number as integer) as position, p_name as title, floor(duration)::double as duration from nm")
def a4(spark, d):
    return tl.parse_text(text_docs(spark, d))


@query("a4_tracklist_metadata", "with" + NAMED + " select distinct project_id, 'artist' as key, 'someone' as value from nm")
def a4_meta(spark, d):
    return tl.text_lines(text_docs(spark, d)).where("kind = 'metadata'").select("project_id", "key", "value")


def json_docs(spark, d):
    item = F.struct("number", F.to_json(F.struct(F.col("p_name").alias("title"), clock(F.col("duration")).alias("duration"), F.col("side"))).alias("j"))
    t = named(spark, d).groupBy("project_id").agg(F.array_sort(F.collect_list(item)).alias("a"))
    body = F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["j"]), ","), F.lit("]"))
    full = F.concat(F.lit('{"artist":"someone","tracks":'), body, F.lit("}"))
    return t.select("project_id", F.when(F.col("project_id") % 2 == 0, body).otherwise(full).alias("body"))


@query("a3_tracklist_json", "with" + NAMED + """ select project_id, cast(number as integer) as position, p_name as title, floor(duration)::double as duration, true as valid, side,
   case when project_id % 2 = 0 then '' else 'someone' end as list_artist from nm""")
def a3(spark, d):
    return tl.parse_json(json_docs(spark, d)).select("project_id", "position", "title", "duration", "valid", "side", "list_artist")


@query("a20_reference_durations", "with" + NAMED + """ select project_id, count(*) as tracks, case project_id % 3 when 0 then true when 1 then false end as independent,
    case when project_id % 3 = 2 then 'provenance_unconfirmed' else '' end as reasons from nm group by 1""")
def a20(spark, d):
    orders = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id")).where("project_id % 3 <> 2").distinct()
    prov = orders.select("project_id", (F.col("project_id") % 3 == 0).alias("independent"))
    out = tl.reference_reasons(tl.parse_json(json_docs(spark, d)), prov, "project_id")
    return out.withColumn("reasons", F.array_join("reasons", ","))


def release_docs(spark, d):
    t = named(spark, d).select("project_id", "side", F.struct(
        "number", F.struct(F.concat(F.col("side"), F.lit("0"), F.col("number").cast("string")).alias("number"), F.col("p_name").alias("title"),
                           (F.col("duration") * 1000 + F.col("part") % 7).cast("bigint").alias("length")).alias("t")).alias("x"))
    m = t.groupBy("project_id", "side").agg(F.array_sort(F.collect_list("x")).alias("a"))
    fmt = F.when(F.col("side") == "A", '12" Vinyl').when(F.col("side") == "R", "CD").otherwise("")
    medium = F.struct(fmt.alias("format"), F.size("a").alias("track-count"), F.transform("a", lambda x: x["t"]).alias("tracks"))
    r = m.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("side", medium.alias("m")))).alias("ms"))
    credit = F.array(F.struct(F.lit("X").alias("name"), F.lit(" & ").alias("joinphrase")), F.struct(F.lit("Y").alias("name"), F.lit(None).cast("string").alias("joinphrase")))
    labels = F.array(F.struct(F.struct(F.lit("").alias("name")).alias("label"), F.lit("").alias("catalog-number")),
                     F.struct(F.struct(F.concat(F.lit("Label "), (F.col("project_id") % 10).cast("string")).alias("name")).alias("label"), F.lit("CAT").alias("catalog-number")))
    doc = F.struct(F.col("project_id").cast("string").alias("id"), F.lit("T").alias("title"), (F.col("project_id") % 130).cast("int").alias("score"),
                   credit.alias("artist-credit"), labels.alias("label-info"),
                   F.struct((F.col("project_id") % 2 == 0).alias("artwork"), F.lit(3).alias("count")).alias("cover-art-archive"),
                   F.transform("ms", lambda x: x["m"]).alias("media"))
    return r.select("project_id", F.to_json(doc).alias("body"))


@query("a5_release_tracks", "with" + NAMED + """, md as (select project_id, side, dense_rank() over (partition by project_id order by side) as medium, row_number() over (partition by project_id, side order by number) as position, number, p_name, duration, part from nm)
  select project_id, cast(medium as integer) as medium, cast(position as integer) as position, p_name as title, 'X & Y' as artist, round_even((duration * 1000 + part % 7) / 1000.0::double, 3) as duration,
   case when side = 'A' then 'A' else '' end as side, case when side = 'A' then cast(number as integer) end as side_position from md""")
def a5(spark, d):
    out = cat.release_tracks(cat.parse_releases(release_docs(spark, d)))
    return out.select("project_id", "medium", "position", "title", "artist", "duration", "side", "side_position")


@query("b9_catalog_fields", "with" + NAMED + """ select project_id, 'Label ' || (project_id % 10) as label, 'CAT' as catalog_number, cast(least(100, project_id % 130) as integer) as score, cast(count(*) as integer) as track_count, project_id % 2 = 0 as has_artwork,
   concat_ws(',', case when bool_or(side = 'A') then '12" Vinyl' end, case when bool_or(side = 'R') then 'CD' end) as formats from nm group by 1""")
def b9(spark, d):
    s = cat.release_summary(cat.parse_releases(release_docs(spark, d)))
    return s.select("project_id", "label", "catalog_number", "score", "track_count", "has_artwork", F.array_join("formats", ",").alias("formats"))


def match_docs(spark, d):
    k = F.col("part")
    arts = F.array(F.struct(F.col("p_brand").alias("name"), F.lit(" feat. ").alias("joinphrase")), F.struct(F.lit("Z").alias("name"), F.lit(None).cast("string").alias("joinphrase")))
    rels = F.array(F.struct(F.concat(F.lit("r"), (k % 5).cast("string")).alias("id"), F.concat(F.when(k % 2 == 0, "REL ").otherwise("Rel "), (k % 5).cast("string")).alias("title")))
    grp = F.array(F.struct(F.concat(F.lit("g"), (k % 2).cast("string")).alias("id"), rels.alias("releases")))
    rec = F.array(F.struct(F.concat(F.lit("rec"), (k % 3).cast("string")).alias("id"), F.col("p_name").alias("title"), arts.alias("artists"), grp.alias("releasegroups")))
    score = F.when(k % 17 == 0, F.lit("oops")).otherwise((F.col("duration") / 40).cast("string"))
    one = F.struct("number", F.struct(score.alias("score"), rec.alias("recordings")).alias("x"))
    t = named(spark, d, "p_brand").groupBy("project_id").agg(F.array_sort(F.collect_list(one)).alias("a"))
    return t.select("project_id", F.to_json(F.struct(F.transform("a", lambda x: x["x"]).alias("results"))).alias("body"))


@query("a6_match_payload", "with" + NAMED + """ select project_id, 'rec' || (part % 3) as recording_mbid, p_name as title, p_brand || ' feat. Z' as artist_credit,
    max(case when part % 17 = 0 then 0 else least(1, greatest(0, duration / 40)) end)::double as score, cast(count(distinct (part % 5, part % 2)) as bigint) as release_count from nm group by all""")
def a6(spark, d):
    return cat.parse_matches(match_docs(spark, d))


@query("h3_release_union", "with" + NAMED + """, x as (select project_id, 'r' || (part % 5) as release, 'g' || (part % 2) as release_group, case when part % 2 = 0 then 'REL ' else 'Rel ' end || (part % 5) as title, number from nm)
  select project_id, release, release_group, arg_min(title, number) as title from x group by all""")
def h3(spark, d):
    return cat.match_releases(match_docs(spark, d))


@query("g4_match_order", "with" + NAMED + """, m as (select project_id, 'rec' || (part % 3) as recording_mbid, p_name as title, p_brand || ' feat. Z' as artist_credit, max(case when part % 17 = 0 then 0 else least(1, greatest(0, duration / 40)) end)::double as score from nm group by all)
  select project_id, recording_mbid, title, cast(row_number() over (partition by project_id order by score desc, lower(title), lower(artist_credit), recording_mbid) as integer) as rank from m""")
def g4(spark, d):
    from ..operators.ordering import rank_matches

    return rank_matches(cat.parse_matches(match_docs(spark, d)), ["project_id"]).select("project_id", "recording_mbid", "title", "rank")


@query("a7_project_documents", "with" + TRACKS + """ select project_id, count(*) as tracks, max(end_sample) as last_sample, case when project_id % 10 = 0 then 'extra' else '' end as unknown_keys, '' as missing_keys from tracks group by 1""")
def a7(spark, d):
    t = tracks(spark, d).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("number").cast("int").alias("number"), F.lit("t").alias("title"), "side", "start_sample", "end_sample"))).alias("tracks"))
    src = F.struct(F.lit("f.flac").alias("filename"), F.lit(1000).alias("sample_rate"), F.lit(2).alias("channels"))
    base = dict(schema_version=F.lit(4), title=F.lit("x"), source=src, tracks=F.col("tracks"), metadata=F.create_map(F.lit("artist"), F.lit("y")))
    plain = F.to_json(F.struct(*[v.alias(k) for k, v in base.items()]))
    odd = F.to_json(F.struct(*[v.alias(k) for k, v in base.items()], F.lit(1).alias("extra")))
    docs = t.select("project_id", F.when(F.col("project_id") % 10 == 0, odd).otherwise(plain).alias("body"))
    p = st.read_projects(st.extra_keys(docs, list(base)).withColumn("copy", F.col("body")))
    ends = F.transform("project.tracks", lambda x: x["end_sample"])
    return p.select("project_id", F.size("project.tracks").cast("bigint").alias("tracks"), F.array_max(ends).alias("last_sample"),
                    F.array_join("unknown_keys", ",").alias("unknown_keys"), F.array_join("missing_keys", ",").alias("missing_keys"))


@query("a8_hash_named_records", "select doc_id, sha256(text) as sha256, doc_id % 9 <> 0 as intact from documents")
def a8(spark, d):
    name = F.when(F.col("doc_id") % 9 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    r = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"), name.alias("name"))
    return st.verified_records(r).select("doc_id", "sha256", "intact")


@query("a9_artifact_names", """select doc_id, case doc_id % 5 when 0 then 'scan' when 1 then 'recipe' when 2 then 'preview' when 3 then 'render' end as kind, cast(doc_id as varchar) as token from documents where doc_id % 5 <> 4""")
def a9(spark, d):
    k = F.array(*[F.lit(x) for x in ("scan", "recipe", "preview", "render", "notes")])
    n = F.concat(F.element_at(k, (F.col("doc_id") % 5 + 1).cast("int")), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".json"))
    return st.classify_artifacts(table(spark, d, "documents").select("doc_id", n.alias("file_name"))).select("doc_id", "kind", "token")


@query("a11_idempotent_append", "select distinct sha256(text) as sha256 from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0)")
def a11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    return st.new_records(docs.where("doc_id % 2 = 0"), docs).select("sha256")


@query("a12_deterministic_export", "select distinct sha256(text) as sha256, length(text) as chars from documents")
def a12(spark, d):
    docs = table(spark, d, "documents").select(F.col("text").alias("body"))
    return st.export_records(docs).select("sha256", F.length("body").cast("bigint").alias("chars"))


@query("a12_export_manifest", "select count(distinct sha256(text))::bigint as records, min(sha256(text)) as first, max(sha256(text)) as last, true as ordered, true as gapless from documents")
def a12_manifest(spark, d):
    import uuid

    from ..session import shared_folder

    docs = table(spark, d, "documents").select(F.col("text").alias("body"))
    m = st.write_export(docs, f"{shared_folder(spark)}/export-{uuid.uuid4().hex}")
    return m.agg(F.sum("records").alias("records"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("ordered").alias("ordered"),
                 (F.max(F.col("offset") + F.col("records")) == F.sum("records")).alias("gapless"))


@query("a13_delete_by_identity", "select doc_id from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 7 = 0)")
def a13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    doomed = docs.where("doc_id % 7 = 0").select(F.sha2("body", 256).alias("sha256"))
    return st.without_records(docs, doomed).select("doc_id")


@query("a17_schema_upgrade", "with" + TRACKS + """ select project_id, 4 as schema_version, case project_id % 3 when 0 then '1->2,2->3,3->4' when 1 then '2->3,3->4' else '3->4' end as steps, count(*) as tracks, 1 as revision,
   sha256(string_agg(number || ':' || start_sample || ':' || end_sample, chr(10) order by number)) as baseline from tracks group by 1""")
def a17(spark, d):
    item = lambda *more: F.array_sort(F.collect_list(F.struct("number", "start_sample", "end_sample", *more)))
    ids = [F.lit("").alias("recording_id"), F.lit("").alias("track_id")]
    t = tracks(spark, d)
    old = F.struct(F.lit("f.flac").alias("filename"))
    new = F.struct(F.lit("f.flac").alias("filename"), F.lit(None).cast("bigint").alias("sample_count"), F.lit("").alias("sha256"))
    pick = lambda r: t.where(F.col("project_id") % 3 == r)
    v1 = pick(0).groupBy("project_id").agg(item().alias("tracks")).withColumn("source", old)
    v2 = pick(1).groupBy("project_id").agg(item(*ids).alias("tracks")).withColumn("source", new)
    v3 = pick(2).groupBy("project_id").agg(item(*ids).alias("tracks")).withColumn("source", new)
    v3 = v3.withColumn("analyzer_baseline", F.lit(None).cast("struct<state_sha256:string,source_sha256:string>")).withColumn(
        "edit_history", F.lit(None).cast("array<string>")).withColumn("checkpoints", F.lit(None).cast("array<string>")).withColumn("revision", F.lit(None).cast("int"))
    out = None
    for v, docs in ((1, v1), (2, v2), (3, v3)):
        u = up.upgrade(docs, v).select("project_id", "schema_version", "steps", F.size("tracks").cast("bigint").alias("tracks"), "revision",
                                       F.col("analyzer_baseline.state_sha256").alias("baseline"))
        out = u if out is None else out.unionByName(u)
    return out


@query("a10_proposal_sink", "select c_custkey, c_name, c_acctbal from customer where c_custkey % 2 = 0")
def a10(spark, d):
    import uuid

    from ..session import shared_folder

    path = f"{shared_folder(spark)}/proposals-{uuid.uuid4().hex}"
    st.write_new(table(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_acctbal"), path)
    return spark.read.parquet(path)
