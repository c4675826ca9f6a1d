"""Validation, drift, catalogue, album and navigation queries over the order tables and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import SIG, TRACKS, sig, table, tracks
from ..functions.levels import cue_time  # noqa: F401
from ..functions.text import identity_text_ascii
from ..operators import drift as dr
from ..operators import ordering
from ..operators import validate as va
from ..operators.intervals import overlapping
from ..operators.ordered import dense_index, windowed
from ..sources import sinks
from ..sources import stores as st
from ..sources.blocks import to_blocks
from .common import digest_sql, query

K = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"


def joined(col):
    return F.array_join(col, ",")


@query("c1_capture_admission", f"""with c as (select {K}, case l_partkey % 6 when 0 then 'a/b.flac' when 1 then 'x.mp3' else 'side.wav' end as filename,
    case l_partkey % 4 when 0 then 'pcm_s16le' when 1 then 'pcm_s24le' when 2 then 'flac' else 'mp3' end as codec, [44100, 48000, 22050, 192000][l_suppkey % 4 + 1] as rate, l_linenumber % 4 as ch,
    case l_suppkey % 5 when 0 then null when 1 then 32 when 2 then 24 else 16 end as bits, (l_quantity - 2) * 600.0::double as dur, cast(l_extendedprice * 2000000 as bigint) as size from lineitem),
  c2 as (select *, case when l_partkey % 11 = 0 then null when l_partkey % 11 = 1 then 0 when l_partkey % 11 = 2 then 5000000000 when l_partkey % 11 = 3 then cast(dur * rate as bigint) + 3 else cast(dur * rate as bigint) end as n from c),
  c3 as (select *, case when filename = 'a/b.flac' then '' when filename = 'x.mp3' then 'mp3' else 'wav' end as ext from c2)
  select {K}, concat_ws(',', case when filename = 'a/b.flac' then 'filename_invalid' end, case when ext <> 'wav' then 'container_not_supported' end,
    case when not (ext = 'wav' and codec in ('pcm_s16le', 'pcm_s24le')) then 'codec_container_not_supported' end, case when rate = 22050 then 'sample_rate_not_supported' end,
    case when ch not in (1, 2) then 'channel_count_not_supported' end, case when bits is null then 'bit_depth_unknown' end, case when bits = 32 then 'bit_depth_not_supported' end,
    case when dur <= 0 then 'duration_invalid' end, case when dur > 21600 then 'duration_exceeds_limit' end, case when size <= 0 then 'source_size_invalid' end, case when size > 68719476736 then 'source_size_exceeds_limit' end,
    case when n is null then 'sample_count_missing' end, case when n <= 0 then 'sample_count_invalid' end, case when n > 4147200000 then 'sample_count_exceeds_limit' end,
    case when n > 0 and n <= 4147200000 and rate <> 22050 and dur > 0 and dur <= 21600 and abs(n - round_even(dur * rate, 0)) > 2 then 'sample_count_inconsistent' end,
    case when n > 0 and n <= 4147200000 and n * ch * ((bits + 7) // 8) > 34359738368 then 'decoded_pcm_exceeds_limit' end) as reasons from c3""")
def c1(spark, d):
    li = table(spark, d, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    c = li.select(
        *K.split(", "), F.when(p % 6 == 0, "a/b.flac").when(p % 6 == 1, "x.mp3").otherwise("side.wav").alias("filename"),
        F.when(p % 4 == 0, "pcm_s16le").when(p % 4 == 1, "pcm_s24le").when(p % 4 == 2, "flac").otherwise("mp3").alias("codec_name"),
        F.element_at(F.array(*[F.lit(x) for x in (44100, 48000, 22050, 192000)]), (s % 4 + 1).cast("int")).alias("sample_rate"),
        (F.col("l_linenumber") % 4).alias("channels"), F.when(s % 5 == 1, 32).when(s % 5 == 2, 24).when(s % 5 > 2, 16).alias("bits_per_raw_sample"),
        ((F.col("l_quantity") - 2) * 600.0).alias("duration_seconds"), (F.col("l_extendedprice") * 2000000).cast("bigint").alias("size_bytes"))
    n = (F.col("duration_seconds") * F.col("sample_rate")).cast("bigint")
    k = p % 11
    c = c.withColumn("sample_count", F.when(k == 1, F.lit(0).cast("bigint")).when(k == 2, F.lit(5000000000)).when(k == 3, n + 3).when(k != 0, n))
    return va.admission(c).select(*K.split(", "), joined("reasons").alias("reasons"))


REG = """
rg as (select l_suppkey as scope_id, l_linestatus || l_orderkey as label, l_partkey * 100 as start_sample, l_partkey * 100 + cast(l_quantity as bigint) * 2 - 4 as end_sample from lineitem)"""


def regions(spark, d):
    p = F.col("l_partkey") * 100
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("scope_id"), F.concat("l_linestatus", F.col("l_orderkey").cast("string")).alias("label"),
        p.alias("start_sample"), (p + F.col("l_quantity").cast("bigint") * 2 - 4).alias("end_sample"))


@query("c6_region_geometry", "with" + REG + """, x as (select *, lag(end_sample) over (partition by scope_id order by start_sample, end_sample, label) as pe, count(*) over (partition by scope_id, label) as n from rg)
  select scope_id, label, start_sample, end_sample, concat_ws(',', case when end_sample <= start_sample then 'empty_region' end, case when start_sample < 1000 or end_sample > 150000 then 'outside_scope' end,
    case when start_sample < pe then 'overlaps_previous' end, case when n > 1 then 'label_repeats' end) as reasons from x""")
def c6(spark, d):
    r = regions(spark, d)
    scopes = r.select("scope_id").distinct().select("scope_id", F.lit(1000).alias("scope_start"), F.lit(150000).alias("scope_end"))
    return va.region_geometry(r, scopes).withColumn("reasons", joined("reasons"))


@query("f24_complement_ranges", "with" + REG + """, u as (select scope_id, start_sample as s, end_sample as e from rg where end_sample > start_sample),
  m as (select *, case when s <= max(e) over (partition by scope_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as o from u),
  g as (select *, sum(o) over (partition by scope_id order by s, e) as grp from m), r as (select scope_id, min(s) as s, max(e) as e from g group by scope_id, grp),
  n as (select *, coalesce(lag(e) over (partition by scope_id order by s), 0) as p from r)
  select scope_id, p as start_sample, s as end_sample from n where s > p union all select scope_id, max(e), 300000 from r group by scope_id having max(e) < 300000""")
def f24(spark, d):
    from ..operators.regions import complement

    r = regions(spark, d).where("end_sample > start_sample")
    scopes = r.select("scope_id").distinct().select("scope_id", F.lit(0).cast("bigint").alias("scope_start"), F.lit(300000).cast("bigint").alias("scope_end"))
    return complement(r, scopes)


@query("f25_tile_ranges", """with s as (select o_orderkey, cast(floor(o_totalprice / 100) as bigint) as n from orders), t as (select o_orderkey, n, unnest(range(0, greatest(n - 500 + 1, 0), 125)) as start_sample from s),
  u as (select o_orderkey, start_sample from t union select o_orderkey, n - 500 from s where n >= 500)
  select o_orderkey, start_sample, start_sample + 500 as end_sample, true as complete from u union all select o_orderkey, 0, n, false from s where n > 0 and n < 500""")
def f25(spark, d):
    from ..operators.regions import tiles

    o = table(spark, d, "orders").select("o_orderkey", F.lit(0).cast("bigint").alias("start_sample"), (F.col("o_totalprice") / 100).cast("bigint").alias("end_sample"))
    return tiles(o, 500, 125, force_last=True, short=True).select("o_orderkey", F.col("tile_start").alias("start_sample"), F.col("tile_end").alias("end_sample"), "complete")


@query("c7_record_strictness", f"""select {K}, concat_ws(',', case when l_partkey % 10 = 0 then 'record_digest_invalid' end, case when l_suppkey % 9 = 0 then 'project_source_disagree' end,
   case when l_quantity < 10 then 'region_invalid' end, case when l_linenumber % 3 = 0 then 'channels_invalid' end, case when l_linenumber % 3 = 1 then 'channel_out_of_range' end) as reasons from lineitem""")
def c7(spark, d):
    h = F.sha2(F.col("l_orderkey").cast("string"), 256)
    n = F.col("l_linenumber") % 3
    r = table(spark, d, "lineitem").select(
        *K.split(", "), F.when(F.col("l_partkey") % 10 == 0, F.upper(F.lit("x"))).otherwise(h).alias("record_sha256"), h.alias("source_sha256"),
        F.when(F.col("l_suppkey") % 9 == 0, F.lit("other")).otherwise(h).alias("project_source_sha256"),
        F.lit(10).alias("start_frame"), F.when(F.col("l_quantity") < 10, 5).otherwise(500).alias("end_frame"), F.lit(1000).alias("sample_count"), F.lit(2).alias("channel_count"),
        F.when(n == 0, F.array(F.lit(1), F.lit(0))).when(n == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1))).alias("channels"))
    return va.record_strictness(r).select(*K.split(", "), joined("reasons").alias("reasons"))


@query("c8_payload_privacy", "select doc_id, case doc_id % 3 when 0 then 'private_key' when 1 then 'key_not_supported' else case when contains(text, '/') or contains(text, chr(92)) then 'path_like_text' else '' end end as problem from documents")
def c8(spark, d):
    docs = table(spark, d, "documents")
    key = F.when(F.col("doc_id") % 3 == 0, "file_path").when(F.col("doc_id") % 3 == 1, "Odd").otherwise("note")
    payload = F.concat(F.lit('{"'), key, F.lit('":'), F.regexp_extract(F.to_json(F.struct("text")), r'^\{"text":(.*)\}$', 1), F.lit("}"))
    return docs.select("doc_id", va.payload_guard(payload).alias("problem"))


EDGES = """
nd as (select distinct l_orderkey as graph, 'p' || l_partkey as node from lineitem union select distinct l_orderkey, 's' || l_suppkey from lineitem where l_suppkey % 40 <> 7),
ed as (select l_orderkey as graph, 'p' || l_partkey as node, 's' || l_suppkey as depends_on from lineitem union all select l_orderkey, 's' || l_suppkey, 'p' || l_partkey from lineitem where l_orderkey % 50 = 0
  union all select l_orderkey, 'p' || l_partkey, 'p' || l_partkey from lineitem where l_partkey % 300 = 5)"""


def graph(spark, d):
    li = table(spark, d, "lineitem")
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    g = F.col("l_orderkey").alias("graph")
    nodes = li.select(g, p.alias("node")).union(li.where("l_suppkey % 40 <> 7").select(g, s.alias("node"))).distinct()
    edges = li.select(g, p.alias("node"), s.alias("depends_on")).union(li.where("l_orderkey % 50 = 0").select(g, s, p)).union(
        li.where("l_partkey % 300 = 5").select(g, p, p))
    return nodes, edges


@query("c9_graph_validation", "with recursive" + EDGES + """,
  lv as (select distinct e.* from ed e semi join nd a on a.graph = e.graph and a.node = e.depends_on semi join nd b on b.graph = e.graph and b.node = e.node where e.node <> e.depends_on),
  rc as (select graph, node, depends_on as tip, 1 as depth from lv union select r.graph, r.node, l.depends_on, r.depth + 1 from rc r join lv l on l.graph = r.graph and l.node = r.tip where r.depth < 6)
  select distinct graph, 'cycle' as code from rc where node = tip union select distinct graph, 'self_edge' from ed where node = depends_on
  union select distinct graph, 'missing_node' from ed where (graph, depends_on) not in (select graph, node from nd)""")
def c9(spark, d):
    return va.graph_problems(*graph(spark, d))


@query("c10_decision_completeness", """with c as (select distinct l_orderkey as scan, l_partkey as event_id from lineitem where l_partkey % 13 <> 0), ca as (select scan, event_id, event_id % 4 <> 0 as repairable from c),
  de as (select l_orderkey as scan, l_partkey as event_id, case l_linenumber % 3 when 0 then 'approved' when 1 then 'protected' else 'rejected' end as decision, case when l_linenumber > 4 then 'x' end as cls from lineitem where l_partkey % 17 <> 0),
  g as (select scan, event_id, count(*) as n, bool_or(decision = 'approved') as a, bool_or(decision = 'protected' and cls is null) as p from de group by 1, 2),
  j as (select coalesce(ca.scan, g.scan) as scan, coalesce(ca.event_id, g.event_id) as event_id, concat_ws(',', case when ca.scan is null then 'unknown_candidate' end, case when n is null then 'undecided' end, case when n > 1 then 'decided_twice' end,
    case when a and not repairable then 'approved_not_repairable' end, case when p then 'protected_without_class' end) as reasons from ca full join g on ca.scan = g.scan and ca.event_id = g.event_id)
  select * from j where reasons <> ''""")
def c10(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_partkey").alias("event_id"), "l_linenumber")
    cands = li.where("event_id % 13 <> 0").select("scan", "event_id").distinct().withColumn("repairable", F.col("event_id") % 4 != 0)
    n = F.col("l_linenumber")
    dec = li.where("event_id % 17 <> 0").select("scan", "event_id", F.when(n % 3 == 0, "approved").when(n % 3 == 1, "protected").otherwise("rejected").alias("decision"),
                                              F.when(n > 4, F.lit("x")).alias("protected_class"))
    return va.decision_problems(cands, dec).withColumn("reasons", joined("reasons"))


@query("h5_decided_equals_retained", """with a as (select distinct l_orderkey as scan, l_partkey as event_id from lineitem where l_partkey % 13 <> 0), b as (select distinct l_orderkey as scan, l_partkey as event_id from lineitem where l_partkey % 17 <> 0)
  select *, 'left' as only_in from (select * from a except select * from b) union all select *, 'right' from (select * from b except select * from a)""")
def h5(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_partkey").alias("event_id"))
    return va.set_difference(li.where("event_id % 13 <> 0"), li.where("event_id % 17 <> 0"))


@query("h2_common_items", "select l_orderkey, cast(count(*) as integer) as common from (select l_orderkey, l_partkey % 12 as h from lineitem group by 1, 2 having count(distinct l_returnflag) = (select count(distinct l_returnflag) from lineitem x where x.l_orderkey = lineitem.l_orderkey)) group by 1")
def h2(spark, d):
    li = table(spark, d, "lineitem").withColumn("h", F.col("l_partkey") % 12)
    groups = li.select("l_orderkey", "l_returnflag").distinct().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("groups"))
    held = li.select("l_orderkey", "l_returnflag", "h").distinct().groupBy("l_orderkey", "h").agg(F.count(F.lit(1)).alias("n"))
    return held.join(groups, "l_orderkey").where("n = groups").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("common"))


@query("c13_rederivation", "with" + TRACKS + " select project_id, number, start_sample + 1 as start_sample, 1::bigint as stored, 0::bigint as derived from tracks where part % 100 = 3 union all select project_id, number, start_sample, 0, 1 from tracks where part % 100 = 3")
def c13(spark, d):
    t = tracks(spark, d).select("project_id", "number", "start_sample", "part")
    stored = t.withColumn("start_sample", F.col("start_sample") + (F.col("part") % 100 == 3).cast("int"))
    return va.rederivation_mismatches(stored.drop("part"), t.drop("part"))


@query("c16_profile_rules", """select l_orderkey, l_partkey, l_linenumber, concat_ws(',', case when l_partkey % 5 = 1 then 'profile_repeats' end, case when l_partkey % 5 = 2 then 'profiles_out_of_order' end,
   case when l_partkey % 5 = 3 then 'outputs_differ' end, case when l_partkey % 5 = 4 then 'prerequisite_missing' end) as reasons from lineitem""")
def c16(spark, d):
    k = F.col("l_partkey") % 5
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    prof = F.when(k == 1, arr("archive", "archive")).when(k == 2, arr("portable", "corrected-lossless")).when(k == 4, arr("portable")).otherwise(arr("corrected-lossless", "portable"))
    out = F.when(k == 3, arr("portable")).otherwise(prof)
    p = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", prof.alias("profiles"), out.alias("outputs"))
    r = va.profile_rules(p, ["archive", "corrected-lossless", "portable"], {"portable": "corrected-lossless"})
    return r.select("l_orderkey", "l_partkey", "l_linenumber", joined("reasons").alias("reasons"))


@query("c16_node_inputs", "select l_orderkey, l_partkey, l_linenumber, case when l_partkey % 3 = 0 then 'input_missing' when l_partkey % 3 = 1 then 'input_unexpected' else '' end as reasons from lineitem")
def c16_inputs(spark, d):
    k = F.col("l_partkey") % 3
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    n = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.lit("render").alias("kind"),
                                           F.when(k == 0, arr("source")).when(k == 1, arr("source", "recipe", "x")).otherwise(arr("recipe", "source")).alias("roles"))
    return va.node_inputs(n, {"render": ["source", "recipe"]}).select("l_orderkey", "l_partkey", "l_linenumber", joined("reasons").alias("reasons"))


STATES = """
sx as (select conv_id as project_id, row_number() over (partition by conv_id order by turn) - 1 as sequence, role, text, length(text) as bytes, sha256(text) as after from conversations)"""


def states(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("project_id"), "turn", "role", "text", F.length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("after"))
    return dense_index(c, ["project_id"], ["turn"], F.expr("turn div 1024"), "sequence")


@query("c14_history_chain", "with" + STATES + """, h as (select *, case when bytes % 7 = 0 then 'x' else lag(after) over w end as b, lag(after) over w as pa from sx window w as (partition by project_id order by sequence)),
  g as (select project_id, count(*) as entries, bool_or(sequence > 0 and bytes % 7 = 0) as br from h group by 1)
  select project_id, entries, concat_ws(',', case when br then 'hash_chain_broken' end, case when project_id % 4 = 0 then 'current_state_differs' end) as reasons from g""")
def c14(spark, d):
    s = states(spark, d)
    h = windowed(s, ["project_id"], "sequence", 1, 0, {"p": lambda w: F.lag("after").over(w)})
    h = h.withColumn("before", F.when(F.col("bytes") % 7 == 0, F.lit("x")).otherwise(F.col("p")))
    last = s.groupBy("project_id").agg(F.max(F.struct("sequence", "after"))["after"].alias("a"))
    cur = last.select("project_id", F.when(F.col("project_id") % 4 == 0, F.lit("moved")).otherwise(F.col("a")).alias("state"))
    return va.history_chain(h, cur).withColumn("reasons", joined("reasons"))


@query("f22_history_retention", "with" + STATES + """, r as (select project_id, sequence, row_number() over w as n, sum(bytes) over w as b from sx window w as (partition by project_id order by sequence desc))
  select project_id, sequence, not (n <= 3 and (b <= 900 or n = 1)) as expired from r""")
def f22(spark, d):
    return st.retained_history(states(spark, d), 3, 900).select("project_id", "sequence", "expired")


@query("f23_transition_inference", "with" + STATES + """, l as (select *, lag(role) over w as pr, lag(bytes) over w as pb, lag(after) over w as pa from sx window w as (partition by project_id order by sequence))
  select project_id, sequence, case when sequence = 0 then '' else concat_ws(',', case when role is distinct from pr then 'speaker changed' end, case when bytes is distinct from pb then 'length changed' end, case when after is distinct from pa then 'text changed' end) end as reasons from l""")
def f23(spark, d):
    out = dr.transitions(states(spark, d), {"role": "speaker changed", "bytes": "length changed", "after": "text changed"})
    return out.select("project_id", "sequence", joined("reasons").alias("reasons"))


@query("a19_checkpoints", "with" + STATES + """, e as (select project_id, bytes % 3 as name_key, sequence, case when bytes % 5 = 0 then 'remove' else 'set' end as action, after from sx),
  l as (select *, row_number() over (partition by project_id, name_key order by sequence desc) as r from e), v as (select *, row_number() over (partition by project_id order by sequence desc) as k from l where r = 1 and action = 'set')
  select project_id, name_key, sequence, after as state, k > 2 as expired from v""")
def a19(spark, d):
    e = states(spark, d).select("project_id", (F.col("bytes") % 3).alias("name_key"), "sequence", F.when(F.col("bytes") % 5 == 0, "remove").otherwise("set").alias("action"), F.col("after").alias("state"))
    return st.latest_checkpoints(e, 2)


PINS = """
pn as (select o_custkey as album, o_orderkey as label, o_orderstatus <> 'P' as pinned, o_orderkey % 7 = 0 as m1, o_orderkey % 11 = 0 as m2, o_orderkey % 13 = 0 as m3 from orders)"""


def pins(spark, d):
    o = table(spark, d, "orders")
    base = lambda c: F.concat(F.lit(c), F.col("o_orderkey").cast("string"))
    k = F.col("o_orderkey")
    key = [F.col("o_custkey").alias("album"), k.alias("label")]
    f = {x: base(x) for x in dr.PIN_DRIFT}
    pin = o.select(*key, (F.col("o_orderstatus") != "P").alias("pinned"), *[v.alias(x) for x, v in f.items()])
    moved = {"project_revision": k % 7 == 0, "source_sha256": k % 11 == 0, "speed_sha256": k % 13 == 0}
    cur = o.select(*key, base("source_sha256").alias("recorded_source"),
                   *[(F.when(moved[x], F.lit("new")).otherwise(v) if x in moved else v).alias(x) for x, v in f.items()])
    return pin, cur


@query("d9_pin_drift", "with" + PINS + """ select album, label, pinned, concat_ws(',', case when not pinned then 'side is unpinned' end, case when pinned and m1 then 'project revision changed' end, case when pinned and m2 then 'source audio changed' end,
   case when pinned and m3 then 'album speed selection changed' end, case when m2 then 'source no longer matches the side project' end) as drift, pinned and not m1 and not m2 and not m3 as ready from pn""")
def d9(spark, d):
    out = dr.pin_drift(*pins(spark, d))
    return out.withColumn("drift", joined("drift"))


@query("a18_repin", "with" + PINS + """ select album, label, case when m1 and label % 2 = 0 then 'new' else 'project_revision' || label end as project_revision, label % 2 = 0 as repinned from pn""")
def a18(spark, d):
    pin, cur = pins(spark, d)
    return st.pin_state(pin, cur, ["project_revision"], F.col("label") % 2 == 0).drop("reason")


@query("d10_plan_identity", """select o_orderkey, field, planned, current from (select o_orderkey, unnest([case when o_orderkey % 17 = 0 then {'field': 'missing', 'planned': null::varchar, 'current': null::varchar} end,
    case when o_orderkey % 19 = 0 and o_orderkey % 17 <> 0 then {'field': 'unexpected', 'planned': null, 'current': null} end, case when o_orderkey % 17 <> 0 and o_orderkey % 19 <> 0 and o_orderkey % 3 = 0 then {'field': 'o_orderstatus', 'planned': o_orderstatus, 'current': 'Z'} end]) as m from orders) x,
    lateral (select m.field as field, m.planned as planned, m.current as current) where m is not null""")
def d10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    plan = o.where("o_orderkey % 19 <> 0 or o_orderkey % 17 = 0")
    cur = o.where("o_orderkey % 17 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "Z").otherwise(F.col("o_orderstatus")))
    return dr.field_mismatches(plan, cur, ["o_orderkey"], ["o_orderstatus", "o_custkey"])


def inventories(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.lit("f/"), k.cast("string"))
    role = F.when(k % 4 == 0, "album-artwork").when(k % 4 == 1, "music-range-side").otherwise("track")
    cols = [path.alias("path"), role.alias("role"), F.col("o_orderpriority").alias("sha256"), F.lit(5).alias("size_bytes"), (k % 8 == 1).alias("validated_render"),
            (k % 2 == 1).alias("has_audio"), F.col("o_orderstatus").alias("profile"), F.lit("flac").alias("codec_name"), F.col("o_custkey").alias("exact_sample_count")]
    a = o.where("o_orderkey % 29 <> 0").select(*cols)
    b = o.where("o_orderkey % 31 <> 0").select(*cols, k.alias("k"))
    b = b.withColumn("sha256", F.when(F.col("k") % 5 == 0, F.lit("other")).otherwise(F.col("sha256"))).withColumn(
        "profile", F.when(F.col("k") % 37 == 0, F.lit("q")).otherwise(F.col("profile"))).withColumn(
        "exact_sample_count", F.when(F.col("k") % 41 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("exact_sample_count"))).withColumn(
        "has_audio", F.when(F.col("k") % 43 == 0, F.lit(False)).otherwise(F.col("has_audio"))).drop("k")
    return a, b


DIFF = """
df as (select 'f/' || o_orderkey as path, o_orderkey as k, o_orderkey % 29 <> 0 and o_orderkey % 31 <> 0 as both_ from orders where not (o_orderkey % 29 = 0 and o_orderkey % 31 = 0)),
mm as (select path, 'inventory_path_mismatch' as code, '' as field from df where not both_ union all select path, 'inventory_semantics_mismatch', 'profile' from df where both_ and k % 37 = 0
 union all select path, 'deterministic_bytes_mismatch', '' from df where both_ and k % 5 = 0 and (k % 4 = 0 or k % 8 = 1) union all select path, 'audio_verification_missing', '' from df where both_ and k % 2 = 1 and k % 43 = 0
 union all select path, 'audio_identity_mismatch', 'exact_sample_count' from df where both_ and k % 2 = 1 and k % 43 <> 0 and k % 41 = 0)"""


@query("d11_inventory_diff", "with" + DIFF + " select * from mm")
def d11(spark, d):
    return dr.inventory_diff(*inventories(spark, d), ["profile"], ["codec_name", "exact_sample_count"])


@query("h4_path_sets", "select 'f/' || o_orderkey as path, case when o_orderkey % 31 = 0 then 'missing' when o_orderkey % 29 = 0 then 'unexpected' else 'common' end as state from orders where not (o_orderkey % 29 = 0 and o_orderkey % 31 = 0)")
def h4(spark, d):
    return dr.path_sets(*inventories(spark, d))


@query("j15_compare_publications", "with" + DIFF + " select code, count(*) as paths from mm group by 1")
def j15(spark, d):
    from ..plans.albums import compare_publications

    return compare_publications(*inventories(spark, d), ["profile"], ["codec_name", "exact_sample_count"])["summary"]


META = """
al as (select c_custkey as album, c_mktsegment as artist, c_name as title from customer),
sd as (select o_custkey as album, o_orderkey as label, case o_orderkey % 3 when 0 then lower(c_mktsegment) || ' ' when 1 then o_orderpriority else '' end as artist, case when o_orderkey % 5 = 0 then 'else' else c_name end as title from orders join customer on c_custkey = o_custkey),
cf as (select album, label, 'artist' as field from sd where label % 3 = 1 union all select album, label, 'title' from sd where label % 5 = 0)"""


def metadata(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("album"), F.col("c_mktsegment").alias("artist"), F.col("c_name").alias("title"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("album"), F.col("o_orderkey").alias("label"), "o_orderpriority")
    k = F.col("label")
    s = o.join(a, "album").select("album", "label", F.when(k % 3 == 0, F.concat(F.lower("artist"), F.lit(" "))).when(k % 3 == 1, F.col("o_orderpriority")).otherwise("").alias("artist"),
                                  F.when(k % 5 == 0, "else").otherwise(F.col("title")).alias("title"))
    return a, s


@query("d14_metadata_conflicts", "with" + META + " select * from cf")
def d14(spark, d):
    a, s = metadata(spark, d)
    return dr.metadata_conflicts(a, s, ["artist", "title"], identity_text_ascii).select("album", "label", "field")


@query("j13_album_exceptions", "with" + PINS + "," + META + """, dd as (select album, label, (not pinned)::int + (pinned and m1)::int + (pinned and m2)::int + (pinned and m3)::int + m2::int as n from pn),
  a as (select album, count(*) as sides, bool_and(n = 0) as ok, sum(n) as dn from dd group by 1), c as (select album, count(*) as reviews from cf group by 1), t as (select o_custkey as album, count(*) as tracks from orders join lineitem on l_orderkey = o_orderkey group by 1)
  select a.album, sides, coalesce(tracks, 0) as tracks, cast(dn + (a.album % 6 = 0)::int as bigint) as blockers, coalesce(reviews, 0) as reviews, ok and a.album % 6 <> 0 as ready from a left join c using (album) left join t using (album)""")
def j13(spark, d):
    from ..plans.albums import album_workbench

    a, s = metadata(spark, d)
    pin, cur = pins(spark, d)
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("label")).join(table(spark, d, "orders").select(F.col("o_custkey").alias("album"), F.col("o_orderkey").alias("label")), "label")
    albums = a.select("album", F.lit("x").alias("album_artist"), "artist", F.when(F.col("album") % 6 == 0, " ").otherwise(F.col("title")).alias("album_title"), F.lit("").alias("title"))
    return album_workbench(pin, cur, a, s, albums, li.groupBy("album", "label").agg(F.count(F.lit(1)).alias("tracks")), ["artist", "title"])["summary"]


@query("e35_album_totals", "select o_custkey as album, count(distinct o_orderkey) as sides, count(l_orderkey) as tracks, bool_and(o_orderstatus <> 'P') as ready, count(distinct case when o_orderstatus = 'P' then o_orderkey end) as blockers from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def e35(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("tracks"))
    o = table(spark, d, "orders").join(n, "o_orderkey", "left").fillna(0, ["tracks"])
    return o.groupBy(F.col("o_custkey").alias("album")).agg(
        F.count(F.lit(1)).alias("sides"), F.sum("tracks").alias("tracks"), F.bool_and(F.col("o_orderstatus") != "P").alias("ready"),
        F.count_if(F.col("o_orderstatus") == "P").alias("blockers"))


@query("e38_storage_estimate", """with x as (select l_orderkey as project_id, cast(sum(l_quantity * 44100) as bigint) as samples, count(*) as tracks, cast(floor(max(l_extendedprice * 100)) as bigint) as src from lineitem group by 1),
  y as (select *, greatest(src, samples * 2 * case when project_id % 3 = 0 then 4 when project_id % 3 = 1 then 2 else 3 end) as stream from x)
  select project_id, cast(src + stream * 2 + 5000 * (tracks * 2 + 1) + (tracks * 2 + 2) * 1048576 as bigint) as export_bytes, cast(stream + 1048576 as bigint) as restoration_bytes from y""")
def e38(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("project_id")).agg(
        F.sum(F.col("l_quantity") * 44100).cast("bigint").alias("samples"), F.count(F.lit(1)).alias("tracks"), F.max(F.col("l_extendedprice") * 100).cast("bigint").alias("source_bytes"))
    k = F.col("project_id") % 3
    p = p.withColumn("channels", F.lit(2)).withColumn("bits", F.when(k == 1, 16).when(k == 2, 24)).withColumn("formats", F.lit(2)).withColumn("artwork_bytes", F.lit(5000))
    return dr.storage_estimate(p)


@query("e40_source_objects", """with s as (select o_custkey as album, sha256(o_orderpriority) as sha256, o_orderkey % 2 as size_bytes, min(o_orderkey) as first_order, count(*) as sides from orders group by all)
  select album, sha256, size_bytes, first_order, sides, 'source-' || lpad(cast(row_number() over (partition by album order by first_order, sha256) as varchar), 2, '0') || '-' || substr(sha256, 1, 12) as object_id from s""")
def e40(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("album"), F.sha2("o_orderpriority", 256).alias("sha256"), (F.col("o_orderkey") % 2).alias("size_bytes"), F.col("o_orderkey").alias("side_order"))
    return dr.source_objects(s)


ART = """
ar as (select o_custkey as project, 'scan-' || o_orderkey as name, 'scan' as kind, o_orderkey as k, o_orderkey % 97 in (0, 1) and (o_orderkey - (o_orderkey % 97 = 1)::int) in (select o_orderkey from orders) as dup0,
   case when o_orderpriority = '1-URGENT' then 'source_changed' else '' end as st, o_orderdate from orders),
sc as (select *, count(*) over (partition by project, k - (k % 97 = 1)::int) > 1 as dup from ar),
rc as (select project, 'recipe-' || k as name, 'recipe' as kind, k, case when k % 21 = 0 or dup then 'missing_dependency' when k % 15 = 0 then 'dependency_hash_mismatch' else '' end as bad, case when st <> '' and k % 21 <> 0 and not dup then 'stale_scan_dependency' else '' end as st, o_orderdate from sc where k % 3 = 0),
rn as (select project, 'render-' || k as name, 'render' as kind, k, case when bad <> '' then 'invalid_dependency' else '' end as bad, case when st <> '' then 'stale_recipe_dependency' else '' end as st, o_orderdate from rc where k % 6 = 0),
al as (select project, name, kind, case when dup then 'duplicate_artifact_identity' else '' end as bad, st, k, o_orderdate from sc union all select project, name, kind, bad, st, k, o_orderdate from rc union all select project, name, kind, bad, st, k, o_orderdate from rn),
cs as (select project, name, kind, case when bad <> '' then 'invalid' when st <> '' then 'stale' else 'current' end as status, case when bad <> '' then bad else st end as reason, k, o_orderdate from al)"""


def artifacts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("k"), "o_orderpriority", F.col("o_orderdate").alias("created_at"))
    name = lambda p: F.concat(F.lit(p), F.col("k").cast("string"))
    sha = lambda p: F.sha2(name(p), 256)
    nil = F.lit(None).cast("string")
    ident = F.concat(F.lit("s"), (F.col("k") - (F.col("k") % 97 == 1).cast("int")).cast("string"))
    scan = o.select("project", name("scan-").alias("name"), F.lit("scan").alias("kind"), ident.alias("artifact_id"), sha("scan-").alias("sha256"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", "source_changed").alias("stale_reason"), "created_at")
    r, n = o.where("k % 3 = 0"), o.where("k % 6 = 0")
    recipe = r.select("project", name("recipe-").alias("name"), F.lit("recipe").alias("kind"), name("r").alias("artifact_id"), sha("recipe-").alias("sha256"), nil.alias("stale_reason"), "created_at")
    render = n.select("project", name("render-").alias("name"), F.lit("render").alias("kind"), name("n").alias("artifact_id"), sha("render-").alias("sha256"), nil.alias("stale_reason"), "created_at")
    d1 = r.select("project", name("recipe-").alias("name"), F.lit("scan").alias("dep_kind"), F.when(F.col("k") % 21 == 0, F.lit("gone")).otherwise(name("scan-")).alias("dep_name"),
                  F.when(F.col("k") % 15 == 0, F.lit("old")).otherwise(sha("scan-")).alias("dep_sha256"))
    d2 = n.select("project", name("render-").alias("name"), F.lit("recipe").alias("dep_kind"), name("recipe-").alias("dep_name"), sha("recipe-").alias("dep_sha256"))
    return scan.unionByName(recipe).unionByName(render), d1.unionByName(d2)


@query("j14_catalog_status", "with" + ART + " select project, name, kind, status, reason from cs")
def j14(spark, d):
    return dr.catalog_status(*artifacts(spark, d))


@query("d8_dependency_resolution", "with" + ART + " select reason, count(*) as artifacts from cs where status = 'invalid' group by 1")
def d8(spark, d):
    s = dr.catalog_status(*artifacts(spark, d))
    return s.where("status = 'invalid'").groupBy("reason").agg(F.count(F.lit(1)).alias("artifacts"))


@query("d18_latest_chain", "with" + ART + """, w as (select project, arg_max(k, (o_orderdate, name)) as k from cs where kind = 'render' and status = 'current' group by 1)
  select project, 'render-' || k as render, 'recipe-' || k as recipe, 'scan-' || k as scan from w""")
def d18(spark, d):
    a, deps = artifacts(spark, d)
    return dr.latest_chain(dr.catalog_status(a, deps), a, deps)


@query("f21_duplicate_identity", "select doc_id, sha256(text) as artifact_id, count(*) over (partition by text) as copies from documents qualify copies > 1")
def f21(spark, d):
    a = table(spark, d, "documents").select(F.lit("all").alias("project"), "doc_id", F.sha2("text", 256).alias("artifact_id"))
    return dr.duplicate_identities(a, ["project"]).select("doc_id", "artifact_id", "copies")


@query("d17_album_context", """select o_orderkey, sha256(concat_ws('|', o_custkey::varchar, o_orderkey::varchar, o_orderpriority, sha256(c_name), sha256(n_name), '48000')) as side_sha256 from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey""")
def d17(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("album"), F.col("o_orderkey").cast("string").alias("side_order"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("project_id"), "o_orderkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.sha2("c_name", 256).alias("project_sha256"), F.col("c_nationkey").alias("source_id"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"), F.sha2("n_name", 256).alias("source_sha256"), F.lit(48000).alias("sample_rate"))
    return dr.album_context(o, c, n).select("o_orderkey", "side_sha256")


@query("g2_release_search_order", """with r as (select l_suppkey as q, p_partkey as id, p_type = 'LARGE' as vinyl, p_size as score, min(l_shipdate) as dt, any_value(p_name) as title from lineitem join part on p_partkey = l_partkey group by all)
  select q, id, cast(row_number() over (partition by q order by vinyl desc, score desc, dt, lower(title), id::varchar) as integer) as rank from r""")
def g2(spark, d):
    p = table(spark, d, "part")
    j = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("q"), "p_partkey", "p_type", "p_size", "p_name").agg(F.min("l_shipdate").alias("date"))
    r = j.select("q", F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("release_id"), F.when(F.col("p_type") == "LARGE", F.array(F.lit('12" Vinyl'))).otherwise(F.array(F.lit("CD"))).alias("formats"),
                 F.col("p_size").alias("score"), "date", F.col("p_name").alias("title"))
    return ordering.rank_releases(r, ["q"]).select("q", "id", "rank")


@query("g3_track_selection_order", """with s as (select l_orderkey as release, 'k' || l_partkey || '-' || l_suppkey || '-' || l_linenumber as key, case when l_linenumber % 2 = 0 then 'side' else 'medium' end as kind, l_returnflag as side, cast(l_quantity as integer) as n, l_linenumber as pos, row_number() over (partition by l_orderkey, l_partkey, l_suppkey, l_linenumber) as dupe from lineitem)
  select release, key, cast(row_number() over (partition by release order by (n = 20 and side = 'A') desc, (n = 20) desc, (side = 'A') desc, (kind = 'side') desc, abs(n - 20), pos, key) as integer) as rank from s where dupe = 1""")
def g3(spark, d):
    key = F.concat(F.lit("k"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber"))
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("release"), key.alias("key"), F.when(F.col("l_linenumber") % 2 == 0, "side").otherwise("medium").alias("kind"),
                                           F.col("l_returnflag").alias("side"), F.col("l_quantity").cast("int").alias("track_count"), F.col("l_linenumber").alias("medium_position"))
    s = s.dropDuplicates(["release", "key"])
    return ordering.rank_selections(s, ["release"], "A", 20).select("release", "key", "rank")


NAV = TRACKS + """, nv as (select project_id as album, number, part, supplier, start_sample, end_sample, 1 + (number - 1) // 3 as side_order from tracks)"""


def places(spark, d):
    """An album's tracks with their side and file, before texts are made of them."""
    t = tracks(spark, d)
    so = F.expr("1 + (number - 1) div 3")
    path = F.concat(F.lit("s"), so.cast("string"), F.lit(".wav"))
    return t.select(F.col("project_id").alias("album"), so.alias("side_order"), F.col("number").alias("album_number"), "number", path.alias("file_path"),
                    F.col("start_sample").alias("file_start"), "start_sample", "end_sample", "part", "supplier")


def named(t):
    """Adds the texts of albums, sides and tracks."""
    s = F.concat(F.lit("Side "), F.col("side_order").cast("string"))
    return t.withColumns({
        "label": s, "label_key": F.lower(s), "title": F.concat(F.lit('Part "'), F.col("part").cast("string"), F.lit('"')),
        "artist": F.concat(F.lit("Supp "), F.col("supplier").cast("string")), "file_key": F.col("file_path"),
        "file_sha256": F.when(F.col("part") % 50 == 3, "x").otherwise("y"),
        "album_title": F.concat(F.lit("Album "), F.col("album").cast("string")), "album_artist": F.lit("Someone")}).drop("part", "supplier")


def nav(spark, d):
    return named(places(spark, d))


@query("c12_navigation_integrity", "with" + NAV + """, g as (select album, count(*) as tracks, count(distinct side_order) as sides from nv group by 1), f as (select album, bool_or(x) as clash from (select album, side_order, count(distinct part % 50 = 3) > 1 as x from nv group by 1, 2) group by 1)
  select album, tracks, sides, case when clash then 'file_names_collide' else '' end as reasons from g join f using (album)""")
def c12(spark, d):
    return va.navigation_problems(nav(spark, d)).withColumn("reasons", joined("reasons"))


@query("a14_cue_sheet", "with" + NAV + """, l as (select *, number = 1 as f, (number - 1) % 3 = 0 as n, (start_sample * 75 + 500) // 1000 as fr from nv)
  select album, side_order, number as album_number, x.line_no, x.line from (select album, side_order, number, unnest([case when f then {'line_no': 0, 'line': 'REM INDEX_PRECISION "75 fps approximate"'} end, case when f then {'line_no': 1, 'line': 'PERFORMER "Someone"'} end,
    case when f then {'line_no': 2, 'line': 'TITLE "Album ' || album || '"'} end, case when n then {'line_no': 3, 'line': 'REM SIDE "Side ' || side_order || '"'} end, case when n then {'line_no': 4, 'line': 'FILE "s' || side_order || '.wav" WAVE'} end,
    {'line_no': 5, 'line': '  TRACK ' || lpad(number::varchar, 2, '0') || ' AUDIO'}, {'line_no': 6, 'line': '    TITLE "Part ''''' || part || '''''"'}, {'line_no': 7, 'line': '    PERFORMER "Supp ' || supplier || '"'},
    {'line_no': 8, 'line': '    INDEX 01 ' || lpad((fr // 4500)::varchar, 2, '0') || ':' || lpad((fr % 4500 // 75)::varchar, 2, '0') || ':' || lpad((fr % 75)::varchar, 2, '0')}]) as x from l) where x is not null""")
def a14(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("album"))
    return sinks.started_lines(named(sinks.cue_starts(places(spark, d), lines)), 1000)


CHAP = NAV + """, s as (select album, side_order, '[' || string_agg('{"number":' || number || ',"start_sample":' || start_sample || ',"end_sample":' || end_sample || '}', ',' order by number) || ']' as t from nv group by 1, 2)"""


@query("a15_chapters", "with" + CHAP + """ select album, '[' || string_agg('{"side_order":' || side_order || ',"label":"Side ' || side_order || '","tracks":' || t || '}', ',' order by side_order) || ']' as chapters from s group by 1""")
def a15(spark, d):
    return sinks.chapters(nav(spark, d))


@query("j16_navigation", "with" + CHAP + """, c as (select album, length('[' || string_agg('{"side_order":' || side_order || ',"label":"Side ' || side_order || '","tracks":' || t || '}', ',' order by side_order) || ']') as chapter_chars from s group by 1),
   l as (select album, count(*) as tracks, 3 + count(*) * 4 + count(distinct side_order) * 2 as cue_lines from nv group by 1), f as (select album, bool_or(x) as clash from (select album, side_order, count(distinct part % 50 = 3) > 1 as x from nv group by 1, 2) group by 1)
   select album, cast(chapter_chars as integer) as chapter_chars, cue_lines from c join l using (album) join f using (album) where not clash""")
def j16(spark, d):
    from ..plans.albums import navigation

    return navigation(nav(spark, d), 1000)["summary"]


@query("a16_track_extraction", "with" + SIG + """, t as (select event_type as capture_id, unnest(range(1, 5)) as number, count(*) as n from events group by 1), b as (select capture_id, number, (number - 1) * n // 4 as s, number * n // 4 as e from t)
  select capture_id, number, count(*) as frames, round(sum(amp), 8) as total from b join sig using (capture_id) where sample_ix >= s and sample_ix < e group by 1, 2""")
def a16(spark, d):
    ev = table(spark, d, "events").groupBy(F.col("event_type").alias("capture_id")).agg(F.count(F.lit(1)).alias("n"))
    t = ev.select("capture_id", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("number"))
    t = t.select("capture_id", "number", F.expr("(number - 1) * n div 4").alias("start_sample"), F.expr("number * n div 4").alias("end_sample"))
    parts = sinks.track_blocks(to_blocks(sig(spark, d).withColumn("channel", F.lit(0)), 64), t, 64)
    x = parts.select("capture_id", "number", "n", F.aggregate("samples", F.lit(0.0), lambda a, v: a + v).alias("s"))
    return x.groupBy("capture_id", "number").agg(F.sum("n").alias("frames"), F.round(F.sum("s"), 8).alias("total"))


@query("d16_track_block_overlap", "with" + TRACKS + """, b as (select project_id, unnest(range(0, 1 + (max(end_sample) - 1) // 4096)) as blk from tracks group by 1)
  select project_id, number, blk as block_ix, least(end_sample, (blk + 1) * 4096) - greatest(start_sample, blk * 4096) as shared from tracks join b using (project_id) where start_sample < (blk + 1) * 4096 and end_sample > blk * 4096""")
def d16(spark, d):
    t = tracks(spark, d)
    b = t.groupBy("project_id").agg(F.max("end_sample").alias("e")).select("project_id", F.explode(F.expr("sequence(0l, (e - 1) div 4096)")).alias("block_ix"))
    b = b.withColumn("start_ix", F.col("block_ix") * 4096).withColumn("end_ix", (F.col("block_ix") + 1) * 4096)
    tt = t.select("project_id", "number", F.col("start_sample").alias("r_start"), F.col("end_sample").alias("r_end"))
    j = overlapping(b, tt, ["project_id"], bucket=4096)
    return j.select("project_id", "number", "block_ix", (F.least("end_ix", "r_end") - F.greatest("start_ix", "r_start")).alias("shared"))


@query("e39_range_digest", "with" + SIG + " select capture_id, " + digest_sql("sha256(sample_ix || chr(10) || cast(round_even(amp * 1000000, 0) as bigint))") + """ as digest from sig
   where sample_ix >= 200 and sample_ix < 1500 group by 1""")
def e39(spark, d):
    from ..functions.hashing import ordered_hash

    s = sig(spark, d).where("sample_ix >= 200 and sample_ix < 1500")
    return ordered_hash(s, ["capture_id"], "sample_ix", F.bround(F.col("amp") * 1000000).cast("bigint").cast("string"), "digest")


@query("a2_capture_metadata", """select page_id, length(html) as size_chars, sha256(html) as sha256, cast(round_even(page_id * 1000003::bigint * 48000 / 44100.0::double, 0) as bigint) as sample_count from pages""")
def a2(spark, d):
    from ..sources.captures import sample_count

    p = table(spark, d, "pages")
    n = sample_count(F.col("page_id") * F.lit(1000003).cast("bigint"), F.lit(1), F.lit(44100), F.lit(48000))
    return p.select("page_id", F.length("html").cast("bigint").alias("size_chars"), F.sha2("html", 256).alias("sha256"), n.alias("sample_count"))


@query("a21_review_receipts", """select o_orderkey, o_orderstatus <> 'F' as all_reviewed, o_orderpriority <> '5-LOW' as independent, case when o_orderkey % 10 = 0 then 'revision' else '' end as missing_keys from orders""")
def a21(spark, d):
    from ..sources.captures import parse_receipts

    o = table(spark, d, "orders")
    full = F.struct(F.lit("p").alias("project_sha256"), F.lit(3).alias("revision"), F.lit("s").alias("state_sha256"), F.lit("a").alias("source_sha256"), F.lit("r").alias("ranges_sha256"),
                    (F.col("o_orderstatus") != "F").alias("all_reviewed"), (F.col("o_orderpriority") != "5-LOW").alias("independent"))
    body = F.when(F.col("o_orderkey") % 10 == 0, F.to_json(full.dropFields("revision"))).otherwise(F.to_json(full))
    r = parse_receipts(o.select("o_orderkey", body.alias("body")))
    return r.select("o_orderkey", "all_reviewed", "independent", F.array_join("missing_keys", ",").alias("missing_keys"))
