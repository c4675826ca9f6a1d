"""Choice of boundaries and the shape of tracks, over events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import SIG, TRACKS, sig, table, tracks
from ..functions import levels as lv
from ..operators import choice
from ..operators import tracks as tr
from ..session import stage
from ..plans.segment import refit_topology, segment_admitted, segment_captures
from .common import query
from .signal import CAND, CFG, candidates_of, durations, rounded

AUTO = CAND.replace("with" + SIG, "with") + """,
el as (select c.capture_id, cut_ix, cut_sample, cut_seconds, start_seconds, end_seconds, score, row_number() over (partition by c.capture_id order by cut_seconds, score desc) as rn
   from cand c join bnd b using (capture_id) where score >= 0.3 and cut_seconds - core_start >= 2.0 and core_end - cut_seconds >= 2.0),
pv as (select e.*, (select count(*) from el p where p.capture_id = e.capture_id and p.rn < e.rn and e.cut_seconds - p.cut_seconds >= 2.0) as j from el e),
dp as (select distinct capture_id, 0::bigint as i, [{'c': 0::bigint, 's': 0.0::double, 'q': []::bigint[]}] as best from pv
  union all select d.capture_id, d.i + 1, list_append(d.best, case when d.best[p.j + 1].c + 1 > d.best[d.i + 1].c or (d.best[p.j + 1].c + 1 = d.best[d.i + 1].c
     and d.best[p.j + 1].s + p.score > d.best[d.i + 1].s) then {'c': d.best[p.j + 1].c + 1, 's': d.best[p.j + 1].s + p.score, 'q': list_append(d.best[p.j + 1].q, p.cut_ix)}
     else d.best[d.i + 1] end) from dp d join pv p on p.capture_id = d.capture_id and p.rn = d.i + 1),
au as (select capture_id, unnest(best[len(best)].q) as cut_ix from dp d where i = (select max(i) from dp x where x.capture_id = d.capture_id))"""
from dataclasses import replace  # noqa: E402

AUTO_CFG = replace(CFG, auto_score=0.3)


@query("g8_automatic_selection", "with recursive" + AUTO + " select capture_id, cut_ix from au")
def g8(spark, d):
    _, _, b, c = candidates_of(spark, d)
    return choice.choose_automatic(c, b, AUTO_CFG)


JOINED = AUTO + """,
sl as (select a.capture_id, e.cut_sample, e.score from au a join el e using (capture_id, cut_ix)),
bs as (select d.capture_id, cast(round_even(coalesce(b.music_start, 0) * 100, 0) as bigint) as s, cast(round_even(coalesce(b.music_end, d.duration_seconds) * 100, 0) as bigint) as e
   from dur d left join bnd b using (capture_id)),
mk as (select l.capture_id, greatest(s + 1, least(e - 1, cut_sample)) as pos, max(score) as sc from sl l join bs using (capture_id) group by 1, 2
   union all select capture_id, s, 1.0 from bs union all select capture_id, e, 1.0 from bs),
tk as (select capture_id, row_number() over w as number, pos as start_sample, lead(pos) over w as end_sample, round(least(sc, lead(sc) over w), 8) as confidence from mk window w as (partition by capture_id order by pos))"""


@query("j1_segment_captures", "with recursive" + JOINED + " select * from tk where end_sample is not null")
def j1(spark, d):
    out = segment_captures(sig(spark, d), durations(spark, d), AUTO_CFG)["tracks"]
    return rounded(out, "confidence", places=8)


@query("j1_admitted_segments", "with recursive" + JOINED + """ select capture_id, number, start_sample, end_sample, confidence, null::varchar as refused from tk where end_sample is not null and capture_id[1] <> 'c'
  union all select capture_id, null, null, null, null, 'container_not_supported,codec_container_not_supported' from dur where capture_id[1] = 'c'""")
def j1_admitted(spark, d):
    n = durations(spark, d)
    mp3 = F.substring("capture_id", 1, 1) == "c"
    meta = n.select(
        "capture_id", F.when(mp3, "a.mp3").otherwise("a.wav").alias("filename"), F.when(mp3, "mp3").otherwise("pcm_s16le").alias("codec_name"),
        F.lit(44100).alias("sample_rate"), F.lit(2).alias("channels"), F.lit(16).alias("bits_per_raw_sample"), "duration_seconds",
        F.lit(1000).cast("bigint").alias("size_bytes"), F.bround(F.col("duration_seconds") * 44100).cast("bigint").alias("sample_count"))
    out = segment_admitted(sig(spark, d), n, meta, AUTO_CFG)
    tracks = rounded(out["tracks"], "confidence", places=8).withColumn("refused", F.lit(None).cast("string"))
    refused = out["rejected"].select("capture_id", F.array_join("reasons", ",").alias("refused"))
    return tracks.unionByName(refused, allowMissingColumns=True).select("capture_id", "number", "start_sample", "end_sample", "confidence", "refused")


@query("f15_build_tracks", """with s as (select l_orderkey, max(l_partkey) + 100 as hi, min(l_partkey) as lo from lineitem group by 1),
  m as (select l.l_orderkey, greatest(lo + 1, least(hi - 1, l_partkey)) as pos, max(l_discount) as sc from lineitem l join s using (l_orderkey) group by 1, 2
   union all select l_orderkey, lo, 1.0 from s union all select l_orderkey, hi, 1.0 from s),
  t as (select cast(l_orderkey as varchar) as capture_id, row_number() over w as number, pos as start_sample, lead(pos) over w as end_sample, least(sc, lead(sc) over w) as confidence from m window w as (partition by l_orderkey order by pos))
  select * from t where end_sample is not null""")
def f15(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("capture_id"), F.col("l_partkey").alias("cut_sample"), F.col("l_discount").alias("score"))
    b = li.groupBy("capture_id").agg(F.min("cut_sample").alias("start_sample"), (F.max("cut_sample") + 100).alias("end_sample"))
    return tr.build_tracks(li, b, 1000)


@query("d6_replace_or_append", "with recursive" + AUTO + """, sel as (select e.* from au a join el e using (capture_id, cut_ix) union all
   select capture_id, null, cast(4321 as bigint), 43.21, 43.21, 43.21, 0.08, null from dur)
  select capture_id, round(cut_seconds, 6) as cut_seconds, score > 0.1 as measured, true as selected from sel union all
  select c.capture_id, round(c.cut_seconds, 6), true, false from cand c where not exists (select 1 from sel s where s.capture_id = c.capture_id and s.end_seconds > s.start_seconds
    and abs(s.start_seconds - c.start_seconds) < 0.025 and abs(s.end_seconds - c.end_seconds) < 0.025)""")
def d6(spark, d):
    _, _, b, c = candidates_of(spark, d)
    sel = c.join(choice.choose_automatic(c, b, AUTO_CFG), ["capture_id", "cut_ix"])
    cols = ["capture_id", "start_seconds", "end_seconds", "cut_seconds", "cut_sample", "score"]
    made = durations(spark, d).select("capture_id", *[F.lit(43.21).alias(x) for x in cols[1:4]], F.lit(4321).cast("bigint").alias("cut_sample"), F.lit(0.08).alias("score"))
    out = choice.merge_selected(c, sel.select(*cols).unionByName(made))
    return out.select("capture_id", F.round("cut_seconds", 6).alias("cut_seconds"), (F.col("score") > 0.1).alias("measured"), "selected")


@query("d7_target_distance", "with" + CAND + """, t as (select capture_id, unnest([0.25, 0.5, 0.75]) * duration_seconds as t from dur)
  select c.capture_id, c.start_ix, round(min(greatest(0, start_seconds - t, t - end_seconds)), 6) as distance from cand c join t using (capture_id) group by 1, 2""")
def d7(spark, d):
    c = candidates_of(spark, d)[3]
    t = durations(spark, d).select("capture_id", F.array(*[F.col("duration_seconds") * q for q in (0.25, 0.5, 0.75)]).alias("targets"))
    return choice.nearest_target_distance(c, t).select("capture_id", "start_ix", F.round("distance", 6).alias("distance"))


@query("d5_tolerance_match", """with c as (select l_orderkey as k, l_partkey * 0.003::double as s, l_partkey * 0.003::double + l_quantity * 0.01::double as e, l_partkey * 3 as cut,
    l_suppkey as ix, l_discount as score, l_quantity * 0.01::double as dur from lineitem),
  b as (select k, min(s) as s, arg_min(e, s * 1000 - e) as e from c group by 1), x as (select b.k, b.s as s0, b.e as e0, c.*, abs(c.s - b.s) <= 0.002 and abs(c.e - b.e) <= 0.002 as ex from b join c using (k)
    where (abs(c.s - b.s) <= 0.002 and abs(c.e - b.e) <= 0.002) or (c.dur > 0 and c.s >= b.s - 0.002 and c.e <= b.e + 0.002)),
  y as (select *, bool_or(ex) over (partition by k) as anyex from x)
  select cast(k as varchar) as capture_id, count(*) as matches, round(max(score), 6) as score from y where ex or not anyex group by 1""")
def d5(spark, d):
    c = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("capture_id"), (F.col("l_partkey") * 0.003).alias("start_seconds"),
        (F.col("l_partkey") * 0.003 + F.col("l_quantity") * 0.01).alias("end_seconds"), (F.col("l_partkey") * 3).alias("cut_sample"),
        F.col("l_suppkey").alias("candidate_index"), F.col("l_discount").alias("score"), (F.col("l_quantity") * 0.01).alias("duration_seconds"))
    first = F.min(F.struct(F.col("start_seconds"), (-F.col("end_seconds")).alias("n")))
    sel = c.groupBy("capture_id").agg(first.alias("f")).select(
        "capture_id", F.lit(1).cast("bigint").alias("boundary"), F.col("f.start_seconds").alias("start_seconds"), (-F.col("f.n")).alias("end_seconds"),
        F.lit(0).cast("bigint").alias("cut_sample"))
    return choice.match_candidates(sel, c, 1000).select("capture_id", "matches", "score")


@query("c2_candidate_eligibility", "with" + CAND + """ select c.capture_id, start_ix from cand c join bnd b using (capture_id)
   where score >= 0.4 and cut_seconds - core_start >= 2.0 and core_end - cut_seconds >= 2.0""")
def c2(spark, d):
    _, _, b, c = candidates_of(spark, d)
    j = c.join(b, "capture_id")
    return j.where("score >= 0.4 and cut_seconds - core_start >= 2.0 and core_end - cut_seconds >= 2.0").select("capture_id", "start_ix")


@query("c4_analysis_coordinates", "with" + CAND + """ select cand.capture_id, start_ix from cand join dur on dur.capture_id = cand.capture_id
   where start_seconds < 0 or end_seconds > dur.duration_seconds or cut_seconds < start_seconds or cut_seconds + 0.4 > end_seconds""")
def c4(spark, d):
    c = candidates_of(spark, d)[3].withColumn("cut_seconds", F.col("cut_seconds"))
    bad = (F.col("start_seconds") < 0) | (F.col("end_seconds") > F.col("duration_seconds_src")) | (F.col("cut_seconds") < F.col("start_seconds")) | (
        F.col("cut_seconds") + 0.4 > F.col("end_seconds"))
    src = durations(spark, d).withColumnRenamed("duration_seconds", "duration_seconds_src")
    return c.join(src, "capture_id").where(bad).select("capture_id", "start_ix")


@query("c3_track_contiguity", "with" + TRACKS + """,
  tt as (select *, case when part % 23 = 0 then start_sample + 1 else start_sample end as s, lag(end_sample) over (partition by project_id order by number) as pe from tracks)
  select project_id, number, concat_ws(',', case when end_sample <= s then 'invalid_bounds' end, case when end_sample > 200000 then 'past_source_end' end, case when supplier % 50 = 3 then 'confidence_out_of_range' end,
    case when pe is not null and s <> pe then 'not_contiguous' end, case when part % 31 = 0 then 'start_time_disagrees' end) as reasons from tt""")
def c3(spark, d):
    t = tracks(spark, d)
    t = t.withColumn("start_sample", F.when(F.col("part") % 23 == 0, F.col("start_sample") + 1).otherwise(F.col("start_sample")))
    t = t.withColumn("start_seconds", F.col("start_sample") / 1000 + F.when(F.col("part") % 31 == 0, 0.02).otherwise(0.0))
    t = t.withColumn("end_seconds", F.col("end_sample") / 1000).withColumn("confidence", F.when(F.col("supplier") % 50 == 3, 1.5).otherwise(0.5))
    src = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id")).distinct().select(
        "project_id", F.lit(1000).alias("sample_rate"), F.lit(200000).alias("sample_count"))
    return tr.track_violations(t, src).select("project_id", "number", F.array_join("reasons", ",").alias("reasons"))


ISL = TRACKS + """,
sd as (select project_id, number, case when supplier % 40 = 1 then '' else upper(side) end as side from tracks),
il as (select project_id, side, min(number) as start_ix, max(number) + 1 as end_ix, count(*) as tracks from
  (select *, number - row_number() over (partition by project_id, side order by number) as g from sd) group by project_id, side, g),
st as (select project_id, count(*) as groups, sum(tracks)::bigint as tracks, sum(tracks) filter (side = '') as blank, bool_or(rep) as rep from
  (select *, side <> '' and count(*) over (partition by project_id, side) > 1 as rep from il) group by 1),
ss as (select project_id, groups, tracks, concat_ws(',', case when blank > 0 and blank < tracks then 'labels_incomplete' end, case when rep then 'label_repeats' end) as reasons from st)"""


def sided(spark, d):
    return tracks(spark, d).withColumn("side", F.when(F.col("supplier") % 40 == 1, F.lit("")).otherwise(F.col("side")))


@query("c5_side_contiguity", "with" + ISL + " select * from ss")
def c5(spark, d):
    return tr.side_group_status(sided(spark, d)).withColumn("reasons", F.array_join("reasons", ","))


@query("f19_ordered_side_groups", "with" + ISL + """ select i.project_id, row_number() over (partition by i.project_id order by start_ix) - 1 as group_ix, side, start_ix, end_ix
   from il i join ss using (project_id) where reasons = '' and groups >= 2 and side <> ''""")
def f19(spark, d):
    return tr.ordered_side_groups(sided(spark, d))


DUR = TRACKS + """, dd as (select project_id, number, side, case when part % 6 = 0 then null else duration end as duration from tracks)"""


def gappy(spark, d):
    return tracks(spark, d).withColumn("duration", F.when(F.col("part") % 6 != 0, F.col("duration")))


@query("e36_side_durations", "with" + DUR + """ select project_id, side, count(*) as tracks, case when count(duration) = count(*) then sum(duration) end as duration from dd group by 1, 2""")
def e36(spark, d):
    return tr.side_durations(gappy(spark, d))


EFF = DUR + """,
ag as (select project_id, count(*) as n, count(duration) as k, sum(duration) as s, median(duration) as mid, count(*) * 22.0::double as span from dd group by 1),
ef as (select d.project_id, number, case when k = 0 then 'none' when k = n then 'complete' else 'partial-imputed' end as mode,
   coalesce(duration, case when k > 0 and k < n then case when span - s >= (n - k) * 5.0 then (span - s) / (n - k) else mid end end) as effective from dd d join ag using (project_id))"""


def effective(spark, d):
    t = gappy(spark, d)
    spans = t.groupBy("project_id").agg((F.count(F.lit(1)) * 22.0).alias("span_seconds"))
    return tr.effective_durations(t, spans, 5.0)


@query("e37_duration_imputation", "with" + EFF + " select project_id, number, mode, round(effective, 6) as effective from ef")
def e37(spark, d):
    return rounded(effective(spark, d).select("project_id", "number", "mode", "effective"), "effective")


TARG = EFF + """,
tg as (select project_id, number, n, cast(100 + round_even(20000.0::double * c / t, 0) as bigint) as target from (select e.project_id, number, sum(effective) over (partition by e.project_id order by number) as c,
   sum(effective) over (partition by e.project_id) as t, count(*) over (partition by e.project_id) as n from ef e where effective is not null) where number < n)"""


def targets(spark, d):
    e = stage(effective(spark, d).where("effective is not null"))
    music = e.select("project_id").distinct().select(
        "project_id", F.lit(100).cast("bigint").alias("music_start"), F.lit(20100).cast("bigint").alias("music_end"))
    return tr.duration_targets(e, music)


@query("f14_duration_targets", "with" + TARG + " select project_id, number, target from tg")
def f14(spark, d):
    return targets(spark, d).select("project_id", "number", "target")


@query("f16_feasible_targets", "with recursive" + TARG + """,
  fz as (select project_id, 0::bigint as number, 100::bigint as chosen from (select distinct project_id from tg)
    union all select t.project_id, t.number, least(20100 - (t.n - t.number) * 1500, greatest(f.chosen + 1500, t.target)) from fz f join tg t on t.project_id = f.project_id and t.number = f.number + 1)
  select project_id, number, chosen as feasible from fz where number > 0""")
def f16(spark, d):
    return tr.feasible_targets(targets(spark, d), 1500).select("project_id", "number", "feasible")


@query("f17_output_offsets", "with" + TRACKS + """ select project_id, number, side, cast(sum(end_sample - start_sample) over w - (end_sample - start_sample) as bigint) as output_start,
   cast(sum(end_sample - start_sample) over w as bigint) as output_end from tracks window w as (partition by project_id, side order by number)""")
def f17(spark, d):
    return tr.output_offsets(tracks(spark, d), ["project_id", "side"]).select("project_id", "number", "side", "output_start", "output_end")


@query("b23_album_numbering", """select l_orderkey, l_linenumber as number, l_linenumber + coalesce(try_cast(case when l_partkey % 9 = 0 then 'x' when l_partkey % 9 = 1 then null else cast(l_partkey % 9 as varchar) end as integer), 0) as album_number,
   concat_ws(',', case when l_partkey % 9 = 0 then 'offset_invalid' end, case when l_linenumber + coalesce(try_cast(case when l_partkey % 9 = 0 then 'x' when l_partkey % 9 = 1 then null else cast(l_partkey % 9 as varchar) end as integer), 0) > 8 then 'number_exceeds_total' end) as reasons
   from lineitem""")
def b23(spark, d):
    t = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("number"), F.lit("8").alias("track_total"),
        F.when(F.col("l_partkey") % 9 == 0, "x").when(F.col("l_partkey") % 9 != 1, (F.col("l_partkey") % 9).cast("string")).alias("track_offset"))
    return tr.album_numbering(t).select("l_orderkey", "number", "album_number", F.array_join("reasons", ",").alias("reasons"))


@query("b2_seconds_to_sample", "select l_orderkey, l_linenumber, cast(round_even(l_quantity * 0.125::double * 100, 0) as bigint) as sample from lineitem")
def b2(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", lv.seconds_to_sample(F.col("l_quantity") * 0.125, F.lit(100)).alias("sample"))


@query("b11_cue_time", "with" + TRACKS + """ select project_id, number, case when m < 100 then lpad(cast(m as varchar), 2, '0') else cast(m as varchar) end || ':' || lpad(cast(f % 4500 // 75 as varchar), 2, '0')
    || ':' || lpad(cast(f % 75 as varchar), 2, '0') as cue from (select project_id, number, (start_sample * 75 + 500) // 1000 as f, (start_sample * 75 + 500) // 1000 // 4500 as m from tracks)""")
def b11(spark, d):
    return tracks(spark, d).select("project_id", "number", lv.cue_time(F.col("start_sample"), F.lit(1000)).alias("cue"))


@query("b17_speed_factor", """select p_partkey, case when p_size % 7 <> 0 and p_size % 11 <> 0 then 45.0::double / (30 + p_size) * 1.01 end as factor from part""")
def b17(spark, d):
    p = table(spark, d, "part")
    fine = F.when(F.col("p_size") % 11 != 0, F.lit("1.01")).otherwise("oops")
    cap = F.when(F.col("p_size") % 7 != 0, F.lit("45"))
    f = lv.speed_factor(cap.try_cast("double"), (30 + F.col("p_size")).cast("double"), fine.try_cast("double"))
    return p.select("p_partkey", f.alias("factor"))


@query("b18_integer_rate_correction", """select p_partkey, cast(floor(44100 / (0.5::double + p_size * 0.02::double) + 0.5) as bigint) as new_rate,
   round(44100.0::double / floor(44100 / (0.5::double + p_size * 0.02::double) + 0.5), 9) as effective from part""")
def b18(spark, d):
    r = lv.corrected_rate(F.lit(44100.0), 0.5 + F.col("p_size") * 0.02)
    return table(spark, d, "part").select("p_partkey", r.alias("new_rate"), F.round(F.lit(44100.0) / r, 9).alias("effective"))


@query("b19_corrected_sample_map", """select l_orderkey, l_partkey, cast((2::hugeint * (l_partkey * 1000003::bigint) * 48000 + (40000 + l_suppkey)) // (2 * (40000 + l_suppkey)) as bigint) as mapped from lineitem""")
def b19(spark, d):
    li = table(spark, d, "lineitem")
    s = F.col("l_partkey") * F.lit(1000003).cast("bigint")
    return li.select("l_orderkey", "l_partkey", lv.corrected_sample(s, F.lit(48000), F.lit(40000) + F.col("l_suppkey")).alias("mapped"))


@query("b20_excerpt_bounds", "with" + TRACKS + """, x as (select *, (end_sample - start_sample) / 1000.0::double as tot from tracks), y as (select *, start_sample + cast(floor(least(8.0, greatest(0.0, tot - 15)) * 1000) as bigint) as a from x)
  select project_id, number, a as excerpt_start, least(end_sample, a + 120000) as excerpt_end from y""")
def b20(spark, d):
    a, b = lv.excerpt_bounds(F.col("start_sample"), F.col("end_sample"), F.lit(1000))
    return tracks(spark, d).select("project_id", "number", a.alias("excerpt_start"), b.alias("excerpt_end"))


@query("b21_highpass_response", """select p_partkey, round(g, 9) as gain, round(case when g > 0 then greatest(-400, 20 * log10(g)) else -400 end, 6) as gain_db from
   (select p_partkey, pow(p_size / 12.0::double, 4) / (1 + pow(p_size / 12.0::double, 4)) as g from part)""")
def b21(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(lv.highpass_gain(F.col("p_size"), 12.0, 2), 9).alias("gain"),
                                          F.round(lv.highpass_db(F.col("p_size"), 12.0, 2), 6).alias("gain_db"))


@query("b22_quantize_24", """select l_orderkey, l_partkey, cast(least(2147483392, greatest(-2147483648, sign(x) * ((abs(x) + 128) // 256) * 256)) as bigint) as q from
   (select l_orderkey, l_partkey, (l_partkey - 1000) * 4000037::bigint as x from lineitem)""")
def b22(spark, d):
    x = (F.col("l_partkey") - 1000) * F.lit(4000037).cast("bigint")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", lv.quantize_24(x).alias("q"))


@query("b27_edge_fade", """select vec_id, i as position, round(case when least(i, 63 - i) < 10 then 0.5 - 0.5 * cos(pi() * least(i, 63 - i) / 9.0::double) else 1 end * embedding[i + 1]::double, 8) as faded
   from (select vec_id, embedding, cast(unnest(range(64)) as integer) as i from embeddings)""")
def b27(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("position", "v"))
    w = lv.edge_fade(F.col("position"), F.lit(64), F.lit(10))
    return e.select("vec_id", "position", F.round(w * F.col("v").cast("double"), 8).alias("faded"))


def topology_inputs(spark, d):
    t = stage(tracks(spark, d))
    rel = t.select(F.col("project_id"), "number", "side", F.when(F.col("part") % 6 != 0, F.col("duration")).alias("duration"))
    n = t.groupBy("project_id").agg(F.max("end_sample").alias("music_end"), F.count(F.lit(1)).alias("previous_tracks"))
    music = n.select("project_id", F.lit(0).cast("bigint").alias("music_start"), "music_end")
    cut = F.col("end_sample") / 1000.0
    c = t.select("project_id", F.col("number").alias("candidate_index"), (cut - 0.6).alias("start_seconds"), (cut + 0.6).alias("end_seconds"),
                 cut.alias("cut_seconds"), F.col("end_sample").alias("cut_sample"), F.lit(1.2).alias("duration_seconds"),
                 (0.4 + F.col("part") % 50 / 100.0).alias("score"))
    return rel, music, c, n.select("project_id", "previous_tracks")


@query("j8_refit_topology")
def j8(spark, d):
    rel, music, c, prev = topology_inputs(spark, d)
    return refit_topology(rel, music, c, 1000, 1.0, prev)["boundaries"]


def choice_sql(count: str, spacing: float) -> str:
    """Points of a capture as a list, layers of one more point each as lists over it: exact count first, else the most
    points that fit, then the measured ones, then the value."""
    far = "case when x.b <= x.a then abs(x.c - t[{k}]) else greatest(0.0, x.a - t[{k}], t[{k}] - x.b) end"
    gain = f"(x.s - 0.75 * ({far}) / tol)"
    near = "(x.s - 0.75 * list_min(list_transform(t, lambda w: abs(x.c - w))) / tol)"
    prev = f"""list_max(list_transform(list_filter(list_transform(st, lambda q, j: {{'r': q.r, 'v': q.v, 'n': -j, 'q': q.q}}),
      lambda z: z.r >= 0 and x.c - p[-z.n].c >= {spacing}), lambda z: z))"""
    unit = "case when x.b > x.a then 1 else 0 end"

    def layers(name, of, first, rest):
        return f"""{name} as (
  select {of}.*, 1 as k, list_transform(p, lambda x, i: {{'r': case when x.c - lo >= {spacing} then {first[0]} else -1 end, 'v': {first[1]}, 'q': [i]}}) as st from {of} where n > 1
  union all select capture_id, lo, hi, n, t, tol, p, k + 1, list_transform(list_transform(p, lambda x, i: {{'x': x, 'i': i, 'm': {prev}}}),
    lambda y: {{'r': coalesce(y.m.r + {rest[0]}, -1), 'v': coalesce(y.m.v + {rest[1]}, 0.0), 'q': list_append(y.m.q, y.i)}}) from {name} where k < n - 1)"""

    best = f"list_max(list_filter(list_transform(st, lambda q, j: {{'r': case when hi - p[j].c >= {spacing} then q.r else -1 end, 'v': q.v, 'n': -j, 'q': q.q}}), lambda z: z.r >= 0))"
    of_y = lambda e: e.replace("x.", "y.x.")
    return "with recursive" + CAND.replace("with", "") + f""",
  tg as (select capture_id, core_start as lo, core_end as hi, ({count})::integer as n from bnd where core_end is not null),
  tt as (select *, list_transform(range(1, n), lambda i: lo + (hi - lo) * i / n) as t, least(45.0, greatest(8.0, 0.15 * greatest(1.0, (hi - lo) / n))) as tol from tg),
  al as (select c.capture_id, cut_seconds as c, start_seconds as a, end_seconds as b, score as s, cut_ix::double as ix from cand c join tt using (capture_id)
      where cut_seconds >= lo + {spacing} and cut_seconds <= hi - {spacing}
    union all select capture_id, y, y, y, 0.08, -1.0 from (select capture_id, unnest(t) as y from tt)),
  od as (select *, row_number() over (partition by capture_id order by c, s desc, a, b, ix) as rn from al),
  fo as (select capture_id, rn, [{{'c': c, 'a': a, 'b': b, 's': s, 'ix': ix}}] as kept from od where rn = 1
    union all select f.capture_id, o.rn, case when o.c - f.kept[-1].c < 0.05 then case when o.s > f.kept[-1].s then list_append(f.kept[1:len(f.kept) - 1], {{'c': o.c, 'a': o.a, 'b': o.b, 's': o.s, 'ix': o.ix}}) else f.kept end
      else list_append(f.kept, {{'c': o.c, 'a': o.a, 'b': o.b, 's': o.s, 'ix': o.ix}}) end from fo f join od o on o.capture_id = f.capture_id and o.rn = f.rn + 1),
  pt as (select tt.*, p from tt join (select capture_id, arg_max(kept, rn) as p from fo group by 1) using (capture_id)),
  {layers("ex", "pt", ("0", gain.format(k=1)), ("0", of_y(gain.format(k="k + 1"))))},
  eg as (select capture_id, p, t, {best} as g from ex where k = n - 1),
  rs as (select pt.* from pt anti join (select capture_id from eg where g is not null) using (capture_id)),
  {layers("fb", "rs", (unit, near), (of_y(unit), of_y(near)))},
  fg as (select capture_id, p, arg_max(g, k) as g from (select capture_id, p, k, {best} as g from fb) where g is not null group by 1, 2),
  ch as (select capture_id, u as boundary, p[g.q[u]] as x, t[u] as goal from (select *, unnest(range(1, len(g.q) + 1)) as u from eg where g is not null)
    union all select capture_id, u, p[g.q[u]], null from (select *, unnest(range(1, len(g.q) + 1)) as u from fg)),
  cu as (select capture_id, boundary, x, case when goal is not null and x.b > x.a and goal >= x.a + least(0.5, (x.b - x.a) / 4.0) and goal <= x.b - least(0.5, (x.b - x.a) / 4.0) then goal else x.c end as cut from ch)
  select capture_id, boundary, round(x.a, 6) as start_seconds, round(x.b, 6) as end_seconds, round(cut, 6) as cut_seconds,
    cast(round_even(cut * {CFG.rate}, 0) as bigint) as cut_sample, round(x.s, 6) as score, x.ix >= 0 as measured from cu"""


def exact_choice(spark, d, count, spacing):
    _, _, b, c = candidates_of(spark, d)
    p = stage(b.select("capture_id", "core_start", "core_end", count.alias("track_count"),
                       F.lit(None).cast("array<double>").alias("durations"), F.lit(None).cast("array<string>").alias("sides")))
    out = choice.choose_exact_count(stage(c), p, CFG.rate, spacing)
    return rounded(out, "start_seconds", "end_seconds", "cut_seconds", "score")


@query("g6_exact_count_choice", choice_sql("6", CFG.min_track_seconds))
def g6(spark, d):
    return exact_choice(spark, d, F.lit(6), CFG.min_track_seconds)


@query("g7_infeasible_count_choice", choice_sql("ceil(core_end / 2)", 2.6))
def g7(spark, d):
    return exact_choice(spark, d, F.ceil(F.col("core_end") / 2).cast("int"), 2.6)


@query("h1_measured_and_virtual_points", "with recursive" + CAND.replace("with", "") + """,
  al as (select capture_id, cut_seconds as c, score as s from cand union all select capture_id, unnest([0.2, 0.5, 0.8]) * duration_seconds, 0.08 from dur),
  od as (select *, row_number() over (partition by capture_id order by c, -s) as rn from al),
  fo as (select capture_id, rn, [{'c': c, 's': s}] as kept from od where rn = 1
    union all select f.capture_id, o.rn, case when o.c - f.kept[len(f.kept)].c < 0.05 then case when o.s > f.kept[len(f.kept)].s then list_append(f.kept[1:len(f.kept) - 1], {'c': o.c, 's': o.s}) else f.kept end
      else list_append(f.kept, {'c': o.c, 's': o.s}) end from fo f join od o on o.capture_id = f.capture_id and o.rn = f.rn + 1),
  ls as (select capture_id, arg_max(kept, rn) as kept from fo group by 1)
  select capture_id, round(k.c, 6) as cut_seconds, round(k.s, 6) as score from (select capture_id, unnest(kept) as k from ls)""")
def h1(spark, d):
    c = candidates_of(spark, d)[3].select("capture_id", "cut_seconds", "score")
    v = durations(spark, d).select("capture_id", F.explode(F.array(*[F.col("duration_seconds") * q for q in (0.2, 0.5, 0.8)])).alias("cut_seconds"),
                                   F.lit(0.08).alias("score"))
    from ..operators.points import collapse_points

    return rounded(collapse_points(c.unionByName(v), 0.05), "cut_seconds", "score")
