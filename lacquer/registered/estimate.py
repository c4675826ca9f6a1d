"""Speed estimation and release consensus over lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import TRACKS, table, tracks
from ..functions.hashing import ordered_hash
from ..operators import consensus as con
from ..operators import speed as sp
from ..operators.quantiles import exact_quantiles, median_mad
from ..plans import identify
from .common import digest_sql, query

CFG = sp.SpeedConfig()

RATIO = """
rt as (select l_suppkey as project_id, l_returnflag as side,
   ln(1.02::double * (1 + ((l_partkey % 7) - 3) / 1000.0::double) * case when l_partkey % 29 = 0 then 1.2::double else 1 end) as log_factor from lineitem)"""
LIVE = RATIO + """,
c0 as (select project_id, median(log_factor) as c, count(*) as n from rt group by 1),
m0 as (select project_id, any_value(c) as c, median(abs(log_factor - c)) as mad, any_value(n) as n from rt join c0 using (project_id) group by 1),
mk as (select r.*, n >= 3 and abs(log_factor - c) > greatest(0.025, 3.5 * 1.4826 * mad) as outlier from rt r join m0 using (project_id)),
live as (select * from mk where not outlier)"""
SUMMARY = LIVE + """,
c1 as (select project_id, median(log_factor) as c, count(*) as n from live group by 1),
m1 as (select project_id, any_value(c) as center, 1.4826 * median(abs(log_factor - c)) as disp, any_value(n) as tracks from live join c1 using (project_id) group by 1),
s1 as (select project_id, side, median(log_factor) as c, count(*) as n from live group by 1, 2),
s2 as (select project_id, count(*) as sides, min(n) as few, max(c) - min(c) as delta from s1 group by 1),
e0 as (select *, 1.96 * 1.2533 * greatest(disp, 0.0005) / sqrt(tracks) as half from m1 join s2 using (project_id)),
e1 as (select *, tracks >= 6 and sides >= 2 and disp <= 0.003 and half <= 0.004 as high, tracks >= 4 and disp <= 0.01 and half <= 0.015 as medium from e0),
e2 as (select *, concat_ws(',', case when tracks < 4 then 'insufficient_usable_tracks' end,
   case when exp(center) not between 0.25 and 2.0 then 'factor_outside_supported_range' end, case when disp > 0.012 then 'track_ratios_inconsistent' end,
   case when half > 0.015 then 'confidence_interval_too_wide' end, case when sides >= 2 and few < 2 then 'insufficient_independent_tracks_per_side' end,
   case when sides >= 2 and delta > 0.015 then 'side_estimates_disagree' end,
   case when not high and not medium then 'confidence_below_proposal_threshold' end) as reasons from e1)"""


def ratios(spark, d):
    li = table(spark, d, "lineitem")
    ref = 60.0 + 2.0 * F.col("l_quantity")
    factor = F.lit(1.02) * (1.0 + (F.col("l_partkey") % 7 - 3) / 1000.0) * F.when(F.col("l_partkey") % 29 == 0, 1.2).otherwise(1.0)
    rows = li.select(F.col("l_suppkey").alias("project_id"), F.col("l_returnflag").alias("side"), ref.alias("reference"),
                     (ref / factor).alias("observed"))
    return rows.select("project_id", "side", F.lit(None).cast("string").alias("exclusion"),
                       F.log(F.col("reference") / F.col("observed")).alias("log_factor"))


def r6(df, *names, places=8):
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


@query("e8_lower_order_percentile", """with p as (select l_suppkey, l_extendedprice as x, row_number() over (partition by l_suppkey order by l_extendedprice) - 1 as i,
   count(*) over (partition by l_suppkey) as n from lineitem) select l_suppkey,
   max(x) filter (i = cast(floor((n - 1) * 0.2::double) as bigint)) as p20, max(x) filter (i = cast(floor((n - 1) * 0.9::double) as bigint)) as p90 from p group by 1""")
def e8(spark, d):
    return exact_quantiles(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", {"p20": 0.2, "p90": 0.9}, method="lower")


@query("e9_median_mad_spread", """with m as (select l_returnflag, median(l_extendedprice) as mid, count(*) as n, max(l_extendedprice) - min(l_extendedprice) as spread from lineitem group by 1)
  select l_returnflag, round(any_value(mid), 6) as mid, round(median(abs(l_extendedprice - mid)), 6) as mad, any_value(n) as n, round(any_value(spread), 6) as spread
  from lineitem join m using (l_returnflag) group by 1""")
def e9(spark, d):
    li = table(spark, d, "lineitem")
    m = median_mad(li, ["l_returnflag"], "l_extendedprice", "mid", "mad", "n")
    s = li.groupBy("l_returnflag").agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("spread"))
    return r6(m.join(s, "l_returnflag"), "mid", "mad", "spread", places=6)


@query("e16_outlier_exclusion", "with" + LIVE + " select project_id, side, count(*) as tracks, count(*) filter (outlier) as excluded from mk group by 1, 2")
def e16(spark, d):
    out = sp.exclude_outliers(ratios(spark, d), CFG)
    return out.groupBy("project_id", "side").agg(
        F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("exclusion") == "robust_log_outlier").alias("excluded"))


@query("e15_side_summaries", "with" + LIVE + """, s1 as (select project_id, side, median(log_factor) as c, count(*) as n from live group by 1, 2)
  select l.project_id, lower(l.side) as side, any_value(n) as tracks, round(exp(any_value(c)), 8) as center_factor,
   round(1.4826 * median(abs(log_factor - c)), 8) as dispersion from live l join s1 using (project_id, side) group by 1, 2""")
def e15(spark, d):
    return r6(sp.side_summaries(sp.exclude_outliers(ratios(spark, d), CFG)).drop("center_log"), "center_factor", "dispersion")


@query("e14_robust_ratio", "with" + SUMMARY + """ select project_id, tracks, sides, case when reasons = '' then 'proposed' else 'abstained' end as status,
   case when reasons <> '' then 'none' when high then 'high' else 'medium' end as confidence, case when reasons = '' then round(exp(center), 8) end as proposed_factor,
   round(exp(center), 8) as center_factor, round(exp(center - half), 8) as lower, round(exp(center + half), 8) as upper, round(disp, 8) as dispersion, reasons from e2""")
def e14(spark, d):
    out = sp.summarize(sp.exclude_outliers(ratios(spark, d), CFG), CFG)
    out = out.withColumn("reasons", F.array_join("reasons", ","))
    return r6(out, "proposed_factor", "center_factor", "lower", "upper", "dispersion")


HYPO = """
ps(rpm, name) as (values (100.0::double / 6, '16.6666666667'), (100.0::double / 3, '33.3333333333'), (45.0::double, '45'), (78.26::double, '78.26')),
pr as (select 'same-nominal-speed-unspecified' as nominal_pair, 1.0::double as coarse union all
  select 'capture-' || a.name || '-rpm/intended-' || b.name || '-rpm', a.rpm / b.rpm from ps a, ps b where a.name <> b.name and a.rpm / b.rpm between 0.25 and 2.0)"""


@query("g5_rpm_hypotheses", "with" + HYPO + """, f as (select p_partkey as project_id, 0.2::double + p_size * 0.04::double as factor from part where 0.2::double + p_size * 0.04::double between 0.25 and 2.0),
  h as (select project_id, nominal_pair, coarse, factor / coarse as fine, row_number() over (partition by project_id order by abs(ln(factor / coarse)), nominal_pair) as rank
   from f, pr where factor / coarse between 0.90 and 1.10)
  select project_id, cast(rank as integer) as rank, nominal_pair, round(coarse, 9) as coarse_factor, round(fine, 9) as fine_factor from h""")
def g5(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("project_id"), (0.2 + F.col("p_size") * 0.04).alias("center_factor"))
    out = sp.rpm_hypotheses(f).select("project_id", "rank", "nominal_pair", "coarse_factor", "fine_factor")
    return r6(out, "coarse_factor", "fine_factor", places=9)


EVID = TRACKS + """,
pj as (select project_id, number as ordinal, number, 'Part  ' || part as title, side, duration * 0.98::double as observed, part, duration from tracks),
rf as (select project_id, number as ordinal, case when part % 19 = 0 then number + 1 else number end as number,
   case when part % 13 = 0 then 'other' else 'part ' || part end as title, case when part % 17 = 0 then 'Z' else lower(side) end as side, duration + 20 as duration from tracks where supplier % 9 <> 0),
dj as (select p.project_id, p.ordinal, case when r.number is null then 'track_missing' when p.number <> r.number then 'track_number_mismatch' when p.part % 13 = 0 then 'track_title_mismatch'
   when lower(p.side) <> lower(r.side) then 'track_side_mismatch' when r.duration < 45 then 'reference_duration_too_short' end as exclusion,
   ln(r.duration / p.observed) as lf from pj p left join rf r using (project_id, ordinal))"""


def project_and_reference(spark, d):
    t = tracks(spark, d)
    project = t.select("project_id", F.col("number").alias("ordinal"), "number", F.concat(F.lit("Part  "), F.col("part").cast("string")).alias("title"),
                       "side", (F.col("duration") * 0.98).alias("observed"))
    part = F.col("part")
    ref = t.where("supplier % 9 <> 0").select(
        "project_id", F.col("number").alias("ordinal"), F.when(part % 19 == 0, F.col("number") + 1).otherwise(F.col("number")).alias("number"),
        F.when(part % 13 == 0, "other").otherwise(F.concat(F.lit("part "), part.cast("string"))).alias("title"),
        F.when(part % 17 == 0, "Z").otherwise(F.lower("side")).alias("side"), (F.col("duration") + 20).alias("duration"))
    return project, ref


@query("d1_ordinal_join", "with" + EVID + " select project_id, ordinal, exclusion, case when exclusion is null then round(lf, 8) end as log_factor from dj")
def d1(spark, d):
    p, r = project_and_reference(spark, d)
    return r6(sp.track_evidence(p, r, CFG).drop("side"), "log_factor")


SPEED = EVID + """,
ex as (select project_id, ordinal, exclusion, lf, coalesce((select case when t.part % 17 = 0 then 'z' else lower(t.side) end from tracks t where t.project_id = dj.project_id and t.number = dj.ordinal), '') as side from dj),
k0 as (select project_id, median(lf) as c, count(*) as n from ex where exclusion is null group by 1), k1 as (select project_id, any_value(c) as c, median(abs(lf - c)) as mad, any_value(n) as n from ex join k0 using (project_id) where exclusion is null group by 1),
ex2 as (select e.project_id, e.lf, e.side, case when e.exclusion is null and k.n >= 3 and abs(e.lf - k.c) > greatest(0.025, 3.5 * 1.4826 * k.mad) then 'robust_log_outlier' else e.exclusion end as exclusion from ex e left join k1 k using (project_id)),
id as (select project_id, count(*) filter (exclusion in ('track_number_mismatch', 'track_title_mismatch', 'track_side_mismatch')) as bad, count(*) filter (exclusion = 'track_missing') as missing from ex2 group by 1),
lv as (select * from ex2 where exclusion is null),
c1 as (select project_id, median(lf) as c, count(*) as n from lv group by 1), m1 as (select project_id, any_value(c) as center, 1.4826 * median(abs(lf - c)) as disp, any_value(n) as tracks from lv join c1 using (project_id) group by 1),
s1 as (select project_id, side, median(lf) as c, count(*) as n from lv group by 1, 2), s2 as (select project_id, count(*) as sides, min(n) as few, max(c) - min(c) as delta from s1 group by 1),
e0 as (select project_id, bad, missing, center, disp, coalesce(tracks, 0) as tracks, coalesce(sides, 0) as sides, few, delta, case when tracks > 0 then 1.96 * 1.2533 * greatest(disp, 0.0005) / sqrt(tracks) end as half from id left join m1 using (project_id) left join s2 using (project_id)),
e1 as (select *, tracks >= 6 and sides >= 2 and disp <= 0.003 and half <= 0.004 as high, tracks >= 4 and disp <= 0.01 and half <= 0.015 as medium from e0),
e2 as (select *, concat_ws(',', case when missing > 0 then 'track_count_mismatch' end, case when bad > 0 then 'reference_identity_mismatch' end, case when tracks < 4 then 'insufficient_usable_tracks' end,
   case when tracks > 0 and exp(center) not between 0.25 and 2.0 then 'factor_outside_supported_range' end, case when disp > 0.012 then 'track_ratios_inconsistent' end,
   case when half > 0.015 then 'confidence_interval_too_wide' end, case when sides >= 2 and few < 2 then 'insufficient_independent_tracks_per_side' end,
   case when sides >= 2 and delta > 0.015 then 'side_estimates_disagree' end, case when tracks > 0 and not high and not medium then 'confidence_below_proposal_threshold' end) as reasons from e1)"""


@query("j6_estimate_speed", "with" + SPEED + """ select project_id, tracks, sides, case when reasons = '' then 'proposed' else 'abstained' end as status, case when reasons <> '' then 'none' when high then 'high' else 'medium' end as confidence,
   round(exp(center), 8) as center_factor, round(disp, 8) as dispersion, reasons from e2""")
def j6(spark, d):
    p, r = project_and_reference(spark, d)
    out = sp.summarize(sp.exclude_outliers(sp.track_evidence(p, r, CFG), CFG), CFG).withColumn("reasons", F.array_join("reasons", ","))
    return r6(out.drop("proposed_factor", "lower", "upper"), "center_factor", "dispersion")


@query("j6_guarded_speed", "with" + SPEED + """,
sf as (select o_orderkey as project_id, concat_ws(',', case o_orderkey % 7 when 0 then 'reference_duration_independence_unconfirmed' when 1 then 'reference_durations_not_independent' end,
   case o_orderkey % 5 when 0 then 'boundary_review_evidence_stale' when 1 then 'boundary_review_evidence_missing' end,
   case o_orderkey % 11 when 0 then 'release_metadata_mismatch' when 1 then 'project_release_metadata_missing' end) as safe from orders),
e3 as (select e2.*, concat_ws(',', nullif(safe, ''), nullif(reasons, '')) as why from e2 join sf using (project_id))
select project_id, tracks, sides, case when why = '' then 'proposed' else 'abstained' end as status, case when why <> '' then 'none' when high then 'high' else 'medium' end as confidence,
   round(exp(center), 8) as center_factor, why as reasons, (select count(*) from pr where exp(center) between 0.25 and 2.0 and exp(center) / coarse between 0.90 and 1.10) as hypotheses from e3""".replace("e3 as", HYPO.strip() + ",\ne3 as", 1))
def j6_guarded(spark, d):
    p, r = project_and_reference(spark, d)
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("project_id"))
    k = F.col("project_id")
    status = o.select(k, F.when(k % 5 == 0, "stale").when(k % 5 == 1, "missing").otherwise("current").alias("status"))
    free = o.select(k, F.when(k % 7 == 1, False).when(k % 7 != 0, True).alias("independent"))
    project = o.select(k, F.when(k % 11 == 1, "").otherwise("An Artist").alias("artist"), F.lit(None).cast("string").alias("album_artist"), F.lit("Album").alias("album"))
    other = o.select(k, F.when(k % 11 == 0, "Other").otherwise("an  artist").alias("artist"), F.lit("album").alias("album"))
    out = identify.estimate_speeds(p, r, status, free, sp.release_identity(project, other), CFG)
    n = out["hypotheses"].groupBy("project_id").agg(F.count("*").alias("hypotheses"))
    e = out["estimates"].join(n, "project_id", "left").fillna(0, ["hypotheses"]).withColumn("reasons", F.array_join("reasons", ","))
    return r6(e.select("project_id", "tracks", "sides", "status", "confidence", "center_factor", "reasons", "hypotheses"), "center_factor")


RANGES = TRACKS + """,
rg as (select project_id, """ + digest_sql("sha256(number || chr(10) || number || ':' || start_sample || ':' || end_sample)") + """ as h from tracks group by 1)"""


def ranges_hash(spark, d):
    t = tracks(spark, d)
    return ordered_hash(t, ["project_id"], "number", F.concat_ws(":", "number", "start_sample", "end_sample"), "ranges_sha256")


@query("b13_track_ranges_hash", "with" + RANGES + " select project_id, h as ranges_sha256 from rg")
def b13(spark, d):
    return ranges_hash(spark, d)


@query("j18_boundary_review_status", "with" + RANGES + """ select project_id, case when o_orderstatus = 'O' then 'missing' when project_id % 5 = 0 then 'stale'
   when o_orderpriority = '5-LOW' then 'inadequate' else 'current' end as status from rg join orders on o_orderkey = project_id""")
def j18(spark, d):
    same = lambda c: F.sha2(F.concat(F.lit(c), F.col("o_orderkey").cast("string")), 256).alias(c)
    o = table(spark, d, "orders")
    rg = ranges_hash(spark, d)
    ident = [same("project_sha256"), F.lit(3).alias("revision"), same("state_sha256"), same("source_sha256")]
    current = o.select(F.col("o_orderkey").alias("project_id"), *ident).join(rg, "project_id")
    kept = o.where("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("project_id"), *ident, F.lit(True).alias("all_reviewed"), (F.col("o_orderpriority") != "5-LOW").alias("independent"))
    receipts = kept.join(rg, "project_id").withColumn(
        "ranges_sha256", F.when(F.col("project_id") % 5 == 0, F.lit("old")).otherwise(F.col("ranges_sha256")))
    return sp.boundary_review_status(current, receipts)


OBS = """
obs as (select l_suppkey as album, l_linenumber as track, l_returnflag as side, l_partkey % 8 as release, 1 - l_discount as score, l_orderkey as position,
   'release ' || (l_partkey % 8) as title, case when l_partkey % 8 = 4 and l_suppkey % 10 = 0 then l_linestatus when l_partkey % 8 = 1 then '' else 'US' end as country from lineitem),
best as (select album, side, track, release, max(score) as score, min(position) filter (score = m) as position from
   (select *, max(score) over (partition by album, side, track, release) as m from obs) group by 1, 2, 3, 4),
tot as (select album, count(*) as total_tracks, count(distinct side) as total_sides from (select distinct album, side, track from obs) group by 1),
sc as (select album, release, round(sum(score) / total_tracks, 9) as evidence, round(avg(score), 9) as mean_score, count(*) as tracks, count(distinct side) as sides,
   round(count(*) / total_tracks, 9) as coverage, total_sides from best join tot using (album) group by album, release, total_tracks, total_sides),
fc as (select album, release, count(distinct nullif(country, '')) > 1 as conflict, coalesce(min(nullif(country, '')), '') as country from obs group by 1, 2)"""


def observations(spark, d):
    r = F.col("l_partkey") % 8
    country = F.when((r == 4) & (F.col("l_suppkey") % 10 == 0), F.col("l_linestatus")).when(r == 1, "").otherwise("US")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("album"), F.col("l_linenumber").alias("track"), F.col("l_returnflag").alias("side"), r.alias("release"),
        (1 - F.col("l_discount")).alias("score"), F.col("l_orderkey").alias("position"),
        F.concat(F.lit("release "), r.cast("string")).alias("title"), country.alias("country"), F.col("l_partkey").alias("part"))


FIELDS = ["title", "country"]


@query("e23_best_per_track_release", "with" + OBS + " select album, side, track, release, score, position from best")
def e23(spark, d):
    return con.best_per_track(observations(spark, d))


@query("e24_release_scores", "with" + OBS + " select album, release, evidence, mean_score, tracks, sides, coverage from sc")
def e24(spark, d):
    o = observations(spark, d)
    return con.score_releases(con.best_per_track(o), con.album_totals(o)).drop("total_tracks", "total_sides")


@query("e25_fact_conflicts", "with" + OBS + " select album, release, case when conflict then 'country' else '' end as conflicts, country from fc")
def e25(spark, d):
    f = con.release_facts(observations(spark, d), FIELDS)
    return f.select("album", "release", F.array_join("conflicts", ",").alias("conflicts"), "country")


@query("f18_rank_and_margin", "with" + OBS + """ select album, release, cast(row_number() over w as integer) as rank, round(evidence - lead(evidence) over w, 9) as margin from sc
   window w as (partition by album order by evidence desc, tracks desc, sides desc, release)""")
def f18(spark, d):
    o = observations(spark, d)
    out = con.rank_releases(con.score_releases(con.best_per_track(o), con.album_totals(o)))
    return out.select("album", "release", "rank", "margin")


J7 = "with" + OBS + """,
  cl as (select s.* from sc s join fc f using (album, release) where not f.conflict),
  rk as (select *, row_number() over w as rank, round(evidence - lead(evidence) over w, 9) as margin from cl window w as (partition by album order by evidence desc, tracks desc, sides desc, release)),
  cf as (select album, count(*) filter (conflict) as nc from fc group by 1),
  dd as (select c.album, nc, r.*  exclude (album), concat_ws(',', case when tracks < 2 then 'insufficient_independent_track_support' end, case when coverage < 0.5 then 'insufficient_album_track_coverage' end,
    case when mean_score < 0.75 then 'recognition_scores_too_low' end, case when sides < total_sides then 'candidate_not_supported_across_independent_sides' end) as low
    from cf c left join rk r on r.album = c.album and r.rank = 1),
  d2 as (select *, case when nc > 0 or release is null or low <> '' then 'abstained' when margin < 0.10 then 'ambiguous' else 'proposed' end as status from dd)
  select album, status, margin, release as top_ranked, case when status = 'proposed' then release end as selected,
   case status when 'abstained' then 'none' when 'ambiguous' then 'low' else case when coverage >= 0.75 and mean_score >= 0.9 and sides = total_sides and (margin is null or margin >= 0.15) then 'high' else 'medium' end end as confidence,
   case when nc > 0 then 'conflicting_network_release_facts_require_review' when release is null then 'no_consistent_exact_release_candidates' when low <> '' then low
     when margin < 0.10 then 'top_release_candidates_are_not_separated' else 'cross_track_release_consensus_requires_owner_review' end as reasons from d2"""


@query("j7_identify_release", J7)
def j7(spark, d):
    o = observations(spark, d)
    totals = con.album_totals(o)
    out = con.decide(con.score_releases(con.best_per_track(o), totals), con.release_facts(o, FIELDS), totals, con.ConsensusConfig())
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("j7_guarded_identity", "with j7 as (" + J7 + """), now as (select l_suppkey as album, l_returnflag as side, l_linenumber as track from lineitem where l_suppkey % 7 <> 3 or l_linenumber <> 6),
  stale as (select distinct l_suppkey as album, 'unknown_track' as reason from lineitem l where not exists (select 1 from now where album = l_suppkey and side = l_returnflag and track = l_linenumber)),
  many as (select l_suppkey as album, 'too_many_release_references' as reason from lineitem group by 1 having sum(case when l_suppkey % 7 = 4 then 500 else 1 end) > 32768),
  bad as (select album, string_agg(reason, ',' order by reason) as reasons from (select * from stale union all select * from many) group by 1)
  select album, status, top_ranked, selected, confidence, reasons from j7 where album not in (select album from bad)
  union all select album, 'refused', null, null, 'none', reasons from bad""")
def j7_guarded(spark, d):
    o = observations(spark, d).withColumns({
        "references": F.when(F.col("album") % 7 == 4, 500).otherwise(1).cast("bigint"), "bytes": F.lit(100).cast("bigint")})
    now = o.where("album % 7 <> 3 or track <> 6").groupBy("album", "side", "track").agg(F.lit(1).alias("kept")).withColumn("kept", F.lit(1))
    out = identify.identify_releases(o.withColumn("kept", F.lit(1)), now, ["kept"], FIELDS, con.ConsensusConfig())
    said = out["decisions"].select("album", "status", "top_ranked", "selected", "confidence", F.array_join("reasons", ",").alias("reasons"))
    refused = out["refused"].select("album", F.lit("refused").alias("status"), F.lit("none").alias("confidence"), F.array_join("reasons", ",").alias("reasons"))
    return said.unionByName(refused, allowMissingColumns=True)


@query("j7_pressing_gaps", "with" + OBS + """, cl as (select s.*, f.country from sc s join fc f using (album, release) where not f.conflict),
  rk as (select *, row_number() over (partition by album order by evidence desc, tracks desc, sides desc, release) as rank from cl)
  select a.album, r.release, case when coalesce(r.country, '') = '' then 'country,' else '' end || 'date,label,catalog_number,barcode,media_formats,matrix_runout' as missing
  from (select distinct album from fc) a left join rk r on r.album = a.album and rank = 1""")
def j7_gaps(spark, d):
    o = observations(spark, d)
    totals, facts = con.album_totals(o), con.release_facts(o, FIELDS)
    dec = con.decide(con.score_releases(con.best_per_track(o), totals), facts, totals, con.ConsensusConfig())
    return con.pressing_gaps(dec, facts).withColumn("missing", F.array_join("missing", ","))


@query("c15_volume_caps", """select l_suppkey as album, count(*) as matches, cast(sum(l_linenumber * 12) as bigint) as references, cast(sum(l_quantity * 1000) as bigint) as bytes,
   concat_ws(',', case when count(*) > 8192 then 'too_many_matches' end, case when sum(l_linenumber * 12) > 32768 then 'too_many_release_references' end,
    case when sum(l_quantity * 1000) > 16777216 then 'evidence_too_large' end) as reasons from lineitem group by 1""")
def c15(spark, d):
    o = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("album"), (F.col("l_linenumber") * 12).cast("bigint").alias("references"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("bytes"))
    return con.volume_caps(o).withColumn("reasons", F.array_join("reasons", ","))


@query("d13_evidence_binding", """with t as (select l_suppkey as album, l_returnflag as side, l_linenumber as track, max(l_partkey) as part, max(l_linestatus) as state from lineitem where l_linenumber <> 7 group by 1, 2, 3)
  select l_suppkey as album, l_orderkey as position, l_partkey as part, case when t.album is null then 'unknown_track' else concat_ws(',', case when l.l_partkey <> t.part then 'stale_part' end,
   case when l.l_linestatus <> t.state then 'stale_state' end) end as reasons from lineitem l left join t on t.album = l_suppkey and t.side = l_returnflag and t.track = l_linenumber""")
def d13(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("album"), F.col("l_returnflag").alias("side"), F.col("l_linenumber").alias("track"),
        F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("state"), F.col("l_orderkey").alias("position"))
    now = li.where("track <> 7").groupBy("album", "side", "track").agg(F.max("part").alias("part"), F.max("state").alias("state"))
    out = con.evidence_binding(li, now, ["part", "state"])
    return out.select("album", "position", "part", F.array_join("reasons", ",").alias("reasons"))
