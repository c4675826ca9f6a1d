"""Corpus evaluation over the events table read as review records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import table
from ..functions.hashing import hash_bucket, source_split
from ..operators import corpus as ev
from .common import digest_sql, query

CFG = ev.EvaluationConfig(salt="a" * 64, evaluation_basis_points=5000)
PAIR_CFG = ev.EvaluationConfig(salt="a" * 64, evaluation_basis_points=5000, minimum_pair_coverage=100)
KINDS = {"click": "boundary", "view": "endpoint", "purchase": "speed", "signup": "recognition", "error": "restoration"}

REC = """
r0 as (select event_id, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k,
   case event_type when 'click' then 'boundary' when 'view' then 'endpoint' when 'purchase' then 'speed' when 'signup' then 'recognition' else 'restoration' end as category,
   sha256('source-' || user_id) as source from events),
r1 as (select *, ['accepted', 'adjusted', 'protected', 'rejected'][k % 4 + 1] as outcome, 'cfg' || (event_id % 2) as config,
   user_id || '|' || event_type || '|' || k as benchmark from r0),
rec as (select *, case when cast(('0x' || substr(sha256('source-group-split/1' || chr(0) || repeat('a', 64) || chr(0) || source), 1, 16)) as ubigint) % 10000 < 5000
    then 'evaluation' else 'development' end as split
  from r1 where event_id in (select min(event_id) from r1 group by config, benchmark))"""
TGT = REC + """,
tg as (select *, case when k % 11 = 0 then null when category in ('boundary', 'endpoint') then abs(round_even(value * 100, 0) - floor(value) * 100)
    when category = 'speed' then cast(value as decimal(12, 2)) / 1000.0 - cast(floor(value) as decimal(12, 2)) / 1000.0
    when category = 'recognition' then case when k % 5 = k % 4 then 0 else 1 end end::double as loss,
   case when category = 'speed' and k % 11 <> 0 then (value - floor(value)) / (1000 + floor(value)) * 1e6 end as ppm,
   case when category in ('boundary', 'endpoint') then cast(floor(value) * 100 as bigint)::varchar when category = 'speed' then floor(value)::varchar
     when category = 'recognition' then (k % 4)::varchar end as target from rec)"""


def records(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    e = e.select(
        "event_id", "k", "value", kind[F.col("event_type")].alias("category"),
        F.sha2(F.concat(F.lit("source-"), F.col("user_id").cast("string")), 256).alias("source"),
        F.element_at(F.array(*[F.lit(o) for o in ev.OUTCOMES]), (F.col("k") % 4 + 1).cast("int")).alias("outcome"),
        F.concat(F.lit("cfg"), (F.col("event_id") % 2).cast("string")).alias("config"),
        F.concat_ws("|", "user_id", "event_type", "k").alias("benchmark"),
        F.concat(F.col("event_type"), F.when(F.col("k") % 7 == 0, " Odd").otherwise("")).alias("kind"),
    )
    whole = F.floor("value").cast("bigint")
    uid = lambda c: F.concat(F.lit("00000000-0000-4000-8000-00000000000"), c.cast("string"))
    thousand = lambda c: ((c.cast("decimal(12,2)") + 1000) / 1000).cast("decimal(14,5)").cast("string")
    frame = F.col("category").isin("boundary", "endpoint")
    proposal = (
        F.when(frame, F.format_string('{"proposed_frame":%d}', F.bround(F.col("value") * 100).cast("bigint")))
        .when(F.col("category") == "speed", F.format_string('{"proposed_factor":%s}', thousand(F.col("value"))))
        .otherwise(F.format_string('{"release_mbid":"%s"}', uid(F.col("k") % 5)))
    )
    owner = (
        F.when(F.col("k") % 11 == 0, F.lit("{}"))
        .when(frame, F.format_string('{"final_frame":%d}', whole * 100))
        .when(F.col("category") == "speed", F.format_string('{"final_factor":%s}', thousand(whole)))
        .otherwise(F.format_string('{"release_mbid":"%s"}', uid(F.col("k") % 4)))
    )
    e = e.withColumn("proposal_payload", proposal).withColumn("owner_payload", owner).withColumn(
        "sample_count", F.lit(100000).cast("bigint"))
    rest = [c for c in e.columns if c not in ("config", "benchmark", "event_id", "k", "value")]
    first = e.groupBy("config", "benchmark").agg(F.min(F.struct("event_id", *rest)).alias("r"))
    return ev.with_split(first.select("config", "benchmark", "r.*"), CFG)


@query("b16_hash_split", "with" + REC + """ select user_id, split,
   cast(cast(('0x' || substr(sha256('b' || user_id), 1, 16)) as ubigint) % 10000 as integer) as bucket from rec group by all""")
def b16(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    src = F.sha2(F.concat(F.lit("source-"), F.col("user_id").cast("string")), 256)
    return u.select("user_id", source_split(src, CFG.salt, 5000).alias("split"),
                    hash_bucket(F.concat(F.lit("b"), F.col("user_id").cast("string"))).alias("bucket"))


@query("b24_record_kind_identity", """select distinct case when k % 7 = 0 then null else event_type end as kind,
   sha256('{"proposal_kind":"' || event_type || case when k % 7 = 0 then ' Odd' else '' end || '"}') as identity
   from (select event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events)""")
def b24(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    kind, ident = ev.kind_identity(F.concat(F.col("event_type"), F.when(F.col("k") % 7 == 0, " Odd").otherwise("")))
    return e.select(kind.alias("kind"), ident.alias("identity")).distinct()


@query("b26_typed_targets", "with" + TGT + " select event_id, category, round(loss, 6) as loss, round(ppm, 9) as ppm from tg")
def b26(spark, d):
    out = ev.with_targets(records(spark, d))
    return out.select("event_id", "category", F.round(F.col("loss").cast("double"), 6).alias("loss"), F.round("ppm", 9).alias("ppm"))


@query("e17_dense_coverage", "with" + REC + """,
  c(category) as (values ('boundary'), ('endpoint'), ('recognition'), ('restoration'), ('speed'), ('structural-event')),
  o(outcome) as (values ('accepted'), ('adjusted'), ('protected'), ('rejected'))
  select 'pair' as level, c.category, o.outcome, count(r.event_id) as record_count, count(distinct r.source) as source_count
   from c cross join o left join rec r on r.category = c.category and r.outcome = o.outcome group by all
  union all select 'category', c.category, '*', count(r.event_id), count(distinct r.source) from c left join rec r using (category) group by all
  union all select 'outcome', '*', o.outcome, count(r.event_id), count(distinct r.source) from o left join rec r using (outcome) group by all""")
def e17(spark, d):
    return ev.coverage(records(spark, d))


@query("e18_keyed_coverage", "with" + REC + """ select config, case when k % 7 = 0 then event_type || ' Odd' else event_type end as kind,
   count(*) as record_count, count(distinct source) as source_count from rec group by 1, 2""")
def e18(spark, d):
    return ev.keyed_coverage(records(spark, d), ["config", "kind"])


@query("e19_split_report", "with" + REC + """, s as (select split, count(*) as record_count, count(distinct source) as source_count from rec group by 1),
  h as (select distinct split, sha256(source) as h from rec), w as (select split, """ + digest_sql("h") + """ as source_set_sha256 from h group by 1) select * from s join w using (split)""")
def e19(spark, d):
    return ev.split_report(records(spark, d))


METRICS = TGT + """,
  m as (select category, count(loss) as eligible, count(*) - count(loss) as ineligible, count(distinct source) filter (loss is not null) as source_count,
    avg(loss) as mean_loss, median(loss) as median_loss, max(loss) as max_loss, count(*) filter (loss = 0) as exact_count, avg(ppm) as mean_ppm, max(ppm) as max_ppm
   from tg where split = 'evaluation' and category in ('boundary', 'endpoint', 'speed', 'recognition') group by 1)"""


@query("e20_typed_metrics", "with" + METRICS + """ select category, eligible, ineligible, source_count, false as abstained, round(mean_loss, 8) as mean_loss,
   round(median_loss, 8) as median_loss, round(max_loss, 8) as max_loss, exact_count, round(mean_ppm, 5) as mean_ppm, round(max_ppm, 5) as max_ppm,
   case when category = 'recognition' then exact_count * 10000 // eligible end as match_rate_bp from m""")
def e20(spark, d):
    m = ev.typed_metrics(records(spark, d), CFG).drop("reasons")
    return m.select("category", "eligible", "ineligible", "source_count", "abstained", "exact_count", "match_rate_bp",
                    *[F.round(c, 8).alias(c) for c in ("mean_loss", "median_loss", "max_loss")],
                    *[F.round(c, 5).alias(c) for c in ("mean_ppm", "max_ppm")])


PAIRS = TGT + """,
  pr as (select b.category, b.benchmark, b.source, b.loss as bl, c.loss as cl, case when b.category = 'restoration' then 'no_adapter'
     when b.loss is null or c.loss is null then 'untyped' when b.target <> c.target then 'target_mismatch' else 'typed' end as state
   from tg b join tg c on b.category = c.category and b.benchmark = c.benchmark and b.config = 'cfg0' and c.config = 'cfg1' and b.split = 'evaluation' and c.split = 'evaluation')"""


@query("d12_paired_benchmarks", "with" + PAIRS + " select category, benchmark, state, round(bl, 6) as b_loss, round(cl, 6) as c_loss from pr")
def d12(spark, d):
    p = ev.paired_records(records(spark, d), "cfg0", "cfg1")
    return p.select("category", "benchmark", "state", F.round(F.col("b_loss").cast("double"), 6).alias("b_loss"),
                    F.round(F.col("c_loss").cast("double"), 6).alias("c_loss"))


@query("e21_paired_comparison", "with" + PAIRS + """,
  c(category) as (values ('boundary'), ('endpoint'), ('recognition'), ('restoration'), ('speed'), ('structural-event')),
  t as (select c.category, count(*) filter (config = 'cfg0') as baseline_records, count(*) filter (config = 'cfg1') as candidate_records from c
     left join (select * from rec where split = 'evaluation') r using (category) group by 1),
  a as (select category, count(*) as paired, count(*) filter (state = 'typed') as typed, count(*) filter (state = 'untyped') as untyped,
     count(*) filter (state = 'target_mismatch') as mismatch, count(distinct source) filter (state = 'typed') as sources,
     avg(bl) filter (state = 'typed') as bm, avg(cl) filter (state = 'typed') as cm, count(*) filter (state = 'typed' and cl < bl - 1e-12) as cw,
     count(*) filter (state = 'typed' and bl < cl - 1e-12) as bw from pr group by 1),
  j as (select t.*, coalesce(paired, 0) as paired, coalesce(typed, 0) as typed, coalesce(untyped, 0) as untyped, coalesce(mismatch, 0) as mismatch, coalesce(sources, 0) as sources,
     case when baseline_records > 0 then coalesce(paired, 0) * 10000 // baseline_records else 0 end as baseline_coverage_bp,
     case when candidate_records > 0 then coalesce(paired, 0) * 10000 // candidate_records else 0 end as candidate_coverage_bp, bm, cm, cw, bw from t left join a using (category)),
  q as (select *, case when category in ('restoration', 'structural-event') then 'no_defensible_typed_target_adapter' else concat_ws(',',
     case when typed < 3 then 'insufficient_paired_typed_benchmarks' end, case when sources < 2 then 'insufficient_paired_sources' end,
     case when least(baseline_coverage_bp, candidate_coverage_bp) < 100 then 'imbalanced_or_unpaired_config_coverage' end,
     case when mismatch > 0 then 'owner_target_mismatch' end) end as reasons from j)
  select category, baseline_records, candidate_records, paired, typed, untyped, mismatch, sources, baseline_coverage_bp, candidate_coverage_bp, reasons,
    case when reasons = '' then round(bm, 8) end as baseline_mean, case when reasons = '' then round(cm, 8) end as candidate_mean,
    case when reasons = '' then round(cm - bm, 8) end as difference, case when reasons = '' then cw end as candidate_lower,
    case when reasons = '' then bw end as baseline_lower from q""")
def e21(spark, d):
    out = ev.compare_configs(records(spark, d), "cfg0", "cfg1", PAIR_CFG)
    out = out.withColumn("reasons", F.array_join("reasons", ",")).drop("abstained", "equal")
    return out.select(*[F.round(c, 8).alias(c) if c in ("baseline_mean", "candidate_mean", "difference") else F.col(c) for c in out.columns])


@query("e22_sufficiency", "with" + TGT + """ select count(*) as record_count, count(distinct source) as source_count,
   count(*) filter (split = 'development') as development_records, count(distinct source) filter (split = 'development') as development_sources,
   count(*) filter (split = 'evaluation') as evaluation_records, count(distinct source) filter (split = 'evaluation') as evaluation_sources, true as sufficient, '' as reasons from tg""")
def e22(spark, d):
    r = records(spark, d)
    return ev.sufficiency(r, ev.typed_metrics(r, CFG)).withColumn("reasons", F.array_join("reasons", ","))
