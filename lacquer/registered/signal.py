"""Envelope, thresholds, runs and gap candidates over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import SIG, sig
from ..config import SegmentSettings
from ..operators import envelope as env_ops
from ..operators import gaps as gap_ops
from ..operators.ordered import flag_runs, windowed
from .common import query

CFG = SegmentSettings(
    rate=100, window_samples=5, smoothing_windows=3, min_gap_seconds=0.15, max_gap_seconds=1.5,
    min_track_seconds=2.0, lead_in_seconds=0.5, tail_seconds=1.0, waveform_points=100,
)

ENV = SIG + """,
env as (select capture_id, sample_ix // 5 as win_ix, 20*log10(greatest(sqrt(avg(amp*amp)), 1e-9)) as rms_db
  from sig group by 1, 2)"""
SM = ENV + """,
cnt as (select capture_id, count(*) as n, max(win_ix) as last_ix from env group by 1),
sm as (select e.capture_id, e.win_ix, c.n, case when c.n < 3 then e.rms_db else
   (coalesce(lag(e.rms_db) over w, e.rms_db) + e.rms_db + coalesce(lead(e.rms_db) over w, e.rms_db)) / 3 end as db
  from env e join cnt c using (capture_id) window w as (partition by e.capture_id order by e.win_ix))"""
TH = SM + """,
aud as (select capture_id, n, db, count(*) filter (db > -90) over (partition by capture_id) as na from sm),
q as (select capture_id, max(n) as windows, quantile_cont(db, 0.03) as p3, quantile_cont(db, 0.5) as p50,
   quantile_cont(db, 0.75) as p75 from aud where db > -90 or na < greatest(20, n // 200) group by 1),
th as (select capture_id, windows, p3 as noise_floor_db, sil as silence_db,
   least(-12.0, greatest(-58.0, greatest(least(sil + 12.0, p75 - 4.0), sil + 4.0))) as active_db
  from (select *, least(-24.0, greatest(-68.0, least(p3 + 6.0, p50 - 9.0))) as sil from q))"""
BND = TH + """,
dur as (select capture_id, count(*) / 100.0::double as duration_seconds from sig group by 1),
hit as (select s.capture_id, s.win_ix, k.kind, t.windows from sm s join th t using (capture_id)
   join (values ('core'), ('edge')) k(kind) on case k.kind when 'core' then s.db > t.active_db
     else s.db > least(t.active_db, t.silence_db) end),
isl as (select capture_id, kind, max(windows) as windows, min(win_ix) as s, max(win_ix) + 1 as e from
   (select *, win_ix - row_number() over (partition by capture_id, kind order by win_ix) as g from hit) group by capture_id, kind, g),
sus as (select * from isl where e - s >= least(9, windows)),
edg as (select capture_id, min(s) filter (kind = 'edge') as f, max(e) filter (kind = 'edge') as l from sus
   group by 1 having count(*) filter (kind = 'core') > 0),
bnd as (select capture_id, duration_seconds, core_start, core_end, greatest(0.0::double, core_start - 0.5::double) as music_start,
   least(duration_seconds, core_end + 1.0::double) as music_end from
   (select capture_id, duration_seconds, f * 0.05::double as core_start, least(duration_seconds, l * 0.05::double) as core_end
    from edg join dur using (capture_id)) where core_end > core_start)"""
RUN = BND + """,
lim as (select b.*, t.silence_db, cast(greatest(0, floor(music_start / 0.05::double)) as bigint) as lo_ix,
   cast(least(t.windows, ceil(music_end / 0.05::double)) as bigint) as hi_ix from bnd b join th t using (capture_id)),
qt as (select s.capture_id, s.win_ix, s.win_ix - lag(s.win_ix) over (partition by s.capture_id order by s.win_ix) as step
   from sm s join lim l using (capture_id) where s.db < l.silence_db and s.win_ix >= l.lo_ix and s.win_ix < l.hi_ix),
qg as (select *, sum(case when step is null or step > 6 then 1 else 0 end) over (partition by capture_id order by win_ix) as g from qt),
qr as (select capture_id, min(win_ix) as rs, max(win_ix) + 1 as re, count(*) as quiet from qg group by capture_id, g
   having max(win_ix) + 1 - min(win_ix) >= 3)"""
CAND = RUN + """,
nr as (select q.capture_id, q.rs, q.re, l.silence_db, l.music_start, l.music_end, s.win_ix, s.db,
   s.win_ix >= q.rs and s.win_ix < q.re as inside
   from qr q join lim l using (capture_id) join sm s on s.capture_id = q.capture_id
    and s.win_ix >= greatest(l.lo_ix, q.rs - 20) and s.win_ix < least(l.hi_ix, q.re + 20)),
st as (select capture_id, rs, re, silence_db, music_start, music_end, min(db) filter (inside) as mn,
   avg(db) filter (inside) as me, avg(db) filter (not inside) as cx from nr group by all),
ct as (select t.*, (select arg_min(s.win_ix, abs(s.win_ix - t.rs - (t.re - t.rs - 1) / 2.0) * 1000000 + (s.win_ix - t.rs))
    from sm s where s.capture_id = t.capture_id and s.win_ix >= t.rs and s.win_ix < t.re and s.db <= t.mn + 3.0) as cut_ix from st t),
c1 as (select *, least(music_end, (cut_ix + 0.5) * 0.05::double) as cut_seconds, (re - rs) * 0.05::double as dur,
   greatest(0.0, coalesce(cx, silence_db) - me) as contrast from ct),
cand as (select capture_id, rs as start_ix, re as end_ix, cut_ix, rs * 0.05::double as start_seconds, least(music_end, re * 0.05::double) as end_seconds,
   cut_seconds, cast(round_even(cut_seconds * 100, 0) as bigint) as cut_sample, dur as duration_seconds, mn as minimum_db,
   me as mean_db, contrast as contrast_db,
   least(1, greatest(0, 0.15 + 0.25 * least(1, greatest(0, (least(dur, 1.5) - 0.15) / 2.85))
    + 0.20 * least(1, greatest(0, (silence_db - mn) / 20)) + 0.20 * least(1, greatest(0, (silence_db - me) / 12))
    + 0.20 * least(1, greatest(0, contrast / 20)))) as score
  from c1 where cut_seconds - music_start >= 2.0 and music_end - cut_seconds >= 2.0)"""


def envelope_of(spark, d):
    return env_ops.rms_envelope(sig(spark, d), CFG.window_samples)


def smoothed(spark, d):
    return env_ops.smooth(envelope_of(spark, d), CFG.smoothing_windows)


def staged_env(spark, d, cfg=CFG):
    from ..session import stage

    env = stage(smoothed(spark, d))
    return env, stage(env_ops.thresholds(env, cfg.margin_db))


def durations(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.groupBy(F.col("event_type").alias("capture_id")).agg((F.count(F.lit(1)) / 100.0).alias("duration_seconds"))


def bounds_of(spark, d, cfg=CFG):
    env, th = staged_env(spark, d, cfg)
    from ..session import stage

    return env, th, stage(gap_ops.music_bounds(env, th, durations(spark, d), cfg))


def candidates_of(spark, d, cfg=CFG):
    env, th, b = bounds_of(spark, d, cfg)
    return env, th, b, gap_ops.gap_candidates(env, gap_ops.quiet_runs(env, th, b, cfg), cfg)


def flagship(spark, d):
    """Gap candidates with a minimum track short enough for the two-second recordings of the smallest tables."""
    from dataclasses import replace

    return candidates_of(spark, d, replace(CFG, min_track_seconds=0.1))[3]


def rounded(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


@query("a1_exact_range_scan", "with" + SIG + """
  select capture_id, count(*) as frames, count(*) = 300 as complete, round(sum(amp), 8) as total
  from sig where sample_ix >= 130 and sample_ix < 430 group by 1""")
def exact_range(spark, d):
    from ..sources.blocks import read_range, to_blocks

    blocks = to_blocks(sig(spark, d).withColumn("channel", F.lit(0)), 64)
    out = read_range(blocks, 130, 430, 64)
    return out.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("frames"), F.first("complete").alias("complete"), F.round(F.sum("amp"), 8).alias("total")
    )


@query("b1_rms_dbfs", "with" + SIG + """
  select capture_id, user_id, round(20*log10(greatest(sqrt(avg(amp*amp)), 1e-9)), 6) as rms_db from sig group by 1, 2""")
def rms_per_user(spark, d):
    from ..functions.levels import rms_db

    s = sig(spark, d)
    return s.groupBy("capture_id", "user_id").agg(F.round(rms_db(F.avg(F.col("amp") * F.col("amp"))), 6).alias("rms_db"))


@query("b3_normalized_level", "with" + ENV + """
  select capture_id, win_ix, round(least(1, greatest(0, (rms_db + 72.0) / 66.0)), 5) as level from env""")
def level(spark, d):
    from ..functions.levels import normalized_level

    return envelope_of(spark, d).select("capture_id", "win_ix", normalized_level(F.col("rms_db")).alias("level"))


@query("e1_rms_envelope", "with" + ENV + " select capture_id, win_ix, round(rms_db, 6) as rms_db from env")
def e1(spark, d):
    return rounded(envelope_of(spark, d), "rms_db")


@query("e1_rms_envelope_from_blocks", "with" + ENV + " select capture_id, win_ix, round(rms_db, 6) as rms_db from env")
def e1_blocks(spark, d):
    from ..sources.blocks import to_blocks

    blocks = to_blocks(sig(spark, d).withColumn("channel", F.lit(0)), 64)
    return rounded(env_ops.rms_envelope_blocks(blocks, 5), "rms_db")


@query("f1_smooth_envelope", "with" + SM + " select capture_id, win_ix, round(db, 6) as db from sm")
def f1(spark, d):
    return rounded(smoothed(spark, d).select("capture_id", "win_ix", "db"), "db")


@query("e2_thresholds", "with" + TH + """ select capture_id, windows, round(noise_floor_db, 6) as noise_floor_db,
   round(silence_db, 6) as silence_db, round(active_db, 6) as active_db from th""")
def e2(spark, d):
    return rounded(env_ops.thresholds(smoothed(spark, d), CFG.margin_db), "noise_floor_db", "silence_db", "active_db")


@query("e3_waveform_summary", "with" + SM + """,
  b as (select capture_id, db, win_ix, n, ((win_ix + 1) * 100 - 1) // n as g from sm),
  b2 as (select capture_id, db, case when n <= 100 then win_ix when win_ix < floor(g * (n / 100.0)) then g - 1
     when win_ix >= case when g + 1 >= 100 then n else floor((g + 1) * (n / 100.0)) end then g + 1 else g end as bucket from b)
  select capture_id, cast(bucket as bigint) as bucket, round(least(1, greatest(0, (max(db) + 72.0) / 66.0)), 5) as level from b2 group by all""")
def e3(spark, d):
    return env_ops.summarize_waveform(smoothed(spark, d), CFG.waveform_points)


@query("e4_minmax_rms_buckets", "with" + SIG + """,
  c as (select capture_id, count(*) as n from sig group by 1),
  b as (select capture_id, amp, sample_ix, n, ((sample_ix + 1) * 240 - 1) // n as g from sig join c using (capture_id)),
  b2 as (select capture_id, amp, case when n <= 240 then sample_ix when sample_ix < floor(g * (n / 240.0)) then g - 1
     when sample_ix >= case when g + 1 >= 240 then n else floor((g + 1) * (n / 240.0)) end then g + 1 else g end as bucket from b)
  select capture_id, cast(bucket as bigint) as bucket, round(min(amp), 9) as lo, round(max(amp), 9) as hi, round(sqrt(avg(amp*amp)), 9) as rms
  from b2 group by all""")
def e4(spark, d):
    return rounded(env_ops.minmax_buckets(sig(spark, d), 240), "lo", "hi", "rms", places=9)


@query("f2_music_bounds", "with" + BND + """ select capture_id, duration_seconds, round(core_start, 6) as core_start,
  round(core_end, 6) as core_end, round(music_start, 6) as music_start, round(music_end, 6) as music_end from bnd""")
def f2(spark, d):
    return rounded(bounds_of(spark, d)[2], "core_start", "core_end", "music_start", "music_end")


@query("f3_bridged_quiet_runs", "with" + RUN + " select capture_id, rs as start_ix, re as end_ix, quiet as quiet_windows from qr")
def f3(spark, d):
    env, th, b = bounds_of(spark, d)
    runs = gap_ops.quiet_runs(env, th, b, CFG)
    return runs.select("capture_id", "start_ix", "end_ix", F.col("n_parts").alias("quiet_windows"))


@query("f4_gaps_and_islands", "with" + SIG + """, h as (select capture_id, sample_ix, sample_ix - row_number() over
   (partition by capture_id order by sample_ix) as g from sig where amp > 0)
  select capture_id, min(sample_ix) as start_ix, max(sample_ix) + 1 as end_ix from h group by capture_id, g having count(*) >= 3""")
def f4(spark, d):
    runs = flag_runs(sig(spark, d), ["capture_id"], "sample_ix", F.col("amp") > 0)
    return runs.where("end_ix - start_ix >= 3").select("capture_id", "start_ix", "end_ix")


@query("f6_derivative_curvature", "with" + SIG + """ select capture_id, sample_ix,
   round(amp - coalesce(lag(amp) over w, amp), 9) as derivative,
   round(abs((amp - lag(amp) over w) - (lead(amp) over w - amp)), 9) as curvature
  from sig window w as (partition by capture_id order by sample_ix)""")
def f6(spark, d):
    from ..operators.impulses import derivatives

    out = derivatives(sig(spark, d), ["capture_id"])
    return rounded(out.select("capture_id", "sample_ix", "derivative", "curvature"), "derivative", "curvature", places=9)


@query("e5_gap_statistics", "with" + CAND + """ select capture_id, start_ix, end_ix, cut_ix, round(start_seconds, 6) as start_seconds,
  round(end_seconds, 6) as end_seconds, round(cut_seconds, 6) as cut_seconds, cut_sample, round(duration_seconds, 6) as duration_seconds,
  round(minimum_db, 6) as minimum_db, round(mean_db, 6) as mean_db, round(contrast_db, 6) as contrast_db, round(score, 6) as score from cand""")
def e5(spark, d):
    return rounded(candidates_of(spark, d)[3], "start_seconds", "end_seconds", "cut_seconds", "duration_seconds",
                   "minimum_db", "mean_db", "contrast_db", "score")


@query("f5_run_context", "with" + RUN + """ select q.capture_id, q.rs as start_ix,
    round(avg(s.db) filter (s.win_ix < q.rs), 6) as before_db, round(avg(s.db) filter (s.win_ix >= q.re), 6) as after_db
   from qr q join lim l using (capture_id) join sm s on s.capture_id = q.capture_id
    and s.win_ix >= greatest(l.lo_ix, q.rs - 20) and s.win_ix < least(l.hi_ix, q.re + 20) group by all""")
def f5(spark, d):
    from ..operators.intervals import points_in

    env, th, b = bounds_of(spark, d)
    runs = gap_ops.quiet_runs(env, th, b, CFG).select(
        "capture_id", F.col("start_ix").alias("run_start"), F.col("end_ix").alias("run_end"),
        F.greatest("lo_ix", F.col("start_ix") - 20).alias("start_ix"), F.least("hi_ix", F.col("end_ix") + 20).alias("end_ix"))
    near = points_in(env.select("capture_id", "win_ix", "db"), runs, ["capture_id"], "win_ix")
    return near.groupBy("capture_id", F.col("run_start").alias("start_ix"), "run_end").agg(
        F.round(F.avg(F.when(F.col("win_ix") < F.col("run_start"), F.col("db"))), 6).alias("before_db"),
        F.round(F.avg(F.when(F.col("win_ix") >= F.col("run_end"), F.col("db"))), 6).alias("after_db"),
    ).drop("run_end")


@query("e7_joined_side_gaps", "with" + CAND + """,
  m as (select *, case when start_seconds - lag(end_seconds) over w <= 3.0 then 0 else 1 end as o from cand
     window w as (partition by capture_id order by start_seconds)),
  g as (select *, sum(o) over (partition by capture_id order by start_seconds) as grp from m)
  select capture_id, round(min(start_seconds), 6) as start_seconds, round(max(end_seconds), 6) as end_seconds,
   round(arg_max(cut_seconds, score), 6) as cut_seconds, count(*) as n_parts,
   round(case when count(*) = 1 then max(duration_seconds) else max(end_seconds) - min(start_seconds) end, 6) as duration_seconds,
   round(min(minimum_db), 6) as minimum_db, round(sum(mean_db * duration_seconds) / sum(duration_seconds), 6) as mean_db,
   round(max(contrast_db), 6) as contrast_db, round(max(score), 6) as score from g group by capture_id, grp""")
def e7(spark, d):
    out = gap_ops.joined_side_gaps(candidates_of(spark, d)[3], max_break=3.0).drop("cut_sample")
    return rounded(out, "start_seconds", "end_seconds", "cut_seconds", "duration_seconds", "minimum_db", "mean_db",
                   "contrast_db", "score")


@query("e6_gap_score", "with" + CAND + " select capture_id, start_ix, round(score, 6) as score from cand")
def e6(spark, d):
    return rounded(candidates_of(spark, d)[3].select("capture_id", "start_ix", "score"), "score")
