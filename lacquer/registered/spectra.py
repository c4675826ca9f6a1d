"""Spectral, noise and endpoint queries over events read as recordings at 1 kHz, and over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import SIG, sig, table
from ..operators import impulses as imp
from ..operators import noise as nz
from ..operators import overlaid
from ..operators import points
from ..operators import spectral as sx
from ..operators.regions import tiles
from ..plans import endpoints, evidence, events, noise
from ..sources.blocks import to_blocks
from ..session import stage
from .common import digest_sql, query
from .corpus import CFG as CORPUS_CFG
from .corpus import METRICS, records
from .events import SPIKES, lengths, sig_values

RATE, BLOCK, WIN = 1000, 4096, 250
# Mains lines: read at 500 samples a second, windows of 200 have a bin at every line and overtone.
HUM_RATE, HUM_WIN = 500, 200


def blocks(spark, d):
    return stage(to_blocks(sig(spark, d).withColumn("channel", F.lit(0)), BLOCK))


def extent(spark, d):
    return lengths(spark, d)


def references(spark, d):
    """The first and the last fifth of each recording."""
    n = F.col("sample_count")
    two = F.array(F.struct(F.lit("lead_in").alias("label"), F.lit(0).cast("bigint").alias("start_sample"), F.expr("sample_count div 5").alias("end_sample")),
                  F.struct(F.lit("lead_out").alias("label"), F.expr("sample_count - sample_count div 5").alias("start_sample"), n.alias("end_sample")))
    return extent(spark, d).select("capture_id", F.inline(two))


def scopes(spark, d):
    return extent(spark, d).select("capture_id", F.lit(0).cast("bigint").alias("scope_start"), F.col("sample_count").alias("scope_end"))


def flat_text(df):
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct")) else F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def windows(spark, d, b, size=WIN):
    return sx.cut_windows(b, noise.evidence_windows(references(spark, d), scopes(spark, d), size), BLOCK, ["region", "role"])


@query("i4_line_excess")
def i4(spark, d):
    b = blocks(spark, d)
    return flat_text(sx.measured(windows(spark, d, b, HUM_WIN), sx.hum_features(HUM_RATE), sx.HUM_SCHEMA))


@query("i5_low_band_windows")
def i5(spark, d):
    return flat_text(sx.measured(windows(spark, d, blocks(spark, d)), sx.rumble_features(RATE), sx.RUMBLE_SCHEMA))


@query("i6_high_band_windows")
def i6(spark, d):
    return flat_text(sx.measured(windows(spark, d, blocks(spark, d)), sx.hiss_features(RATE, 150.0, 450.0), sx.HISS_SCHEMA))


@query("e10_hum_evidence")
def e10(spark, d):
    return flat_text(noise.noise_evidence(blocks(spark, d), references(spark, d), scopes(spark, d), HUM_RATE, HUM_WIN, BLOCK)["hum_evidence"])


@query("e11_rumble_evidence")
def e11(spark, d):
    return flat_text(noise.noise_evidence(blocks(spark, d), references(spark, d), scopes(spark, d), HUM_RATE, HUM_WIN, BLOCK)["rumble_evidence"])


@query("e12_hiss_evidence")
def e12(spark, d):
    return flat_text(noise.hiss_evidence(blocks(spark, d), references(spark, d), RATE, WIN // 2, BLOCK, lower=150.0, upper=450.0)["evidence"])


@query("j3_noise_evidence")
def j3(spark, d):
    out = noise.noise_evidence(blocks(spark, d), references(spark, d), scopes(spark, d), HUM_RATE, HUM_WIN, BLOCK)
    both = out["hum"].select("capture_id", F.lit("hum").alias("family"), "status", "confidence", "reason")
    return both.unionByName(out["rumble"].select("capture_id", F.lit("rumble").alias("family"), "status", "confidence", "reason"))


@query("j4_hiss_evidence")
def j4(spark, d):
    return noise.hiss_evidence(blocks(spark, d), references(spark, d), RATE, WIN // 2, BLOCK, lower=150.0, upper=450.0)["decision"]


CRACK = SPIKES + """,
rf as (select capture_id, 0 as a, sample_count // 5 as b from len union all select capture_id, sample_count - sample_count // 5, sample_count from len),
cr as (select s.*, length(channels) // 2 + 1 as nch from spc s),
ck as (select l.capture_id, l.sample_count, count(c.start_ix) as events, coalesce(sum(nch), 0)::bigint as repaired, count(*) filter (exists (select 1 from rf where rf.capture_id = c.capture_id and c.peak_ix >= a and c.peak_ix < b)) as reference_events,
   median(confidence) as med from len l left join cr c on c.capture_id = l.capture_id and c.start_ix >= 1 and c.end_ix < l.sample_count group by 1, 2)"""


def spiky(spark, d):
    from .events import spikes

    return imp.suppress_near_clips(spikes(spark, d), imp.merge_channels(imp.clipped_runs(sig_values(spark, d), ["capture_id", "channel"])))


@query("e13_crackle_metrics", "with" + CRACK + """ select capture_id, events, repaired, reference_events, round(med, 8) as median_confidence, round(events / (sample_count / 1000.0::double), 8) as events_per_second,
   round(repaired / (sample_count * 2.0::double), 8) as repaired_share, concat_ws(',', case when events < 4 then 'insufficient_conservative_crackle_events' end,
   case when reference_events < 2 then 'insufficient_noise_reference_crackle_evidence' end, case when events / (sample_count / 1000.0) > 80 then 'crackle_density_exceeds_conservative_limit' end,
   case when repaired / (sample_count * 2.0) > 0.005 then 'proposed_repair_fraction_exceeds_conservative_limit' end) as reasons from ck""")
def e13(spark, d):
    ref = references(spark, d).select("capture_id", F.col("start_sample").alias("start_ix"), F.col("end_sample").alias("end_ix"))
    sc = scopes(spark, d).withColumn("channel_count", F.lit(2))
    out = nz.crackle_metrics(stage(spiky(spark, d)), ref, sc, RATE)
    return out.select("capture_id", "events", "repaired", "reference_events", F.array_join("reasons", ",").alias("reasons"),
                      *[F.round(c, 8).alias(c) for c in ("median_confidence", "events_per_second", "repaired_share")])


@query("j5_crackle_evidence")
def j5(spark, d):
    return flat_text(noise.crackle_evidence(blocks(spark, d), references(spark, d), scopes(spark, d), RATE))


def features(spark, d, size=25):
    """Windows of 25 samples; a recording's windows are numbered from 0."""
    n = extent(spark, d)
    w = n.select("capture_id", "sample_count", F.explode(F.expr(f"sequence(0l, (sample_count - 1) div {size})")).alias("win_ix"))
    w = w.select("capture_id", "win_ix", (F.col("win_ix") * size).alias("start_ix"), F.least("sample_count", (F.col("win_ix") + 1) * size).alias("end_ix"))
    side = sx.all_channels(sx.cut_windows(blocks(spark, d), w, BLOCK, ["win_ix"]), ["win_ix"])
    f = stage(sx.measured(side, sx.endpoint_features(100, 32), sx.ENDPOINT_SCHEMA, "channels"))
    out = sx.with_flux(f, ["capture_id"])
    return out.drop("spectrum").withColumnsRenamed({"capture_id": "scope_id", "start_ix": "start_sample", "end_ix": "end_sample"})


@query("i2_window_features")
def i2(spark, d):
    return flat_text(features(spark, d))


@query("j2_propose_endpoints")
def j2(spark, d):
    return flat_text(endpoints.propose_endpoints(features(spark, d), 100))


FEAT = SIG + """,
ff as (select capture_id as scope_id, sample_ix // 25 as win_ix, min(sample_ix) as start_sample, max(sample_ix) + 1 as end_sample, sqrt(avg(amp * amp)) as rms, max(abs(amp)) as pk from sig group by 1, 2)"""


@query("e29_feature_hashes", "with" + FEAT + " select scope_id, " + digest_sql("sha256(win_ix || chr(10) || start_sample || ',' || end_sample || ',' || cast(round_even(rms * 1000000, 0) as bigint) || ',' || cast(round_even(pk * 1000000, 0) as bigint))") + " as digest from ff group by 1")
def e29(spark, d):
    from ..functions.hashing import ordered_hash

    s = sig(spark, d).groupBy(F.col("capture_id").alias("scope_id"), F.expr("sample_ix div 25").alias("win_ix")).agg(
        F.min("sample_ix").alias("a"), (F.max("sample_ix") + 1).alias("b"), F.sqrt(F.avg(F.col("amp") * F.col("amp"))).alias("rms"), F.max(F.abs("amp")).alias("pk"))
    whole = lambda c: F.bround(F.col(c) * 1000000).cast("bigint").cast("string")
    return ordered_hash(s, ["scope_id"], "win_ix", F.concat_ws(",", "a", "b", whole("rms"), whole("pk")), "digest")


ACT = FEAT + """,
fl as (select scope_id, max(rms) filter (i = cast(floor((n - 1) * 0.05::double) as bigint)) as lo from (select *, row_number() over (partition by scope_id order by rms) - 1 as i, count(*) over (partition by scope_id) as n from ff) group by 1),
ac as (select f.*, start_sample - lag(end_sample) over (partition by f.scope_id order by win_ix) as gap from ff f join fl using (scope_id) where rms > lo * 4),
ag as (select *, sum(case when gap is null or gap > 25 then 1 else 0 end) over (partition by scope_id order by win_ix) as g from ac),
ar as (select scope_id, min(start_sample) as s, max(end_sample) as e from ag group by scope_id, g)"""


def active_runs(spark, d):
    from ..operators.ordered import coalesce_runs
    from ..operators.quantiles import exact_quantiles

    s = sig(spark, d).groupBy(F.col("capture_id").alias("scope_id"), F.expr("sample_ix div 25").alias("win_ix")).agg(
        F.min("sample_ix").alias("start_sample"), (F.max("sample_ix") + 1).alias("end_sample"), F.sqrt(F.avg(F.col("amp") * F.col("amp"))).alias("rms"))
    s = stage(s)
    lo = exact_quantiles(s, ["scope_id"], "rms", {"lo": 0.05}, method="lower")
    hot = s.join(lo, "scope_id").where("rms > lo * 4").select("scope_id", "start_sample", "end_sample")
    return coalesce_runs(hot, ["scope_id"], "start_sample", "end_sample", 25)


@query("f9_extended_extent", "with" + ACT + """, x as (select scope_id, 300 as s0, 500 as e0 from fl)
  select x.scope_id, least(300, coalesce(min(s) filter (s < s0 and e >= s0), 300)) as start_sample, greatest(500, coalesce(max(e) filter (s <= e0 and e > e0), 500)) as end_sample from x left join ar using (scope_id) group by 1""")
def f9(spark, d):
    r = active_runs(spark, d)
    base = extent(spark, d).select(F.col("capture_id").alias("scope_id"))
    g = r.groupBy("scope_id").agg(
        F.min(F.expr("case when start_sample < 300 and end_sample >= 300 then start_sample end")).alias("a"),
        F.max(F.expr("case when start_sample <= 500 and end_sample > 500 then end_sample end")).alias("b"))
    return base.join(g, "scope_id", "left").select("scope_id", F.coalesce("a", F.lit(300).cast("bigint")).alias("start_sample"), F.coalesce("b", F.lit(500).cast("bigint")).alias("end_sample"))


@query("f10_quiet_context", "with" + ACT + " select scope_id, 400 - max(least(e, 400)) as before, min(greatest(s, 400)) - 400 as after from ar where s < 400 or e > 400 group by 1 having count(*) filter (s < 400) > 0 and count(*) filter (e > 400) > 0".replace("max(least(e, 400))", "max(least(e, 400)) filter (s < 400)").replace("min(greatest(s, 400))", "min(greatest(s, 400)) filter (e > 400)"))
def f10(spark, d):
    g = active_runs(spark, d).groupBy("scope_id").agg(
        (400 - F.max(F.expr("case when start_sample < 400 then least(end_sample, 400) end"))).alias("before"),
        (F.min(F.expr("case when end_sample > 400 then greatest(start_sample, 400) end")) - 400).alias("after"))
    return g.where("before is not null and after is not null")


@query("f11_strongest_apart", "with recursive" + SIG + """,
  dv as (select capture_id, sample_ix, abs(amp - coalesce(lag(amp) over (partition by capture_id order by sample_ix), amp)) as s from sig),
  od as (select capture_id, sample_ix, s, sample_ix // 500 as w, row_number() over (partition by capture_id, sample_ix // 500 order by s desc, sample_ix) as rn from dv where s > 0.02),
  fo as (select capture_id, w, rn, [sample_ix] as kept from od where rn = 1 union all
    select f.capture_id, f.w, o.rn, case when list_bool_or(list_transform(f.kept, lambda k: abs(k - o.sample_ix) <= 15)) then f.kept else list_append(f.kept, o.sample_ix) end
    from fo f join od o on o.capture_id = f.capture_id and o.w = f.w and o.rn = f.rn + 1),
  ls as (select capture_id, w, arg_max(kept, rn) as kept from fo group by 1, 2), un as (select capture_id, w, unnest(kept[1:12]) as sample_ix, greatest(len(kept) - 12, 0)::integer as left_out from ls)
  select u.capture_id, u.w as win_ix, u.sample_ix, round(s, 9) as strength, left_out from un u join dv using (capture_id, sample_ix)""")
def f11(spark, d):
    near = imp.derivatives(sig(spark, d), ["capture_id"]).withColumn("strength", F.abs("derivative"))
    out = points.strongest_apart(near.where("strength > 0.02"), "capture_id", "sample_ix", "strength", 15, 500, 12)
    return out.withColumn("strength", F.round("strength", 9))


@query("f12_refractory_count", "with recursive" + SIG + """,
  h as (select capture_id, sample_ix, sample_ix // 250 as w, row_number() over (partition by capture_id, sample_ix // 250 order by sample_ix) as rn from sig where amp > 0.1),
  f as (select capture_id, w, rn, sample_ix as last, 1::bigint as n from h where rn = 1 union all
    select h.capture_id, h.w, h.rn, case when h.sample_ix - f.last > 15 then h.sample_ix else f.last end, f.n + (h.sample_ix - f.last > 15)::int from f join h on h.capture_id = f.capture_id and h.w = f.w and h.rn = f.rn + 1)
  select capture_id, w as win_ix, max(n) as impulses from f group by 1, 2""")
def f12(spark, d):
    hits = sig(spark, d).where("amp > 0.1").select("capture_id", "sample_ix")
    return points.refractory_counts(hits, "capture_id", "sample_ix", 15, 250)


@query("f20_collapsed_points", "with recursive" + SIG + """,
  al as (select capture_id, sample_ix * 0.01::double as c, round(amp, 6) as s from sig where amp > 0.15), od as (select *, row_number() over (partition by capture_id order by c) as rn from al),
  fo as (select capture_id, rn, c, s, 1 as g from od where rn = 1 union all select f.capture_id, o.rn, case when o.c - f.c < 0.045 and o.s <= f.s then f.c else o.c end, case when o.c - f.c < 0.045 then greatest(o.s, f.s) else o.s end, case when o.c - f.c < 0.045 then f.g else f.g + 1 end
    from fo f join od o on o.capture_id = f.capture_id and o.rn = f.rn + 1)
  select capture_id, round(arg_max(c, rn), 6) as cut_seconds, arg_max(s, rn) as score from fo group by capture_id, g""")
def f20(spark, d):
    p = sig(spark, d).where("amp > 0.15").select("capture_id", (F.col("sample_ix") * 0.01).alias("cut_seconds"), F.round("amp", 6).alias("score"))
    return points.collapse_points(p, 0.045).withColumn("cut_seconds", F.round("cut_seconds", 6))


@query("d15_proximity_join", "with" + SIG + """, f as (select capture_id, sample_ix as focus from sig where sample_ix % 300 = 150)
  select f.capture_id, focus, count(s.sample_ix) as near, max(abs(s.sample_ix - focus)) as farthest from f join sig s on s.capture_id = f.capture_id and s.amp > 0.1 and abs(s.sample_ix - focus) <= 30 group by 1, 2""")
def d15(spark, d):
    from ..operators.intervals import points_in

    s = stage(sig(spark, d).select("capture_id", "sample_ix", "amp"))
    f = s.where("sample_ix % 300 = 150").select("capture_id", F.col("sample_ix").alias("focus"), (F.col("sample_ix") - 30).alias("start_ix"), (F.col("sample_ix") + 31).alias("end_ix"))
    j = points_in(s.where("amp > 0.1"), f, ["capture_id"], "sample_ix", bucket=256)
    return j.groupBy("capture_id", "focus").agg(F.count(F.lit(1)).alias("near"), F.max(F.abs(F.col("sample_ix") - F.col("focus"))).alias("farthest"))


EMB = """e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query("i7_cosine_similarity", "with " + EMB + ", p as (select a.vec_id, a.v as x, b.v as y from e a join e b on b.vec_id = a.vec_id - 1) select vec_id, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 8) as cosine from p")
def i7(spark, d):
    v = vectors(spark, d)
    j = v.join(v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return j.select("vec_id", F.round(sx.cosine(F.col("v"), F.col("w")), 8).alias("cosine"))


@query("i8_profile_reduction", "with " + EMB + """, q as (select vec_id, list_transform(v, lambda x: x * x) as p from e), m as (select vec_id, [list_avg(p[1:13]), list_avg(p[14:26]), list_avg(p[27:39]), list_avg(p[40:52]), list_avg(p[53:64])] as m from q)
  select vec_id, unnest([0, 1, 2, 3, 4]) as part, round(unnest(m) / list_sum(m), 8) as share from m""")
def i8(spark, d):
    p = vectors(spark, d).select("vec_id", F.transform("v", lambda x: x * x).alias("p"))
    return p.select("vec_id", F.posexplode(sx.reduced_profile(F.col("p"), 64, 5)).alias("part", "share")).select("vec_id", "part", F.round("share", 8).alias("share"))


@query("f13_spectral_flux", "with " + EMB + """, n as (select vec_id, list_transform(v, lambda x: x * x) as p from e), z as (select vec_id, list_transform(p, lambda x: x / list_sum(p)) as p from n), w as (select vec_id, vec_id // 100 as s, p, lag(p) over (partition by vec_id // 100 order by vec_id) as q from z)
  select vec_id, round(case when q is null then 0 else list_sum(list_transform(list_zip(p, q), lambda x: greatest(x[1] - x[2], 0))) end, 8) as flux from w""")
def f13(spark, d):
    p = vectors(spark, d).select("vec_id", F.expr("vec_id div 100").alias("scope"), F.transform("v", lambda x: x * x).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    p = p.withColumn("spectrum", F.transform("p", lambda x: x / total))
    return sx.with_flux(p, ["scope"], "vec_id").select("vec_id", F.round("flux", 8).alias("flux"))


def requests(spark, d):
    n = extent(spark, d)
    r = n.select("capture_id", "sample_count", F.explode(F.expr("sequence(0l, (sample_count - 1) div 600)")).alias("k"))
    return r.select("capture_id", F.concat_ws("-", "capture_id", "k").alias("request_id"), (F.col("k") * 600).alias("start_ix"), F.least("sample_count", F.col("k") * 600 + 600).alias("end_ix"))


def evidence_of(spark, d):
    return evidence.evidence_windows(blocks(spark, d), requests(spark, d), RATE, BLOCK, bands=24)


@query("i1_spectrogram")
def i1(spark, d):
    return flat_text(evidence_of(spark, d)["spectrogram"])


@query("i3_focus_metrics")
def i3(spark, d):
    return flat_text(evidence_of(spark, d)["focus"].drop("transients"))


@query("i16_transient_morphology")
def i16(spark, d):
    # Cubed amplitudes give isolated steps well above their surroundings.
    s = sig(spark, d).withColumn("channel", F.lit(0)).withColumn("amp", F.pow(F.abs("amp"), 3.0) * 4.0)
    f = evidence.evidence_windows(stage(to_blocks(s, BLOCK)), requests(spark, d), RATE, BLOCK)["focus"]
    return f.select("request_id", F.explode("transients").alias("t")).select("request_id", "t.*")


@query("j17_evidence_window", "with" + SIG + """, r as (select *, sample_ix // 600 as k, count(*) over (partition by capture_id) as n from sig), q as (select capture_id || '-' || k as request_id, sample_ix % 600 as i, amp, least(600, n - k * 600) as m from r),
  g as (select request_id, amp, i, m, ((i + 1) * 240 - 1) // m as g, m / 240.0::double as st from q),
  b as (select request_id, amp, case when m <= 240 then i when i < floor(g * st) then g - 1 when i >= case when g + 1 >= 240 then m else floor((g + 1) * st) end then g + 1 else g end as bucket from g)
  select request_id, 0 as channel, cast(bucket as bigint) as bucket, round(min(amp), 9) as lo, round(max(amp), 9) as hi, round(sqrt(avg(amp * amp)), 9) as rms from b group by all""")
def j17(spark, d):
    return evidence_of(spark, d)["waveform"].select("request_id", "channel", "bucket", *[F.round(c, 9).alias(c) for c in ("lo", "hi", "rms")])


def hum_preview(spark, d):
    s = sig(spark, d).withColumn("channel", F.lit(0)).select("capture_id", "channel", "sample_ix", "amp")
    return noise.preview_hum(s, blocks(spark, d), references(spark, d), scopes(spark, d), [50.0, 100.0], RATE, WIN, BLOCK, 20)


@query("i9_sinusoid_fit")
def i9(spark, d):
    return flat_text(hum_preview(spark, d)["lines"])


@query("i10_hum_removal", "with" + SIG + """, l as (select capture_id, count(*) as n from sig group by 1),
  r as (select capture_id, sample_ix, amp, (0.01 * cos(2 * pi() * 50 * sample_ix / 1000.0::double) + 0.02 * sin(2 * pi() * 50 * sample_ix / 1000.0::double)) * case when least(sample_ix, n - 1 - sample_ix) < 20 then 0.5 - 0.5 * cos(pi() * least(sample_ix, n - 1 - sample_ix) / 20) else 1 end as gone from sig join l using (capture_id))
  select capture_id, sample_ix, round(amp - gone, 8) as amp from r""")
def i10(spark, d):
    line = F.array(F.struct(F.lit(50.0).alias("hz"), F.lit(0.01).alias("c"), F.lit(0.02).alias("s")))
    lines = extent(spark, d).select("capture_id", F.lit(0).alias("channel"), line.alias("lines"))
    laid = overlaid.remove_lines(blocks(spark, d), lines, scopes(spark, d), RATE, 20)
    return overlaid.sample_rows(laid).select("capture_id", "sample_ix", F.round("amp", 8).alias("amp"))


HALF = SIG + """, h as (select capture_id, sample_ix, amp as original, amp * case when capture_id < 'f' then 0.9 else 0.8 end as amp from sig)"""


def halved(spark, d):
    s = sig(spark, d)
    return s.select("capture_id", F.lit(0).alias("channel"), "sample_ix", F.col("amp").alias("original"), (F.col("amp") * F.when(F.col("capture_id") < "f", 0.9).otherwise(0.8)).alias("amp"))


@query("e32_loudness_match", "with" + HALF + """, w as (select capture_id, sample_ix // 50 as k, count(*) as n, 20 * log10(sqrt(avg(original * original))) as a, 20 * log10(sqrt(avg(amp * amp))) as b from h group by 1, 2), r as (select capture_id, a - b as r from w where n = 50 and a >= -55 and b >= -55),
  m as (select capture_id, median(r) as g, count(*) as windows from r group by 1) select capture_id, any_value(windows) as windows, round(any_value(g), 6) as gain_db, round(median(abs(r - g)), 6) as mad_db, round(pow(10, any_value(g) / 20), 6) as linear_gain, '' as reasons from r join m using (capture_id) group by 1""")
def e32(spark, d):
    out = nz.loudness_match(halved(spark, d), 50)
    return out.select("capture_id", "windows", F.round("gain_db", 6).alias("gain_db"), F.abs(F.round("mad_db", 6)).alias("mad_db"), F.round("linear_gain", 6).alias("linear_gain"), F.array_join("reasons", ",").alias("reasons"))


@query("e33_removal_metrics", "with" + HALF + " select capture_id, 0 as channel, round(20 * log10(sqrt(avg((original - amp) * (original - amp)))), 6) as removed_db, round(max(abs(original - amp)), 8) as removed_peak, round(sum((original - amp) * (original - amp)) / sum(original * original), 8) as energy_ratio from h group by 1")
def e33(spark, d):
    out = nz.removal_metrics(halved(spark, d))
    return out.select("capture_id", "channel", F.round("removed_db", 6).alias("removed_db"), F.round("removed_peak", 8).alias("removed_peak"), F.round("energy_ratio", 8).alias("energy_ratio"))


@query("i11_zero_phase_highpass")
def i11(spark, d):
    # A scope is at most 90 seconds; longer recordings are taken scope by scope.
    w = extent(spark, d).select("capture_id", F.explode(F.expr("sequence(0l, (sample_count - 1) div 60000)")).alias("k"), "sample_count")
    s = w.select("capture_id", (F.col("k") * 60000).alias("scope_start"), F.least("sample_count", (F.col("k") + 1) * 60000).alias("scope_end"))
    out = noise.preview_rumble(blocks(spark, d), s, RATE, BLOCK, pad_seconds=0.05, fade=20)
    return out.select("capture_id", "channel", "start_ix", F.size("filtered").alias("n"), F.round(F.array_max("filtered"), 6).alias("highest"))


def framed(name, of, hop):
    """Root-Hann frames of 128 samples at every `hop` of the ranges `of` (capture_id, a, b), the last ending with its
    range, and their spectrum: re + i im per bin k."""
    return f"""
{name}_s as (select capture_id, unnest(range(a, b - 128 + 1, {hop})) as f from {of} union select capture_id, b - 128 from {of} where b - a >= 128),
{name}_w as (select t.capture_id, f, sample_ix - f as i, amp, sqrt(0.5 - 0.5 * cos(2 * pi() * (sample_ix - f) / 127.0::double)) as w
  from {name}_s t join sig s on s.capture_id = t.capture_id and sample_ix >= f and sample_ix < f + 128),
{name}_f as (select capture_id, f, k, sum(amp * w * cos(2 * pi() * k * i / 128.0::double)) as re, -sum(amp * w * sin(2 * pi() * k * i / 128.0::double)) as im
  from {name}_w, (select unnest(range(0, 65)) as k) group by all)"""


def psd_sql(hop):
    return SIG + """,
nn as (select event_type as capture_id, count(*) as n from events group by 1),
rf as (select capture_id, 0 as a, n // 5 as b from nn union all select capture_id, n - n // 5, n from nn),""" + framed("r", "rf", hop) + """,
psd as (select capture_id, k, median(re * re + im * im) as q from r_f group by 1, 2)"""


# Inverse of a real spectrum of 128: the ends of it count once, the bins between twice.
BACK = "sum({x} * case when k in (0, 64) then 1 else 2 end * (re * cos(2 * pi() * k * i / 128.0::double) - im * sin(2 * pi() * k * i / 128.0::double))) / 128"


@query("i12_spectral_subtraction", "with" + psd_sql(32) + """,
sp as (select capture_id, 0 as a, n as b from nn),""" + framed("g", "sp", 32) + """,
bd as (select g.*, re * re + im * im as p, q, k * 1000 / 128.0 between 100 and 450 as band from g_f g join psd using (capture_id, k)),
st as (select capture_id, f, exp(avg(ln(greatest(p, 2.220446049250313e-16))) filter (band)) / avg(p) filter (band) as flat, max(p) filter (band) / sum(p) filter (band) as conc from bd group by 1, 2),
cr as (select capture_id, f, max(abs(y)) / sqrt(avg(y * y)) as crest from (
  select capture_id, f, i, """ + BACK.format(x="case when band then 1 else 0 end") + """ as y from bd, (select unnest(range(0, 128)) as i) group by 1, 2, 3) group by 1, 2),
ok as (select capture_id, f from st join cr using (capture_id, f) where flat >= 0.35 * 0.75 and conc <= 0.08 and crest <= 8.75),
gn as (select bd.*, case when band then 1 - greatest(sqrt(greatest(1 - 0.2::double * q / greatest(p, 2.220446049250313e-16), 0)), pow(10, -1.5::double / 20)) else 0 end as less from bd semi join ok using (capture_id, f)),
rm as (select capture_id, f, i, """ + BACK.format(x="less") + """ as v from gn, (select unnest(range(0, 128)) as i) group by 1, 2, 3),
ad as (select g.capture_id, g.f + g.i as sample_ix, sum(coalesce(v, 0) * w) as v, sum(w * w) as w from g_w g left join rm using (capture_id, f, i) group by 1, 2)
select capture_id, 0 as channel, sample_ix, round(v / greatest(w, 2.220446049250313e-16)
  * case when least(sample_ix, n - 1 - sample_ix) < 100 then 0.5 - 0.5 * cos(pi() * least(sample_ix, n - 1 - sample_ix) / 99) else 1 end, 9) as removed from ad join nn using (capture_id)""")
def i12(spark, d):
    out = noise.preview_hiss(blocks(spark, d), references(spark, d), scopes(spark, d), RATE, BLOCK, 100.0, 450.0, 128, 32)
    return out.select("capture_id", "channel", "sample_ix", F.round("removed", 9).alias("removed"))


@query("e30_reference_psd", "with" + psd_sql(128) + " select capture_id, 0 as channel, k::integer as bin, round(q, 8) as power from psd")
def e30(spark, d):
    t = tiles(references(spark, d), 128, 128, True).select("capture_id", F.col("tile_start").alias("start_ix"), F.col("tile_end").alias("end_ix"))
    psd = nz.reference_psd(sx.cut_windows(blocks(spark, d), t, BLOCK, []))
    return psd.select("capture_id", "channel", F.posexplode("psd").alias("bin", "power")).withColumn("power", F.round("power", 8))


BANDS = SIG + """,
nn as (select event_type as capture_id, count(*) as n from events group by 1),
rg as (select capture_id, 'lead_in' as region, 0 as a, n // 5 as b from nn union all select capture_id, 'program', n // 5, n - n // 5 from nn union all select capture_id, 'lead_out', n - n // 5, n from nn),
wn as (select capture_id, region, unnest(range(a, b - 250 + 1, 250)) as start_ix from rg union select capture_id, region, b - 250 from rg where b - a >= 250),
sp as (select w.capture_id, region, start_ix, sample_ix - start_ix as i, amp * (0.5 - 0.5 * cos(2 * pi() * (sample_ix - start_ix) / 249.0::double)) as x from wn w join sig s on s.capture_id = w.capture_id and sample_ix >= start_ix and sample_ix < start_ix + 250),
ft as (select capture_id, region, start_ix, k, pow(sum(x * cos(2 * pi() * k * i / 250.0::double)), 2) + pow(sum(x * sin(2 * pi() * k * i / 250.0::double)), 2) as p from sp, (select unnest(range(2, 41)) as k) group by all)"""


@query("i19_band_power", "with" + BANDS + """ select capture_id, region, start_ix, round(sum(p) filter (k * 4 between 5 and 30), 6) as low, round(sum(p) filter (k * 4 between 40 and 160), 6) as bass from ft group by all""")
def i19(spark, d):
    out = nz.band_powers(windows(spark, d, blocks(spark, d)), RATE, {"low": (5.0, 30.0), "bass": (40.0, 160.0)})
    return out.select("capture_id", "region", "start_ix", F.round("low", 6).alias("low"), F.round("bass", 6).alias("bass"))


@query("i18_crackle_repair")
def i18(spark, d):
    b = blocks(spark, d)
    e = stage(imp.merge_channels(imp.impulse_events(b).where("end_ix - start_ix <= 8")))
    ok = extent(spark, d).select("capture_id", F.lit("proposed").alias("status"))
    out = noise.preview_crackle(b, ok, e.where(F.substring("capture_id", 1, 1) != "s"), BLOCK)["render"]
    return flat_text(out)


@query("j12_noise_preview")
def j12(spark, d):
    return flat_text(hum_preview(spark, d)["metrics"])


def loud_blocks(spark, d):
    return stage(to_blocks(sig_values(spark, d), BLOCK))


def music(n):
    return n.select("capture_id", F.lit(0).cast("bigint").alias("music_start"), F.col("sample_count").alias("music_end"))


@query("j10_scan_events")
def j10(spark, d):
    n = lengths(spark, d)
    out = events.scan_events(loud_blocks(spark, d), n, music(n))
    bad = out["invalid"].groupBy("capture_id").agg(F.count(F.lit(1)).alias("invalid"))
    ledger = out["ledger"].select("capture_id", "music_frames", "scanned_frames", "status")
    return out["summary"].join(ledger, "capture_id").join(bad, "capture_id", "left").fillna(0, ["invalid"])


@query("j11_repair_events")
def j11(spark, d):
    b = blocks(spark, d)
    kept = events.scan_events(b, lengths(spark, d), music(lengths(spark, d)))["records"]
    dec = kept.select("capture_id", "event_id", F.when(F.col("repairable") & (F.col("kind") == "impulse"), "approved").otherwise("rejected").alias("decision"), F.lit(None).cast("string").alias("protected_class"))
    out = events.repair_events(b, kept, dec, BLOCK)
    n = out["patches"].groupBy("capture_id").agg(F.count(F.lit(1)).alias("patches"), F.sum(F.size("patch")).alias("samples"))
    stray = out["outside"].groupBy("capture_id").agg(F.count(F.lit(1)).alias("outside"))
    return n.join(stray, "capture_id", "left").fillna(0, ["outside"])


@query("j9_evaluate_corpus", "with" + METRICS + """ select category, eligible, ineligible, source_count, round(mean_loss, 8) as mean_loss from m""")
def j9(spark, d):
    m = evidence.evaluate_corpus(records(spark, d), CORPUS_CFG, "cfg0", "cfg1")["metrics"]
    return m.select("category", "eligible", "ineligible", "source_count", F.round("mean_loss", 8).alias("mean_loss"))
