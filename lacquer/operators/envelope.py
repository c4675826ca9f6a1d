"""Energy envelope, smoothing, thresholds and display summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK, SegmentSettings
from ..functions.levels import clip, normalized_level, rms_db
from .ordered import windowed
from .quantiles import exact_quantiles


def rms_envelope(samples: DataFrame, window: int) -> DataFrame:
    """(capture_id, sample_ix, amp) to one level per window; the last, partial window is kept."""
    power = F.avg(F.col("amp") * F.col("amp"))
    return (
        samples.groupBy("capture_id", F.expr(f"sample_ix div {int(window)}").alias("win_ix"))
        .agg(rms_db(power).alias("rms_db"))
    )


def rms_envelope_blocks(blocks: DataFrame, window: int) -> DataFrame:
    """The same from the block table: squares are summed per block before anything is shuffled."""
    piece = F.expr(
        f"""transform(sequence(start_sample div {window}, (start_sample + n - 1) div {window}), w -> struct(
              w as win_ix,
              slice(samples, int(greatest(w * {window} - start_sample, 0)) + 1,
                    int(least((w + 1) * {window}, start_sample + n)
                        - greatest(w * {window}, start_sample))) as xs))"""
    )
    parts = blocks.select("capture_id", F.explode(piece).alias("p")).select(
        "capture_id",
        F.col("p.win_ix").alias("win_ix"),
        F.aggregate("p.xs", F.lit(0.0), lambda a, x: a + x * x).alias("sq"),
        F.size("p.xs").alias("n"),
    )
    return parts.groupBy("capture_id", "win_ix").agg(rms_db(F.sum("sq") / F.sum("n")).alias("rms_db"))


def smooth(env: DataFrame, windows: int, chunk: int = CHUNK, value: str = "rms_db") -> DataFrame:
    """Centred moving mean with repeated end values; series shorter than the window stay as they are.

    The frame near an end is cut short by the series itself, so the number of missing neighbours and the
    end value can be read from the frame.
    """
    if windows <= 1:
        return env.withColumn("db", F.col(value))
    width = windows if windows % 2 else windows + 1
    k = width // 2
    reach = max(width, windows) - 1
    exprs = {
        "_sum": lambda w: F.sum(value).over(w.rowsBetween(-k, k)),
        "_left": lambda w: F.lit(k + 1) - F.count(value).over(w.rowsBetween(-k, 0)),
        "_right": lambda w: F.lit(k + 1) - F.count(value).over(w.rowsBetween(0, k)),
        "_first": lambda w: F.first(value).over(w.rowsBetween(-k, 0)),
        "_last": lambda w: F.last(value).over(w.rowsBetween(0, k)),
        "_near": lambda w: F.count(value).over(w.rowsBetween(-reach, reach)),
    }
    out = windowed(env, ["capture_id"], "win_ix", reach, reach, exprs, chunk)
    mean = (F.col("_sum") + F.col("_left") * F.col("_first") + F.col("_right") * F.col("_last")) / F.lit(width)
    out = out.withColumn("db", F.when(F.col("_near") < windows, F.col(value)).otherwise(mean))
    return out.drop(*exprs)


def thresholds(env: DataFrame, margin_db: float, value: str = "db") -> DataFrame:
    """Noise floor, silence and active thresholds per capture from the 3rd, 50th and 75th percentiles.

    Levels at or below -90 dB do not count unless fewer than max(20, n div 200) would remain.
    """
    least_kept = F.greatest(F.lit(20), F.expr("_n div 200"))
    q = exact_quantiles(
        env, ["capture_id"], value, {"noise_floor_db": 0.03, "_p50": 0.5, "_p75": 0.75},
        skip_at_most=-90.0, min_kept=least_kept, count_name="windows",
    )
    q = q.withColumn(
        "silence_db",
        clip(F.least(F.col("noise_floor_db") + margin_db, F.col("_p50") - 9.0), -68.0, -24.0),
    )
    active = F.greatest(F.least(F.col("silence_db") + 12.0, F.col("_p75") - 4.0), F.col("silence_db") + 4.0)
    return q.withColumn("active_db", clip(active, -58.0, -12.0)).drop("_p50", "_p75")


def waveform_buckets(df: DataFrame, counts: DataFrame, keys: list[str], ix: str, points: int) -> DataFrame:
    """Give each position its display bucket: edges are the truncated even division of the length.

    The bucket follows from the position by integer arithmetic, corrected by one where the floating-point
    edge is rounded the other way, so no list of edges is joined. A series of at most `points` values keeps
    one bucket per value.
    """
    sized = df.join(counts.select(*keys, F.col("n").alias("_n")), keys)
    sized = sized.withColumn("_g", F.expr(f"(({ix} + 1) * {points} - 1) div _n"))
    step = F.col("_n") / F.lit(float(points))
    low = F.floor(F.col("_g") * step)
    high = F.when(F.col("_g") + 1 >= points, F.col("_n")).otherwise(F.floor((F.col("_g") + 1) * step))
    split = F.when(F.col(ix) < low, F.col("_g") - 1).when(F.col(ix) >= high, F.col("_g") + 1).otherwise(F.col("_g"))
    bucket = F.when(F.col("_n") <= points, F.col(ix)).otherwise(split)
    return sized.withColumn("bucket", bucket.cast("bigint")).drop("_n", "_g")


def summarize_waveform(env: DataFrame, points: int, value: str = "db") -> DataFrame:
    counts = env.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))
    bucketed = waveform_buckets(env, counts, ["capture_id"], "win_ix", points)
    return bucketed.groupBy("capture_id", "bucket").agg(normalized_level(F.max(value)).alias("level"))


def minmax_buckets(samples: DataFrame, points: int, keys: list[str] = ["capture_id"]) -> DataFrame:
    """Minimum, maximum and RMS per display bucket, per channel when `keys` names one."""
    counts = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    bucketed = waveform_buckets(samples, counts, list(keys), "sample_ix", points)
    return bucketed.groupBy(*keys, "bucket").agg(
        F.min("amp").alias("lo"), F.max("amp").alias("hi"),
        F.sqrt(F.avg(F.col("amp") * F.col("amp"))).alias("rms"),
    )


def prepared(samples: DataFrame, cfg: SegmentSettings) -> tuple[DataFrame, DataFrame]:
    """Smoothed envelope and thresholds, the inputs of everything in gap detection."""
    env = smooth(rms_envelope(samples, cfg.window_samples), cfg.smoothing_windows, cfg.chunk)
    return env, thresholds(env, cfg.margin_db)
