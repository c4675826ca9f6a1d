"""Level, timing and quantization expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST_NORMAL = 2.2250738585072014e-308


def rms_db(mean_square: Column, floor: float = 1e-9) -> Column:
    """dBFS of a mean square; a missing mean (no samples) reads -180 dB."""
    level = F.lit(20.0) * F.log10(F.greatest(F.sqrt(mean_square), F.lit(floor)))
    return F.when(mean_square.isNull(), F.lit(-180.0)).otherwise(level)


def rms_db_noise(mean_square: Column) -> Column:
    """Noise variant: floored at the smallest normal double, never below -400 dB."""
    level = F.lit(20.0) * F.log10(F.greatest(F.sqrt(mean_square), F.lit(SMALLEST_NORMAL)))
    return F.greatest(F.lit(-400.0), F.when(mean_square.isNull(), F.lit(-400.0)).otherwise(level))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))


def seconds_to_sample(seconds: Column, rate: Column) -> Column:
    """Nearest sample, halves to even; null when the time is not finite or negative."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < F.lit(1e12))
    return F.when(ok, F.bround(seconds * rate).cast("bigint"))


def normalized_level(db: Column) -> Column:
    return F.round(clip((db + 72.0) / 66.0, 0.0, 1.0), 5)


def speed_factor(capture_rpm: Column, intended_rpm: Column, fine: Column) -> Column:
    """capture / intended * fine from text metadata; null unless all three parse and are positive."""
    c, i, f = (F.expr("cast(null as double)") if x is None else x for x in (capture_rpm, intended_rpm, fine))
    return F.when((c > 0) & (i > 0) & (f > 0), c / i * f)


def corrected_rate(rate: Column, factor: Column) -> Column:
    return F.floor(rate / factor + 0.5).cast("bigint")


def corrected_sample(sample: Column, rate: Column, new_rate: Column) -> Column:
    """(2*s*rate + r') div (2*r') in decimals, since the product can pass 64 bits."""
    wide = F.lit(2).cast("decimal(1,0)") * sample.cast("decimal(18,0)") * rate.cast("decimal(10,0)")
    top = wide + new_rate.cast("decimal(10,0)")
    return F.floor(top / (F.lit(2).cast("decimal(1,0)") * new_rate.cast("decimal(10,0)"))).cast("bigint")


def excerpt_bounds(start: Column, end: Column, rate: Column) -> tuple[Column, Column]:
    """Fingerprint excerpt: skip up to 8 s of a track longer than 15 s, take at most 120 s."""
    total = (end - start) / rate
    skip = F.least(F.lit(8.0), F.greatest(F.lit(0.0), total - 15.0))
    first = start + F.floor(skip * rate).cast("bigint")
    return first, F.least(end, first + F.floor(F.lit(120.0) * rate).cast("bigint"))


def highpass_gain(freq: Column, cutoff: float, order: int) -> Column:
    ratio = F.pow(freq / F.lit(float(cutoff)), F.lit(2.0 * order))
    return ratio / (F.lit(1.0) + ratio)


def highpass_db(freq: Column, cutoff: float, order: int) -> Column:
    g = highpass_gain(freq, cutoff, order)
    return F.when(g > 0, F.greatest(F.lit(-400.0), F.lit(20.0) * F.log10(g))).otherwise(F.lit(-400.0))


def quantize_24(x: Column) -> Column:
    """Round a left-justified 32-bit value to 24 bits, halves away from zero, keeping the low byte clear."""
    mag = F.floor((F.abs(x) + 128) / 256) * 256
    return F.least(F.lit(2147483392), F.greatest(F.lit(-2147483648), F.signum(x) * mag)).cast("bigint")


def edge_fade(position: Column, length: Column, fade: Column) -> Column:
    """Raised-cosine weight of a position: rises over `fade` samples, falls over the last `fade`."""
    edge = F.least(position, length - 1 - position)
    rise = F.lit(0.5) - F.lit(0.5) * F.cos(F.pi() * edge / F.greatest(fade - 1, F.lit(1)))
    return F.when((fade > 1) & (edge < fade), rise).otherwise(F.lit(1.0))


def cue_time(sample: Column, rate: Column) -> Column:
    """MM:SS:FF at 75 frames a second, nearest frame."""
    frames = F.floor((sample * 75 + F.floor(rate / 2)) / rate).cast("bigint")
    two = lambda c: F.when(c < 100, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    minutes = F.floor(frames / 4500).cast("bigint")
    seconds = F.floor((frames % 4500) / 75).cast("bigint")
    return F.concat_ws(":", two(minutes), two(seconds), two(frames % 75))
