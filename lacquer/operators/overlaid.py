"""Changes of whole blocks: patches, removed lines and subtracted noise, and what they did.

Samples never leave their block's array: a patch meets the blocks it touches, a line is evaluated on a block's own
positions, and overlapping frames are added up inside stretches that bring the samples beside them along. No row is a
sample and no shuffle is keyed by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spectral import TINY

LAID = ["capture_id", "channel", "block_ix", "start_sample", "n", "original", "samples"]


def _touched(start: Column, end: Column, block: int) -> Column:
    return F.explode(F.sequence(F.floor(start / block).cast("bigint"), F.floor((end - 1) / block).cast("bigint")))


def overlay_blocks(blocks: DataFrame, patch_rows: DataFrame, block: int) -> DataFrame:
    """The blocks with `original` and, in `samples`, the values of the patches (capture_id, channel, start_frame, patch)
    over them. Patches of a channel do not overlap; null ones change nothing; parts outside the blocks are ignored."""
    p = patch_rows.where("size(patch) > 0").select("capture_id", "channel", F.col("start_frame").alias("a"), "patch")
    p = p.withColumn("block_ix", _touched(F.col("a"), F.col("a") + F.size("patch"), block))
    first = F.greatest(F.col("a"), F.col("block_ix") * block)
    last = F.least(F.col("a") + F.size("patch"), (F.col("block_ix") + 1) * block)
    cut = F.slice("patch", (first - F.col("a") + 1).cast("int"), (last - first).cast("int"))
    parts = p.groupBy("capture_id", "channel", "block_ix").agg(F.array_sort(F.collect_list(F.struct(first.alias("at"), cut.alias("v")))).alias("_ps"))
    j = blocks.join(parts, ["capture_id", "channel", "block_ix"], "left")

    @F.pandas_udf("array<double>")
    def lay(samples: pd.Series, first: pd.Series, ps: pd.Series) -> pd.Series:
        out = []
        for x, s, pieces in zip(samples, first, ps):
            y = np.array(x, dtype=float)
            for q in pieces:
                at, v = q["at"] - s, np.asarray(q["v"], dtype=float)
                lo, hi = max(at, 0), min(at + v.size, y.size)
                if hi > lo:
                    y[lo:hi] = v[lo - at : hi - at]
            out.append(y)
        return pd.Series(out)

    ps = F.coalesce("_ps", F.array().cast("array<struct<at:bigint,v:array<double>>>"))
    new = F.when(F.col("_ps").isNull(), F.col("samples")).otherwise(lay("samples", "start_sample", ps))
    return j.select(*LAID[:5], F.col("samples").alias("original"), new.alias("samples"))


def sample_rows(laid: DataFrame) -> DataFrame:
    """(capture_id, channel, sample_ix, original, amp, removed) of laid blocks; blocks are taken apart where they lie."""
    flat = laid.select("capture_id", "channel", "start_sample", F.posexplode(F.arrays_zip("original", "samples")).alias("_i", "_x"))
    return flat.select("capture_id", "channel", (F.col("start_sample") + F.col("_i")).alias("sample_ix"), F.col("_x.original").alias("original"),
                       F.col("_x.samples").alias("amp"), (F.col("_x.original") - F.col("_x.samples")).alias("removed"))


def measured_blocks(laid: DataFrame, windows: DataFrame, block: int) -> DataFrame:
    """Per block: samples, covered (inside a window), changed, changed_outside (changed where no window is), stray (their
    positions), max_removed, reconstruction_error and the sums of squares of original, proposed and removed.

    windows: (capture_id, channel, start_ix, end_ix), which may overlap.
    """
    w = windows.select("capture_id", "channel", "start_ix", "end_ix").distinct().withColumn("block_ix", _touched(F.col("start_ix"), F.col("end_ix"), block))
    w = w.groupBy("capture_id", "channel", "block_ix").agg(F.collect_list(F.struct("start_ix", "end_ix")).alias("_ws"))
    j = laid.join(w, ["capture_id", "channel", "block_ix"], "left")
    empty = F.array().cast("array<struct<start_ix:bigint,end_ix:bigint>>")

    @F.pandas_udf("samples bigint, covered bigint, changed bigint, changed_outside bigint, stray array<bigint>, max_removed double, reconstruction_error double, "
                  "original_sum double, proposed_sum double, removed_sum double")
    def measure(old: pd.Series, new: pd.Series, first: pd.Series, ws: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, s, spans in zip(old, new, first, ws):
            a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
            gone, moved = a - b, a != b
            inside = np.zeros(a.size, dtype=bool)
            for q in spans:
                inside[max(q["start_ix"] - s, 0) : max(q["end_ix"] - s, 0)] = True
            out = moved & ~inside
            rows.append((a.size, int(inside.sum()), int(moved.sum()), int(out.sum()), (np.flatnonzero(out) + s).tolist(), float(np.abs(gone).max(initial=0.0)),
                         float(np.abs(b + gone - a).max(initial=0.0)), float(a @ a), float(b @ b), float(gone @ gone)))
        return pd.DataFrame(rows, columns=["samples", "covered", "changed", "changed_outside", "stray", "max_removed", "reconstruction_error",
                                           "original_sum", "proposed_sum", "removed_sum"])

    m = measure("original", "samples", "start_sample", F.coalesce("_ws", empty))
    return j.select("capture_id", "channel", m.alias("_m")).select("capture_id", "channel", "_m.*")


def render_metrics(laid: DataFrame, windows: DataFrame, block: int) -> DataFrame:
    """Per capture: samples, covered by windows, changed, those changed outside the windows (which must be 0), the largest removal, the
    error of original = proposed + removed, and the levels (RMS) of the three."""
    level = lambda c: F.sqrt(F.sum(f"{c}_sum") / F.sum("samples")).alias(f"{c}_rms")
    return measured_blocks(laid, windows, block).groupBy("capture_id").agg(
        F.sum("samples").alias("samples"), F.sum("covered").alias("covered"), F.sum("changed").alias("changed"), F.max("max_removed").alias("max_removed"),
        F.max("reconstruction_error").alias("reconstruction_error"), F.sum("changed_outside").alias("changed_outside"),
        level("original"), level("proposed"), level("removed"))


def gated_render(metrics: DataFrame, most_gain: float = 0.01, target_rms: float = 0.05, most_monitor: float = 100.0) -> DataFrame:
    """Render metrics with the gains for listening and the reasons against the render.

    The proposed signal is matched in level as far as 1 +- `most_gain` goes; what was removed is raised to
    `target_rms`, at most `most_monitor` times. `status` is accepted without a reason, else refused.
    """
    ratio = F.when(F.col("proposed_rms") > TINY, F.col("original_rms") / F.col("proposed_rms")).otherwise(1.0)
    reasons = F.array_compact(F.array(
        F.when(F.col("changed_outside") != 0, "changed_outside_events"), F.when(F.col("changed") == 0, "no_bounded_change"),
        F.when(F.col("reconstruction_error") > 1e-12, "residue_does_not_reconstruct")))
    out = metrics.withColumn("proposed_gain", F.least(F.greatest(ratio, F.lit(1.0 - most_gain)), F.lit(1.0 + most_gain)))
    out = out.withColumn("monitor_gain", F.least(F.lit(most_monitor), target_rms / F.greatest("removed_rms", F.lit(TINY))))
    out = out.withColumn("reasons", reasons)
    return out.withColumn("status", F.when(F.size("reasons") == 0, "accepted").otherwise("refused"))


def edge_envelope(at: np.ndarray, length: int, fade: int, steps: int | None = None) -> np.ndarray:
    """Raised cosine from 0 to 1 in `steps` (or `fade`) steps over `fade` samples at both ends of a scope; 0 outside."""
    edge = np.minimum(at, length - 1 - at)
    rise = 0.5 - 0.5 * np.cos(np.pi * np.clip(edge, 0, fade) / max(fade if steps is None else steps, 1))
    return np.where(edge < 0, 0.0, np.where(edge < fade, rise, 1.0))


def remove_lines(blocks: DataFrame, lines: DataFrame, scopes: DataFrame, rate: int, fade: int) -> DataFrame:
    """Laid blocks without the fitted lines inside each capture's scope, faded at its edges: the closed form on a
    block's own positions. lines: (capture_id, channel, lines array<struct<hz, c, s>>), one row a channel; scopes:
    (capture_id, scope_start, scope_end), one a capture."""
    j = blocks.join(lines, ["capture_id", "channel"], "left").join(scopes, "capture_id", "left")

    @F.pandas_udf("array<double>")
    def clean(xs: pd.Series, first: pd.Series, own: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for x, s, tones, a, b in zip(xs, first, own, lo, hi):
            x = np.asarray(x, dtype=float)
            at = np.arange(s, s + x.size)
            model = np.zeros(x.size)
            for q in tones:
                turn = 2.0 * np.pi * q["hz"] * at / float(rate)
                model += q["c"] * np.cos(turn) + q["s"] * np.sin(turn)
            out.append(x - model * edge_envelope(at - a, b - a, fade))
        return pd.Series(out)

    bare = F.col("lines").isNull() | F.col("scope_start").isNull()
    new = clean("samples", "start_sample", F.coalesce("lines", F.array().cast("array<struct<hz:double,c:double,s:double>>")),
                F.coalesce("scope_start", F.lit(0).cast("bigint")), F.coalesce("scope_end", F.lit(0).cast("bigint")))
    return j.select(*LAID[:5], F.col("samples").alias("original"), F.when(bare, F.col("samples")).otherwise(new).alias("samples"))


def stretches(scopes: DataFrame, frame: int, hop: int, length: int) -> DataFrame:
    """Each scope in stretches of `length` samples, as windows that reach as far as any frame over the stretch:
    (capture_id, start_ix, end_ix, scope_start, scope_end, own_start, own_end). Scopes shorter than a frame have none."""
    out = scopes.where(F.col("scope_end") - F.col("scope_start") >= frame).withColumn(
        "_k", F.explode(F.expr(f"sequence(0l, (scope_end - scope_start - 1) div {length})")))
    a = F.col("scope_start") + F.col("_k") * length
    out = out.withColumn("own_start", a).withColumn("own_end", F.least(F.col("scope_end"), a + length))
    return out.select("capture_id", F.greatest(F.col("scope_start"), F.col("own_start") - frame).alias("start_ix"),
                      F.least(F.col("scope_end"), F.col("own_end") + frame).alias("end_ix"), "scope_start", "scope_end", "own_start", "own_end")


def overlap_added(cut: DataFrame, side: DataFrame, frame: int, hop: int, fade: int, each, name: str = "removed") -> DataFrame:
    """(capture_id, channel, scope_start, own_start, `name` array<double>): the frames' results added up per stretch.

    cut: the samples of stretches(); side: (capture_id, channel, side array<double>). Frames begin at every `hop` of
    the scope and the last one ends with it. `each(values, taper, side)` returns what a root-Hann frame gives, already
    tapered; overlapping parts are summed, divided by the summed window and faded at the scope's ends. A frame over
    the edge of two stretches is computed in both, so nothing has to be sent between them.
    """
    j = cut.join(side, ["capture_id", "channel"])

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series, first: pd.Series, lo: pd.Series, hi: pd.Series, a: pd.Series, b: pd.Series, own: pd.Series) -> pd.Series:
        taper, out = np.sqrt(np.hanning(frame)), []
        for x, s, start, end, left, right, q in zip(xs, first, lo, hi, a, b, own):
            x, q = np.asarray(x, dtype=float), np.asarray(q, dtype=float)
            k = np.arange(max(0, (left - frame - start) // hop), (end - frame - start) // hop + 1)
            starts = np.unique(np.append(start + k * hop, end - frame))
            starts = starts[(starts + frame > left) & (starts < right)]
            total, weight = np.zeros(right - left), np.zeros(right - left)
            for f in starts.tolist():
                got = each(x[f - s : f - s + frame], taper, q)
                p, r = max(f, left), min(f + frame, right)
                weight[p - left : r - left] += (taper**2)[p - f : r - f]
                if got is not None:
                    total[p - left : r - left] += got[p - f : r - f]
            total = np.where(weight > TINY, total / np.maximum(weight, TINY), total)
            out.append(total * edge_envelope(np.arange(left, right) - start, end - start, fade, fade - 1))
        return pd.Series(out)

    got = run("samples", "start_ix", "scope_start", "scope_end", "own_start", "own_end", "side")
    return j.select("capture_id", "channel", "scope_start", "own_start", got.alias(name))
