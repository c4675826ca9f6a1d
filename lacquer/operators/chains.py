"""Folds and best paths over ordered points, chunk by chunk.

A chunk is a stretch of time, so its points and the points near its edge are bounded. A fold over a series is cut into
chunks that each answer for every state in which they can be entered; the answers, one short row a chunk, are put
together in order, and every chunk then repeats its fold from the state that is true. A best path takes one layer after
another: a layer of a chunk sees the points of the chunk before it and one running best of all earlier ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

CHUNK_SECONDS = 600.0


def fold_close(points: list, entering, near: float) -> tuple[list, bool]:
    """Points that stay when each one closer than `near` to the last kept only takes its place if it is better, and
    whether the entering point lost its place. Points are (cut, negative score, ...) in order; `entering` may be None."""
    kept, last, replaced = [], entering, False
    for p in points:
        if last is not None and p[0] - last[0] < near:
            if p[1] < last[1]:
                if kept:
                    kept[-1] = p
                else:
                    kept, replaced = [p], True
                last = p
        else:
            kept.append(p)
            last = p
    return kept, replaced


def collapse(points: DataFrame, key: str, near: float, payload: list[str], chunk: float = CHUNK_SECONDS) -> DataFrame:
    """(key, cut, score, payload) of the points that stay when, along the cut, each one closer than `near` to the last
    kept one only takes its place if its score is higher. Of equal cuts the highest score counts, then the least payload.
    """
    width = max(chunk, near)
    rest = F.struct((-F.col("score")).alias("neg"), *payload)
    one = points.groupBy(key, "cut").agg(F.min(rest).alias("_r"))
    item = F.struct("cut", "_r.*")
    cut = one.withColumn("_c", F.floor(F.col("cut") / width).cast("bigint"))
    kind = one.select(item.alias("i")).schema["i"].dataType.simpleString()
    chunks = stage(cut.groupBy(key, "_c").agg(F.array_sort(F.collect_list(item)).alias("ps")))
    last = F.transform("ps", lambda p: F.struct(p["cut"].alias("cut"), p["neg"].alias("neg")))
    tails = chunks.select(key, (F.col("_c") + 1).alias("_d"), last.alias("last")).select(
        key, F.col("_d").alias("_c"), F.filter("last", lambda p: F.col("_d") * F.lit(width) - p["cut"] < near * 2).alias("tail"))
    met = chunks.join(tails, [key, "_c"], "left").withColumn("tail", F.coalesce("tail", F.array().cast("array<struct<cut:double,neg:double>>")))

    @F.pandas_udf("array<struct<cut:double,out_cut:double,out_neg:double,replaced:boolean>>")
    def answers(ps: pd.Series, tail: pd.Series) -> pd.Series:
        out = []
        for own, before in zip(ps, tail):
            own = [(p["cut"], p["neg"]) for p in own]
            rows = []
            for e in [None, *[(t["cut"], t["neg"]) for t in before if own[0][0] - t["cut"] < near]]:
                kept, replaced = fold_close(own, e, near)
                last = kept[-1] if kept else e
                rows.append({"cut": None if e is None else e[0], "out_cut": last[0], "out_neg": last[1], "replaced": replaced})
            out.append(rows)
        return pd.Series(out)

    kinds = chunks.schema[key].dataType.simpleString()
    told = met.select(key, "_c", answers("ps", "tail").alias("a"))

    def put_together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_c")
        state, at, out = None, None, []
        for k, c, a in zip(rows[key], rows["_c"], rows["a"]):
            by = {r["cut"]: r for r in a}
            entering = state if at == c - 1 and state is not None and state[0] in by else None
            r = by[None if entering is None else entering[0]]
            if r["replaced"] and out:
                out[-1]["lost"] = True
            out.append({key: k, "_c": c, "in_cut": None if entering is None else entering[0], "in_neg": None if entering is None else entering[1], "lost": False})
            state, at = (r["out_cut"], r["out_neg"]), c
        return pd.DataFrame(out)

    true = told.groupBy(key).applyInPandas(put_together, f"{key} {kinds}, _c bigint, in_cut double, in_neg double, lost boolean")

    @F.pandas_udf(f"array<{kind}>")
    def kept(ps: pd.Series, cut: pd.Series, neg: pd.Series, lost: pd.Series) -> pd.Series:
        out = []
        for own, c, n, gone in zip(ps, cut, neg, lost):
            got = fold_close([(p["cut"], p["neg"], p) for p in own], None if pd.isna(c) else (c, n), near)[0]
            out.append([p[2] for p in got][: len(got) - bool(gone)])
        return pd.Series(out)

    done = chunks.join(true, [key, "_c"]).select(key, F.explode(kept("ps", "in_cut", "in_neg", "lost")).alias("_p"))
    return done.select(key, F.col("_p.cut").alias("cut"), (-F.col("_p.neg")).alias("score"), *[F.col(f"_p.{c}").alias(c) for c in payload])


STATE = "r array<bigint>, v array<double>, pc array<bigint>, pi array<bigint>"
BEST = "struct<r:bigint,v:double,neg:double,c:bigint,i:bigint>"


def _next_layer(own, before, carry, spacing: float, gains, unit):
    """One more point for every own point: after the best one at least `spacing` before it, the earliest of equal ones.

    own: (cuts, r, v); before: (cuts, r, v) of the chunk before; carry: (r, v, chunk, index) of all earlier ones.
    """
    n, m = len(own[0]), len(before[0])
    cuts, rs, vs = (np.concatenate([b, o]) for b, o in zip(before, own))
    best, best_at, j = (carry[0], carry[1]), (carry[2], carry[3]), 0
    r, v, pc, pi = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1), np.full(n, -1)
    for i in range(n):
        while j < m + i and cuts[m + i] - cuts[j] >= spacing:
            if rs[j] >= 0 and (best[0] < 0 or (rs[j], vs[j]) > best):
                best, best_at = (rs[j], vs[j]), (0 if j >= m else -1, j - m if j >= m else j)
            j += 1
        if best[0] >= 0:
            r[i], v[i] = best[0] + unit[i], best[1] + gains[i]
            pc[i], pi[i] = best_at
    return r, v, pc, pi


def layered_paths(points: DataFrame, rows: DataFrame, key: str, spacing: float, measured_first: bool, chunk: float = CHUNK_SECONDS) -> DataFrame:
    """(key, place, target, p) of the best path of each row: one point for each target, at least `spacing` apart and
    away from `lo` and `hi`, that maximizes score - 0.75 * distance / tolerance; none where that many do not fit.

    With `measured_first` the most points that fit, among those the most measured ones, then the value, a point's
    distance being that of its cut from the nearest target. points: (key, cut, start, end, score, ix), no two closer
    than 50 ms; rows: (key, lo, hi, tolerance, targets array<double>). Every layer is one round of jobs over the
    chunks; back pointers stay in the written layers.
    """
    width = max(chunk, spacing)
    item = F.struct("cut", "start", "end", "score", "ix")
    base = points.withColumn("_c", F.floor(F.col("cut") / width).cast("bigint")).groupBy(key, "_c").agg(F.array_sort(F.collect_list(item)).alias("ps"))
    base = stage(base.join(rows.select(key, "lo", "hi", "tolerance", "targets"), key))
    last_layer = base.agg(F.max(F.size("targets"))).first()[0] or 0

    def value(p, targets, tolerance, k):
        cuts, score = np.array([x["cut"] for x in p]), np.array([x["score"] for x in p])
        t = np.asarray(targets, dtype=float)
        if measured_first:
            return score - 0.75 * np.abs(cuts - t[:, None]).min(axis=0) / tolerance
        start, end = np.array([x["start"] for x in p]), np.array([x["end"] for x in p])
        apart = np.where(end <= start, np.abs(cuts - t[k]), np.maximum(0.0, np.maximum(start - t[k], t[k] - end)))
        return score - 0.75 * apart / tolerance

    def units(p):
        return np.array([int(x["end"] > x["start"]) if measured_first else 0 for x in p])

    @F.pandas_udf(STATE)
    def first(ps: pd.Series, lo: pd.Series, targets: pd.Series, tolerance: pd.Series) -> pd.DataFrame:
        out = []
        for p, a, t, tol in zip(ps, lo, targets, tolerance):
            ok = np.array([x["cut"] for x in p]) - a >= spacing
            none = [-1] * len(p)
            out.append((np.where(ok, units(p), -1).tolist(), np.where(ok, value(p, t, tol, 0), -np.inf).tolist(), none, none))
        return pd.DataFrame(out, columns=["r", "v", "pc", "pi"])

    def following(k):
        @F.pandas_udf(STATE)
        def run(c: pd.Series, ps: pd.Series, r: pd.Series, v: pd.Series, cuts: pd.Series, pr: pd.Series, pv: pd.Series,
                cr: pd.Series, cv: pd.Series, cc: pd.Series, ci: pd.Series, targets: pd.Series, tolerance: pd.Series) -> pd.DataFrame:
            out = []
            for at, p, own_r, own_v, *before, a, b, e, f, t, tol in zip(c, ps, r, v, cuts, pr, pv, cr, cv, cc, ci, targets, tolerance):
                own = (np.array([x["cut"] for x in p]), np.asarray(own_r), np.asarray(own_v))
                carry = (int(a), b, -2, int(f)) if a >= 0 else (-1, -np.inf, -1, -1)
                nr, nv, pc, pi = _next_layer(own, [np.asarray(x) for x in before], carry, spacing, value(p, t, tol, k), units(p))
                chunk_of = np.where(pi < 0, -1, np.where(pc == -2, int(e), np.where(pc == -1, at - 1, at)))
                out.append((nr.tolist(), nv.tolist(), chunk_of.tolist(), pi.tolist()))
            return pd.DataFrame(out, columns=["r", "v", "pc", "pi"])

        return run

    cuts = F.transform("ps", lambda p: p["cut"])
    reach = F.transform("ps", lambda p, i: F.struct(
        F.get("r", i).alias("r"), F.get("v", i).alias("v"), (-p["cut"]).alias("neg"), F.col("_c").alias("c"), i.cast("bigint").alias("i")))
    best = F.array_max(F.filter(reach, lambda x: x["r"] >= 0))
    ends = F.array_max(F.filter(reach, lambda x: (x["r"] >= 0) & (F.col("hi") + x["neg"] >= spacing)))
    earlier = Window.partitionBy(key).orderBy("_c").rangeBetween(Window.unboundedPreceding, -2)
    keep = [key, "_c", "ps", "lo", "hi", "tolerance", "targets"]

    layers, goals = [], []
    for k in range(last_layer):
        if k == 0:
            m = first("ps", "lo", "targets", "tolerance")
            layer = base.withColumn("_m", m)
        else:
            now = layers[-1].where(F.size("targets") > k)
            tops = now.select(key, "_c", best.alias("b")).withColumn("carry", F.max("b").over(earlier)).drop("b")
            left = now.select(key, (F.col("_c") + 1).alias("_c"), cuts.alias("cuts"), F.col("r").alias("pr"), F.col("v").alias("pv"))
            met = now.join(tops, [key, "_c"]).join(left, [key, "_c"], "left")
            none = lambda c, t: F.coalesce(c, F.array().cast(t))
            m = following(k)("_c", "ps", "r", "v", none("cuts", "array<double>"), none("pr", "array<bigint>"), none("pv", "array<double>"),
                             F.coalesce("carry.r", F.lit(-1).cast("bigint")), F.coalesce("carry.v", F.lit(0.0)),
                             F.coalesce("carry.c", F.lit(-1).cast("bigint")), F.coalesce("carry.i", F.lit(-1).cast("bigint")), "targets", "tolerance")
            layer = met.select(*keep, m.alias("_m"))
        layers.append(stage(layer.select(*keep, "_m.*")))
        full = layers[-1] if measured_first else layers[-1].where(F.size("targets") == k + 1)
        goals.append(full.select(key, F.lit(k).alias("k"), ends.alias("b")).where("b is not null").groupBy(key, "k").agg(F.max("b").alias("b")))
    if not layers:
        return base.select(key, F.lit(0).alias("place"), F.lit(0.0).alias("target"), F.get("ps", F.lit(0)).alias("p")).limit(0)
    goal = goals[0]
    for g in goals[1:]:
        goal = goal.union(g)
    goal = stage(goal.groupBy(key).agg(F.max(F.struct("k", "b")).alias("g")).select(key, F.col("g.k").alias("k"), F.col("g.b.c").alias("_c"), F.col("g.b.i").alias("i")))
    at, found = None, []
    for k in range(last_layer - 1, -1, -1):
        here = goal.where(F.col("k") == k).select(key, "_c", "i")
        at = here if at is None else at.union(here)
        step = stage(at.join(layers[k], [key, "_c"]).select(
            key, F.get("ps", F.col("i").cast("int")).alias("p"), F.get("targets", F.lit(k)).alias("target"),
            F.get("pc", F.col("i").cast("int")).alias("_c"), F.get("pi", F.col("i").cast("int")).alias("i")))
        found.append(step.select(key, F.lit(k).alias("place"), "target", "p"))
        at = step.select(key, "_c", "i")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
