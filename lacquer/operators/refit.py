"""Refits of projects whose rows fit a task: the rows of a project meet once, and many projects are solved together.

Gives what the single steps of `plans.segment` give. Projects these arrays do not describe (numbers that are not 1 to n,
missing or infinite values, nested gaps under sides) come back as DEFERRED, for the single steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .choice import POINT, SAME_POINT_SECONDS, VIRTUAL_SCORE, choose_points

FITTED, NO_ROOM, NO_SPACING, DEFERRED = range(4)
MUSIC, TRACK, GAP = range(3)
MODES = ["none", "complete", "partial-imputed"]
BATCH_ROWS = 131_072
PAIRS = 1 << 22
WIDE = 64  # points of a problem that is solved beside others; a longer one is solved by itself
FEW = 8  # problems of one shape that are not worth arrays
EXACT = 1 << 53


def tagged(release: DataFrame, music: DataFrame, cands: DataFrame) -> DataFrame:
    """All rows of the three tables as one: (project_id, kind, i1, i2, x1 to x5, s).

    s: both forms of the side, behind the length of the first one; a second column of texts would cost more than either.
    """
    long, real, text = (lambda c, t=t: F.col(c).cast(t) for t in ("bigint", "double", "string"))
    side = F.coalesce(text("side"), F.lit(""))
    name = F.upper(F.trim(side))
    shape = {
        MUSIC: (music, {"i1": long("music_start"), "i2": long("music_end")}),
        TRACK: (release, {"i1": long("number"), "x1": real("duration"), "s": F.concat(F.length(name).cast("string"), F.lit(":"), name, F.lower(side))}),
        GAP: (cands, {"i1": long("candidate_index"), "i2": long("cut_sample"), "x1": real("start_seconds"), "x2": real("end_seconds"),
                      "x3": real("cut_seconds"), "x4": real("duration_seconds"), "x5": real("score")}),
    }
    kinds = {**dict.fromkeys(["i1", "i2"], "bigint"), **dict.fromkeys(["x1", "x2", "x3", "x4", "x5"], "double"), "s": "string"}
    parts = [
        df.where("project_id is not null").select("project_id", F.lit(kind).alias("kind"), *(cols.get(n, F.lit(None).cast(t)).alias(n) for n, t in kinds.items()))
        for kind, (df, cols) in shape.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def bound(values: np.ndarray, first: np.ndarray, stop: np.ndarray, at: np.ndarray, after: bool) -> np.ndarray:
    """In each ascending stretch [first, stop) of `values`, the first place whose value is not below `at` (above, if `after`)."""
    lo, hi = first.copy(), stop.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        v = values[np.where(open_, mid, 0)]
        below = open_ & ((v <= at) if after else (v < at))
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of each row of the stretches that begin at `first`."""
    owner = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    return owner, np.arange(len(owner)) - begin[owner] + first[owner]


def offsets(count: np.ndarray) -> np.ndarray:
    return np.cumsum(count) - count


def in_order(*keys: np.ndarray) -> np.ndarray | slice:
    """The order by `keys`, the first one first; nothing is moved where two of them ascend strictly already."""
    a, b = keys[:2]
    if len(a) < 2 or np.all((a[1:] > a[:-1]) | ((a[1:] == a[:-1]) & (b[1:] > b[:-1]))):
        return slice(None)
    return np.lexsort(keys[::-1])


def last_of(owner: np.ndarray) -> np.ndarray:
    """Places at which the next row has another owner."""
    return np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else np.zeros(0, np.int64)


def exact_choices(lo, hi, count, lengths, at, known, points, first, stop, spacing):
    """choose_points() for many problems, where all of its boundaries fit.

    Problem q has `count[q]` tracks between lo and hi, their lengths at `lengths[at[q]:]` if `known[q]`, and the points
    [first, stop), ascending as POINT. Returns which problems have count - 1 points, and a row (cut, start, end, score,
    ix) for each boundary, in stretches of count - 1 for each problem.
    """
    m = count - 1
    out_at = offsets(m)
    out = np.zeros((int(m.sum()), len(POINT)))
    cuts = points[:, 0]
    p0 = bound(cuts, first, stop, lo + spacing, False)
    p1 = np.maximum(p0, bound(cuts, first, stop, hi - spacing, True))
    held = p1 - p0
    good = m == 0
    shape = np.where(held + m <= WIDE, m * 1024 + (held + 3) // 4, -1)
    shape[m == 0] = -2
    order = np.argsort(shape, kind="stable")
    ends = last_of(shape[order])
    begin = 0
    for end in ends:
        q = order[begin : end + 1]
        begin = end + 1
        kind = shape[q[0]]
        if kind == -2:
            continue
        if kind == -1 or len(q) < FEW:
            for i in q:
                own = lengths[at[i] : at[i] + count[i]].tolist() if known[i] else None
                pts = [dict(zip(POINT, p)) for p in points[p0[i] : p1[i]].tolist()]
                got = choose_points(pts, float(lo[i]), float(hi[i]), int(count[i]), own, spacing)
                good[i] = len(got) == m[i]
                if good[i]:
                    out[out_at[i] : out_at[i] + m[i]] = [[p[c] for c in POINT] for p in got]
            continue
        fit, got = _same_shape(lo[q], hi[q], int(count[q[0]]), lengths, at[q], known[q], points, p0[q], held[q], spacing)
        good[q] = fit
        out[(out_at[q][:, None] + np.arange(m[q[0]])).ravel()] = got.reshape(-1, len(POINT))
    return good, out


def _same_shape(lo, hi, n, lengths, at, known, points, p0, held, spacing):
    m, size = n - 1, len(lo)
    rows = np.arange(size)
    # targets: in proportion to the lengths where they are known, else even
    k = np.arange(1, n)
    targets = lo[:, None] + (hi - lo)[:, None] * k / n
    own = np.flatnonzero(known)
    if len(own):
        part = lengths[at[own][:, None] + np.arange(n)]
        total = np.array([math.fsum(x) for x in part.tolist()])
        fine = (part > 0).all(axis=1) & np.isfinite(total)
        own, part, total = own[fine], part[fine], total[fine]
        run = np.cumsum(part[:, :-1], axis=1)
        targets[own] = lo[own][:, None] + (hi - lo)[own][:, None] * run / total[:, None]
    # measured points, then invented ones, by cut and falling score
    wide = int(held.max()) + m
    slot = np.arange(wide)
    real = slot[None, :] < held[:, None]
    src = points[np.where(real, p0[:, None] + slot, 0)] if len(points) else np.zeros((size, wide, len(POINT)))
    made = slot[None, :] - held[:, None]
    is_made = (made >= 0) & (made < m)
    t = np.take_along_axis(targets, np.clip(made, 0, m - 1), axis=1)
    cut = np.where(real, src[:, :, 0], np.where(is_made, t, np.inf))
    start, end = np.where(real, src[:, :, 1], t), np.where(real, src[:, :, 2], t)
    score, ix = np.where(real, src[:, :, 3], VIRTUAL_SCORE), np.where(real, src[:, :, 4], -1.0)
    full = cut, start, end, score, ix
    base = (rows * wide)[:, None]
    order = base + np.argsort(cut, axis=1, kind="stable")
    cut = np.take(full[0], order)
    if ((cut[:, 1:] == cut[:, :-1]) & np.isfinite(cut[:, 1:])).any():
        order = base + np.argsort(-score, axis=1, kind="stable")
        order = np.take(order, base + np.argsort(np.take(full[0], order), axis=1, kind="stable"))
        cut = np.take(full[0], order)
    score = np.take(score, order)
    # points within 50 ms of the last kept one: the better of both is kept
    kept = np.zeros((size, wide), np.int64)
    number, top, best = np.zeros(size, np.int64), np.full(size, -np.inf), np.zeros(size)
    real = np.isfinite(cut)
    for i in range(wide):
        near = cut[:, i] - top < SAME_POINT_SECONDS
        new = real[:, i] & ~near
        take = new | (real[:, i] & near & (score[:, i] > best))
        number += new
        r = rows[take]
        kept[r, number[take] - 1] = i
        top, best = np.where(take, cut[:, i], top), np.where(take, score[:, i], best)
    wide = int(number.max())
    kept = np.take(order, base + kept[:, :wide])
    valid = np.arange(wide)[None, :] < number[:, None]
    cut = np.where(valid, np.take(full[0], kept), np.inf)
    start, end, score = (np.take(x, kept) for x in full[1:4])
    # the earliest and the latest path bound the points of each target
    early, late = np.full((size, m), wide), np.full((size, m), -1)
    got, last = np.zeros(size, np.int64), lo.copy()
    for i in range(wide):
        r = rows[valid[:, i] & (got < m) & (cut[:, i] - last >= spacing)]
        early[r, got[r]] = i
        got[r] += 1
        last[r] = cut[r, i]
    fit = (got == m) & (hi - last >= spacing)
    got, last = np.zeros(size, np.int64), hi.copy()
    for i in range(wide - 1, -1, -1):
        r = rows[valid[:, i] & (got < m) & (last - cut[:, i] >= spacing)]
        late[r, m - 1 - got[r]] = i
        got[r] += 1
        last[r] = cut[r, i]
    before = np.zeros((size, wide), np.int64)
    with np.errstate(invalid="ignore"):
        for i in range(1, wide):
            before[:, i] = ((cut[:, i : i + 1] - cut[:, :i]) >= spacing).sum(axis=1)
    tolerance = np.minimum(45.0, np.maximum(8.0, 0.15 * np.maximum(1.0, (hi - lo) / n)))[:, None]
    slot, values, back = np.arange(wide)[None, :], None, []
    any_before, prior = before > 0, (rows * wide)[:, None] + np.maximum(before - 1, 0)
    with np.errstate(invalid="ignore"):
        for k in range(m):
            t = targets[:, k : k + 1]
            far = np.where(end <= start, np.abs(cut - t), np.maximum(np.maximum(0.0, start - t), t - end))
            gain = score - 0.75 * far / tolerance
            inside = (slot >= early[:, k : k + 1]) & (slot <= late[:, k : k + 1])
            if k:
                run = np.maximum.accumulate(values, axis=1)
                rise = np.zeros((size, wide), np.int64)
                rise[:, 1:] = np.where(values[:, 1:] > run[:, :-1], slot[:, 1:], 0)
                rise = np.maximum.accumulate(rise, axis=1)
                back.append(np.take(rise, prior))
                gain = np.where(any_before, np.take(run, prior), -np.inf) + gain
            values = np.where(inside, gain, -np.inf)
    path = np.zeros((size, m), np.int64)
    i = np.argmax(values, axis=1)
    path[:, m - 1] = i
    for k in range(m - 1, 0, -1):
        i = back[k - 1][rows, i]
        path[:, k - 1] = i
    path = np.take(kept, (rows * wide)[:, None] + path)
    cut, start, end, score, ix = (np.take(x, path) for x in full)
    guard = np.minimum(0.5, (end - start) / 4.0)
    cut = np.where((end > start) & (start + guard <= targets) & (targets <= end - guard), targets, cut)
    return fit, np.stack([cut, start, end, score, ix], axis=2)


def spaced(values: np.ndarray, first, last, minimum: int) -> np.ndarray:
    """feasible_targets() of rows of equally many values."""
    n = values.shape[1] + 1
    step = np.arange(1, n) * minimum
    run = np.maximum.accumulate(values - step, axis=1) if n > 1 else values
    return np.minimum((last - n * minimum)[:, None], np.maximum(first[:, None], run)) + step


class _Batch:
    """Whole projects, their rows one behind another."""

    def __init__(self, table: pa.Table, rate, minimum_seconds: float):
        self.rate, self.seconds, self.minimum = rate, minimum_seconds, int(-(-minimum_seconds * rate // 1))
        col = lambda c: table.column(c).combine_chunks()
        self.key = col("project_id")
        kind = col("kind").to_numpy(zero_copy_only=False)
        new = np.append(True, np.asarray(pc.not_equal(self.key.slice(1), self.key.slice(0, len(self.key) - 1)).to_numpy(zero_copy_only=False), bool))
        self.first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        self.size = len(self.first)
        whole = lambda c: (pc.fill_null(col(c), 0).to_numpy(zero_copy_only=False), col(c).is_null().to_numpy(zero_copy_only=False))
        ints, reals = {c: whole(c) for c in ("i1", "i2")}, {c: whole(c) for c in ("x1", "x2", "x3", "x4", "x5")}
        per = lambda rows, ok=None: np.bincount(group[rows], ok, self.size).astype(np.int64)

        at = np.flatnonzero(kind == MUSIC)
        self.start, self.end = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.start[group[at]], self.end[group[at]] = ints["i1"][0][at], ints["i2"][0][at]
        ranges = per(at)
        unknown = per(at, ints["i1"][1][at] | ints["i2"][1][at]) > 0
        odd = (ranges > 1) | (self.start <= -EXACT) | (self.start >= EXACT) | (self.end <= -EXACT) | (self.end >= EXACT)

        at = np.flatnonzero(kind == TRACK)
        at = at[in_order(group[at], ints["i1"][0][at])]
        self.n = per(at)
        self.track = offsets(self.n)
        number = ints["i1"][0][at]
        self.duration, self.missing = reals["x1"][0][at], reals["x1"][1][at]
        bad = ints["i1"][1][at] | (number != np.arange(len(at)) - self.track[group[at]] + 1)
        bad |= ~self.missing & ~(np.isfinite(self.duration) & (self.duration > 0))
        odd |= per(at, bad) > 0
        labels = col("s").take(pa.array(at)).dictionary_encode()
        code = labels.indices.to_numpy(zero_copy_only=False)
        sizes, texts = zip(*(x.split(":", 1) for x in labels.dictionary.to_pylist())) if len(at) else ((), ())
        names = [x[: int(k)] for k, x in zip(sizes, texts)]
        lower = [x[int(k) :] for k, x in zip(sizes, texts)]
        self.side, self.lower = (np.array([seen.setdefault(x, len(seen)) for x in xs], np.int64)[code] for xs, seen in ((names, {}), (lower, {})))
        self.blank = np.array([x == "" for x in names], bool)[code]

        at = np.flatnonzero(kind == GAP)
        self.gaps = per(at)
        self.gap = offsets(self.gaps)
        g = group[at]
        x = {c: reals[c][0][at] for c in reals}
        index, sample = ints["i1"][0][at], ints["i2"][0][at]
        bad = np.zeros(len(at), bool)
        for c in reals:
            bad |= reals[c][1][at] | ~(np.abs(x[c]) < 1e12)
        for c in ints:
            bad |= ints[c][1][at] | (np.abs(ints[c][0][at]) >= EXACT)
        bad |= x["x2"] < x["x1"]
        odd |= per(at, bad) > 0
        o = in_order(g, x["x3"], x["x1"], x["x2"], x["x5"], index)
        self.points = np.stack([x["x3"], x["x1"], x["x2"], x["x5"], index.astype(float)], axis=1)[o]
        o = in_order(g, x["x1"], x["x2"])
        self.of, self.index, self.sample, self.long = g[o], index[o], sample[o], x["x4"][o]
        self.by_start = np.stack([x["x3"], x["x1"], x["x2"], x["x5"], index.astype(float)], axis=1)[o]

        seen = (ranges > 0) & (self.n > 0) & ~((ranges == 1) & unknown)
        room = self.end - self.start >= self.n * self.minimum
        self.status = np.where(odd | (self.minimum < 1), DEFERRED, np.where(room, FITTED, NO_ROOM))
        self.status[~seen] = -1
        self._durations()

    def _durations(self):
        """Lengths and targets of the tracks, their side changes and the runs of equal sides."""
        rows = len(self.duration)
        self.mode = np.zeros(self.size, np.int64)
        self.lengths, self.target, self.fitting = np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        self.change, self.opens, self.sums = np.zeros(rows, bool), np.zeros(rows, bool), np.zeros(rows)
        self.sided = np.zeros(self.size, bool)
        for n in np.unique(self.n[self.status == FITTED]):
            g = np.flatnonzero((self.status == FITTED) & (self.n == n))
            at = self.track[g][:, None] + np.arange(n)
            start, end = self.start[g], self.end[g]
            known = ~self.missing[at]
            own = np.where(known, self.duration[at], 0.0)
            k = known.sum(axis=1)
            lost = n - k
            self.mode[g] = np.where(k == 0, 0, np.where(lost == 0, 1, 2))
            left = (end - start) / self.rate - np.cumsum(own, axis=1)[:, -1]
            ranked = np.sort(np.where(known, own, np.inf), axis=1)
            pos = 0.5 * np.maximum(k - 1, 0)
            low = np.take_along_axis(ranked, np.floor(pos).astype(np.int64)[:, None], axis=1)[:, 0]
            high = np.take_along_axis(ranked, np.ceil(pos).astype(np.int64)[:, None], axis=1)[:, 0]
            with np.errstate(invalid="ignore", divide="ignore"):
                filler = np.where(left >= lost * self.seconds, left / lost, low + (high - low) * (pos - np.floor(pos)))
            own = np.where(known, own, np.where(k > 0, filler, 1.0)[:, None])
            broken = ~((own > 0) & np.isfinite(own)).all(axis=1)
            self.status[g[broken]] = DEFERRED
            own[broken] = 1.0
            run = np.cumsum(own, axis=1)
            target = (start[:, None] + np.rint((end - start)[:, None] * run[:, :-1] / run[:, -1:])).astype(np.int64)
            fitting = spaced(target, start, end, self.minimum)
            edges = np.concatenate([start[:, None], fitting, end[:, None]], axis=1)
            self.lengths[at] = np.diff(edges, axis=1) / float(self.rate)
            self.target[at[:, :-1]], self.fitting[at[:, :-1]] = target, fitting
            if n > 1:
                lower, side = self.lower[at], self.side[at]
                self.change[at[:, :-1]] = lower[:, 1:] != lower[:, :-1]
                opens = np.ones((len(g), n), bool)
                opens[:, 1:] = side[:, 1:] != side[:, :-1]
                names = np.sort(side, axis=1)
                distinct = 1 + (names[:, 1:] != names[:, :-1]).sum(axis=1)
                runs = opens.sum(axis=1)
                self.opens[at] = opens
                self.sided[g] = (runs > 1) & (distinct == runs) & ~self.blank[at].any(axis=1)
                sums = self.lengths[at]
                for j in range(1, n):
                    sums[:, j] = np.where(opens[:, j], sums[:, j], sums[:, j - 1] + sums[:, j])
                self.sums[at] = sums

    def _turns(self):
        """Gaps of the projects with sides, joined over short breaks: their points and how many each project has."""
        p, of = self.by_start, self.of
        same = np.append(False, of[1:] == of[:-1])
        falls = same & (p[:, 2] < np.append(0.0, p[:-1, 2]))
        nested = np.bincount(of[falls], minlength=self.size) > 0
        self.status[self.sided & nested & (self.status == FITTED)] = DEFERRED
        mine = self.sided & (self.status == FITTED)
        take = mine[of]
        p, of, same = p[take], of[take], same[take]
        new = ~same | (p[:, 1] - np.append(0.0, p[:-1, 2]) > 0.75)
        run = np.cumsum(new) - 1
        ends = last_of(run)
        begins = np.flatnonzero(new)
        best = ends.copy()
        many = np.flatnonzero((ends > begins)[run] if len(run) else np.zeros(0, bool))
        o = many[np.lexsort((p[many, 4], p[many, 0], -p[many, 1], p[many, 3], run[many]))]
        best[run[o]] = o  # of rows with the same place the last one stays, which is the best of its run
        joined = np.stack([p[best, 0], p[begins, 1], p[ends, 2], p[best, 3], p[best, 4]], axis=1)
        owner = of[begins]
        joined = joined[in_order(owner, *joined.T)]
        return joined, np.bincount(owner, minlength=self.size)

    def _choose(self):
        """The chosen points of every project that has all of them: (project, rows), by project."""
        spacing = self.seconds
        lo, hi = self.start / self.rate, self.end / self.rate
        joined, found = self._turns()
        mine = np.flatnonzero(self.sided & (self.status == FITTED))
        parts = np.zeros((0, len(POINT)))
        owners = np.zeros(0, np.int64)
        filled = np.zeros(self.size, bool)
        if len(mine):
            owner, row = spread(self.track[mine], self.n[mine])
            opening = self.opens[row]
            closing = np.append(opening[1:], True)
            sides = np.bincount(owner[opening], minlength=len(mine))
            first = offsets(found)[mine]
            known = self.mode[mine] > 0
            good, turns = exact_choices(lo[mine], hi[mine], sides, self.sums[row][closing], offsets(sides), known, joined,
                                        first, first + found[mine], spacing)
            # each side between its two changes
            at = offsets(sides)
            who, side = spread(np.zeros(len(mine), np.int64), sides)
            turn = at[who] - who + side  # the change after this side
            begin = row[opening]
            tracks = np.diff(np.append(np.flatnonzero(opening), len(row)))
            low, high = lo[mine][who], hi[mine][who]
            low[side > 0] = turns[turn[side > 0] - 1, 2]
            inner = side < sides[who] - 1
            high[inner] = turns[turn[inner], 1]
            room = (high > low) & (high - low >= tracks * spacing)
            good &= np.logical_and.reduceat(room, at)
            go = good[who]
            fit, got = exact_choices(low[go], high[go], tracks[go], self.lengths, begin[go], known[who[go]], self.points,
                                     self.gap[mine][who[go]], (self.gap + self.gaps)[mine][who[go]], spacing)
            none = np.bincount(who[go][~fit], minlength=len(mine)) > 0
            good &= ~none
            filled[mine[good]] = True
            of_side = np.repeat(mine[who[go]], tracks[go] - 1)
            of_turn = np.repeat(mine, sides - 1)
            parts = np.concatenate([turns[filled[of_turn]], got[filled[of_side]]])
            owners = np.concatenate([of_turn[filled[of_turn]], of_side[filled[of_side]]])
            o = in_order(owners, *parts.T)
            parts, owners = parts[o], owners[o]
        rest = np.flatnonzero((self.status == FITTED) & ~filled)
        good, got = exact_choices(lo[rest], hi[rest], self.n[rest], self.lengths, self.track[rest], self.mode[rest] > 0, self.points,
                                  self.gap[rest], (self.gap + self.gaps)[rest], spacing)
        self.status[rest[~good]] = NO_SPACING
        owner = np.repeat(rest, self.n[rest] - 1)
        keep = self.status[owner] == FITTED
        owners, parts = np.concatenate([owners, owner[keep]]), np.concatenate([parts, got[keep]])
        o = np.argsort(owners, kind="stable")
        return owners[o], parts[o]

    def _match(self, owner: np.ndarray, p: np.ndarray) -> np.ndarray:
        """match_candidates(): the place of the gap behind each chosen point, -1 where there is none."""
        tol = max(1.0 / self.rate, 0.002)
        s0, s1 = p[:, 1], p[:, 2]
        near = 2 * tol + 1e-9 * np.abs(s1)
        starts = self.by_start[:, 1]
        first, stop = self.gap[owner], (self.gap + self.gaps)[owner]
        a = bound(starts, first, stop, s0 - near, False)
        count = np.where(s1 > s0, np.maximum(0, bound(starts, first, stop, s1 + near, True) - a), 0)
        out = np.full(len(owner), -1)
        total, begin = np.cumsum(count), 0
        ms = lambda x: np.floor(x * 1000).astype(np.int64)
        while begin < len(owner):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
            who, c = spread(a[begin:end], count[begin:end])
            who += begin
            start, stop_ = self.by_start[c, 1], self.by_start[c, 2]
            exact = (np.abs(start - s0[who]) <= tol) & (np.abs(stop_ - s1[who]) <= tol)
            held = (self.long[c] > 0) & (start >= s0[who] - tol) & (stop_ <= s1[who] + tol)
            met = (ms(start) < ms(s1[who]) + 5) & (ms(s0[who]) - 4 < ms(stop_) + 1)
            hit = (exact | held) & met
            who, c, exact = who[hit], c[hit], exact[hit]
            out[who] = c
            many = np.flatnonzero(np.bincount(who - begin, minlength=end - begin)[who - begin] > 1)
            w, x = who[many], c[many]
            o = np.lexsort((self.sample[x], -self.index[x], self.long[x], self.by_start[x, 3], exact[many], w))
            out[w[o]] = x[o]  # of rows with the same place the last one stays
            begin = end
        return out

    def solve(self, schema: pa.Schema) -> pa.RecordBatch:
        owner, p = self._choose()
        count = np.bincount(owner, minlength=self.size)
        number = np.arange(len(owner)) - offsets(count)[owner] + 1
        raw = np.rint(p[:, 0] * self.rate).astype(np.int64)
        moved = np.zeros(len(owner), np.int64)
        begin = offsets(count)
        for m in np.unique(count[count > 0]):
            g = np.flatnonzero(count == m)
            at = begin[g][:, None] + np.arange(m)
            moved[at] = spaced(raw[at], self.start[g], self.end[g], self.minimum)
        behind = self._match(owner, p)
        none = behind < 0
        row = self.track[owner] + number - 1
        even = self.mode[owner] == 0
        # projects without boundaries have one row that says so
        bare = np.flatnonzero((self.status >= 0) & (count == 0))
        who = np.concatenate([owner, bare])
        is_bare = np.arange(len(who)) >= len(owner)
        pad = lambda x: np.concatenate([x, np.zeros(len(bare), x.dtype)])
        pick = lambda x: x[np.maximum(behind, 0)] if len(x) else np.zeros(len(behind), x.dtype)
        masked = lambda x, gone=None: pa.array(pad(x), mask=is_bare if gone is None else is_bare | pad(gone))
        columns = {
            "project_id": self.key.take(pa.array(self.first[who])), "status": pa.array(self.status[who].astype(np.int64)),
            "track_count": pa.array(self.n[who]), "music_start": pa.array(self.start[who]), "music_end": pa.array(self.end[who]),
            "mode": pa.array(MODES).take(pa.array(self.mode[who])), "boundary": masked(number), "raw_sample": masked(raw),
            "chosen_sample": masked(moved), "score": masked(pick(self.by_start[:, 3]), none), "candidate_index": masked(pick(self.index), none),
            "target_sample": masked(self.target[row], even), "fitting_target": masked(self.fitting[row], even), "side_change": masked(self.change[row]),
        }
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def refit_at_once(rows: DataFrame, rate: int, minimum_seconds: float, parts: int | None = None, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """One row for each boundary of the projects in `rows` (as of tagged()), and one row for each project without any.

    (project_id, status, track_count, music_start, music_end, mode, boundary, raw_sample, chosen_sample, score,
    candidate_index, target_sample, fitting_target, side_change); status is FITTED, NO_ROOM, NO_SPACING or DEFERRED.
    """
    long = "status track_count music_start music_end boundary raw_sample chosen_sample candidate_index target_sample fitting_target".split()
    order = ("project_id status track_count music_start music_end mode boundary raw_sample chosen_sample score candidate_index "
             "target_sample fitting_target side_change").split()
    kinds = {**dict.fromkeys(long, T.LongType()), "mode": T.StringType(), "score": T.DoubleType(), "side_change": T.BooleanType(),
             "project_id": rows.schema["project_id"].dataType}
    out = T.StructType([T.StructField(n, kinds[n]) for n in order])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.StringType: pa.string()}

        def solved(table):
            schema = pa.schema([(f.name, table.schema.field("project_id").type if f.name == "project_id" else arrow[type(f.dataType)]) for f in out])
            yield _Batch(table, rate, minimum_seconds).solve(schema)

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < batch_rows:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("project_id").combine_chunks()
            starts = np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False))
            if not len(starts):
                continue
            last = int(starts[-1]) + 1  # the last project may go on
            yield from solved(table.slice(0, last))
            rest = table.slice(last).combine_chunks()
            held, n = rest.to_batches(), rest.num_rows
        if held:
            yield from solved(pa.Table.from_batches(held))

    dealt = rows.repartition(parts, "project_id") if parts else rows.repartition("project_id")
    return dealt.sortWithinPartitions("project_id").mapInArrow(solve, out)  # one key: the rows of a project are ordered in arrays
