"""Document scores from preference pairs (Bradley-Terry), and a threshold at a score quantile.

A pair is a document labelled 1 over one labelled 0. The score is linear in standardised statistics; its weights make
the logistic loss of score differences least over the pairs. The threshold is the quantile of the scores that leaves
below it as large a part as is labelled 0. Every labelled row counts: the sums of a Newton step are made where the pairs
lie, and some hundred numbers a round reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import dense_index
from ..session import stage, unstage
from .stats import SHARES, with_stats

#: Documents labelled 1 that each document labelled 0 is paired with.
RIVALS = 8


@dataclass(frozen=True)
class Scores:
    """score = sigmoid(weights . (log statistics - means) / spreads - cut + logit(threshold))."""

    means: tuple[float, ...]
    spreads: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float
    threshold: float

    def column(self) -> Column:
        s = F.lit(float(np.log(self.threshold / (1 - self.threshold)) - self.cut))
        for name, m, d, w in zip(SHARES, self.means, self.spreads, self.weights):
            s = s + (_shaped(name) - F.lit(m)) * F.lit(w / d)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), s))))


def _shaped(name: str) -> Column:
    """Shares by their order of size: 1% of symbols says more than the step from 50% to 51%."""
    return F.log1p(F.col(name) * 100)


def _pair_sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What pairs (differences d) add to the gradient and to the curvature of the loss at w."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # chance given to the wrong order
    return d.T @ p, (d * (p * (1 - p))[:, None]).T @ d


def _descend(sums, size: int, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of least loss by Newton steps; sums(w) are _pair_sums() over all pairs."""
    w = np.zeros(size)
    for _ in range(rounds):
        pull, bend = sums(w)
        move = np.linalg.solve(bend + ridge * np.eye(size), ridge * w - pull)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, threshold: float, rounds: int = 30, ridge: float = 1.0) -> Scores:
    """learned() over rows in memory, in their order. Without rows of both kinds every score is one half over the
    threshold's odds: nothing is rejected."""
    means, spreads = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(SHARES)), np.ones(len(SHARES)))
    spreads = np.where(spreads > 1e-9, spreads, 1.0)
    z, w = (x - means) / spreads, np.zeros(len(SHARES))
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Scores(tuple(means), tuple(spreads), tuple(w), -1.0, threshold)
    step = max(1, len(up) // RIVALS)
    rival = (np.arange(len(down))[:, None] + np.arange(min(RIVALS, len(up))) * step) % len(up)
    d = (z[up[rival]] - z[down][:, None]).reshape(-1, z.shape[1])
    w = _descend(lambda v: _pair_sums(d, v), len(SHARES), rounds, ridge)
    s = np.sort(z @ w)
    k = min(max(len(down), 1), len(s) - 1)
    return Scores(tuple(map(float, means)), tuple(map(float, spreads)), tuple(map(float, w)), float((s[k - 1] + s[k]) / 2), threshold)


def _ranked_values(values: DataFrame, ranks: list[int], few: int = 10_000) -> list[float]:
    """The values of column `s` at 0-based ranks: counts over ever finer bins, until a bin is small enough to look at."""
    out = []
    for rank in ranks:
        lo, hi = values.agg(F.min("s"), F.max("s")).first()
        inside, before = values, 0
        while True:
            n = inside.count()
            width = (hi - lo) / 1000
            if n <= few or width <= 0 or lo + width == lo:
                near = inside.groupBy("s").agg(F.count(F.lit(1)).alias("n")).orderBy("s").collect()
                for r in near:
                    before += r.n
                    if before > rank:
                        out.append(r.s)
                        break
                break
            bin_ = F.least(F.lit(999), F.floor((F.col("s") - lo) / width)).cast("int")
            for r in inside.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("b").collect():
                if before + r.n > rank:
                    break
                before += r.n
            lo, hi = r.lo, r.hi
            inside = values.where((F.col("s") >= lo) & (F.col("s") <= hi))
    return out


def learned(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> Scores:
    """Scores learned from all labelled rows but those whose crc32 of the id leaves 0 by 5. Only the text is looked at;
    texts stay where they are read, and nine numbers of each go to the labels."""
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__text"))
    return learned_from(with_stats(own, "__text", ["__id"]), labels, threshold)


def learned_from(measured: DataFrame, labels: DataFrame, threshold: float = 0.3) -> Scores:
    """learned() from rows (__id, SHARES)."""
    own = labels.select(F.col("doc_id").cast("long").alias("__id"), "quality").where("quality is not null and __id is not null")
    own = own.where(F.crc32(F.col("__id").cast("string")) % 5 != 0).groupBy("__id").agg((F.min("quality") == 1).alias("good"))
    known = stage(measured.select("__id", *(_shaped(n).alias(n) for n in SHARES)).join(own, "__id"))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("up"), *(F.avg(n).alias(f"m_{n}") for n in SHARES),
                      *(F.stddev_pop(n).alias(f"s_{n}") for n in SHARES)).first()
    # rounded, so that the order in which Spark adds up does not show
    means = np.round([total[f"m_{n}"] or 0.0 for n in SHARES], 9)
    spreads = np.round([total[f"s_{n}"] if total.n else 1.0 for n in SHARES], 9)
    spreads = np.where(spreads > 1e-9, spreads, 1.0)
    plain = lambda x: tuple(map(float, x))
    ups, downs = total.up, total.n - total.up
    if not ups or not downs:
        return Scores(plain(means), plain(spreads), (0.0,) * len(SHARES), -1.0, threshold)
    z = F.array(*((F.col(n) - F.lit(float(m))) / F.lit(float(d)) for n, m, d in zip(SHARES, means, spreads)))
    order = F.xxhash64("__id")
    placed = dense_index(known.select("good", order.alias("h"), "__id", z.alias("z")), ["good"], ["h", "__id"],
                         F.shiftright("h", 48), "place", chunk=4096)
    placed = stage(placed.select("good", "place", "z"))
    rivals = F.sequence(F.lit(0), F.lit(min(RIVALS, ups) - 1))
    at = F.transform(rivals, lambda i: F.pmod(F.col("place") + i * max(1, ups // RIVALS), F.lit(ups)).cast("bigint"))
    down = placed.where(~F.col("good")).select(F.col("z").alias("y"), F.explode(at).alias("place"))
    pairs = stage(down.join(placed.where("good").select("place", "z"), "place").select(F.zip_with("z", "y", lambda a, b: a - b).alias("d")))
    size = len(SHARES)

    def sums(w):
        def part(batches):
            pull, bend = np.zeros(size), np.zeros((size, size))
            for pdf in batches:
                if len(pdf):
                    p, b = _pair_sums(np.stack(pdf["d"].to_numpy()), w)
                    pull, bend = pull + p, bend + b
            yield pd.DataFrame({"i": range(size + size * size), "v": np.concatenate([pull, bend.ravel()])})

        rows = pairs.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        v = np.array([r.v for r in rows])
        return v[:size], v[size:].reshape(size, size)

    w = np.round(_descend(sums, size), 9)
    s = F.lit(0.0)
    for i, x in enumerate(w):
        s = s + F.get("z", F.lit(i)) * F.lit(float(x))
    k = min(max(downs, 1), total.n - 1)
    low, high = _ranked_values(placed.select(s.alias("s")), [k - 1, k])
    unstage(known, placed, pairs)
    return Scores(plain(means), plain(spreads), plain(w), float((low + high) / 2), threshold)


def score(docs: DataFrame, scores: Scores, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: a score of 0 to 1 of its whole text, and 1 where it reaches
    the threshold. A null text counts as empty and has a score too; a null doc_id is not held out. Rows are scored
    each by itself; other columns are not read."""
    own = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    return score_of(with_stats(own, "__text", ["__id"]), scores)


def score_of(measured: DataFrame, scores: Scores) -> DataFrame:
    """score() of rows (__id, SHARES)."""
    known = measured.select(F.col("__id").alias("doc_id"), scores.column().alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return known.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= scores.threshold).cast("int").alias("predicted"))
