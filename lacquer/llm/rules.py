"""Decision lists for text quality, learned by sequential covering.

A rule is a conjunction of thresholds on statistics. It grows on two thirds of the labelled rows by the threshold with
most information gain, is pruned on the last third, and takes the rows it covers away from the next rule. Every step
reads counts by statistic and bin, some hundred numbers. The list becomes one ordered Spark expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage
from .stats import SHARES, labelled_sample, with_stats

BINS = 64
LONGEST = 4
#: Of the pruning rows that a rule covers, the least part that must be labelled 0.
PRECISION = 0.9
#: Labelled rows to learn from, at most.
SAMPLE = 20_000


@dataclass(frozen=True)
class Rule:
    """All of (statistic, at_least, threshold): statistic >= threshold, or < where at_least is false."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_least, cut in self.tests:
            out = out & (F.col(name) >= cut if at_least else F.col(name) < cut)
        return out

    def __str__(self):
        return " and ".join(f"{n} {'>=' if a else '<'} {c:.6g}" for n, a, c in self.tests)


def verdict(rules: list[Rule]) -> Column:
    """True (keep) unless a rule applies: the first that does decides."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), False)
    for r in rules[1:]:
        out = out.when(r.column(), False)
    return out.otherwise(True)


def learn(rows: DataFrame, names: list[str] = SHARES) -> list[Rule]:
    """Rules that tell `bad` rows (boolean) from the others; `rows` also needs a stable long `id`. Without rows of
    both kinds the list is empty. It ends where no rule gains, and it does end: every rule covers rows of its own."""
    cuts = rows.agg(*(F.percentile_approx(n, [k / BINS for k in range(1, BINS)], 10_000).alias(n) for n in names)).first()
    cuts = {n: sorted(set(cuts[n] or [])) for n in names}
    low = {n: _bin(F.col(n), cuts[n]) for n in names}
    known = stage(rows.select("bad", (F.pmod(F.xxhash64("id", F.lit(17)), F.lit(3)) < 2).alias("grow"), *(low[n].alias(n) for n in names)))
    left, rules = F.lit(True), []
    while True:
        tests: list[tuple[str, bool, int]] = []
        while len(tests) < LONGEST:
            best = _best(known.where("grow").where(left & _all(tests)), names)
            if best is None:
                break
            tests.append(best)
        if not tests:
            break
        sums = [c for k in range(1, len(tests) + 1) for c in (_n(_all(tests[:k]) & F.col("bad")), _n(_all(tests[:k]) & ~F.col("bad")))]
        got = known.where("not grow").where(left).agg(*(c.alias(f"c{i}") for i, c in enumerate(sums))).first()
        got = [((got[2 * k] or 0), (got[2 * k + 1] or 0)) for k in range(len(tests))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in got]
        k = max(range(len(tests)), key=lambda i: (worth[i], got[i][0], -i))
        p, n = got[k]
        if p == 0 or p / (p + n) < PRECISION:
            break
        rules.append(Rule(tuple((name, at_least, float(cuts[name][b - 1])) for name, at_least, b in tests[: k + 1])))
        left = left & ~_all(tests[: k + 1])
    unstage(known)
    return rules


def _bin(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value)) if cuts else F.lit(0)


def _n(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def _all(tests) -> Column:
    out = F.lit(True)
    for name, at_least, b in tests:
        out = out & (F.col(name) >= b if at_least else F.col(name) < b)
    return out


def _best(rows: DataFrame, names: list[str]):
    """The threshold with most FOIL gain on these rows, as (statistic, at_least, bin); None where none gains."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names)))
    got = rows.select("bad", pairs.alias("x")).groupBy("x.name", "x.bin").agg(_n(F.col("bad")).alias("p"), _n(~F.col("bad")).alias("n")).collect()
    best, gain = None, 1e-9
    for name in names:
        bins = sorted((r["bin"], r["p"], r["n"]) for r in got if r["name"] == name)
        all_p, all_n = sum(b[1] for b in bins), sum(b[2] for b in bins)
        if not all_p or not all_n:
            return None
        p = n = 0
        for i, (b, dp, dn) in enumerate(bins):
            if i:
                for at_least, cp, cn in ((True, all_p - p, all_n - n), (False, p, n)):
                    if cp:
                        g = cp * (math.log2(cp / (cp + cn)) - math.log2(all_p / (all_p + all_n)))
                        if g > gain:
                            best, gain = (name, at_least, b), g
            p, n = p + dp, n + dn
    return best


def learned(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> list[Rule]:
    """Rules from the labelled rows of `docs`; labels.quality 0 is bad. Learns from `rows` rows at most, and never from
    those whose crc32 of the id leaves 0 by 5."""
    sample = F.broadcast(labelled_sample(labels.select(F.col("doc_id").cast("long").alias("__id"), "quality"), rows, "__id"))
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__text"))
    known = with_stats(own.join(sample, "__id"), "__text", ["__id", "quality"])
    known = stage(known.select(F.col("__id").alias("id"), (F.col("quality") == 0).alias("bad"), *SHARES))
    out = learn(known)
    unstage(known)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row: kept is
    false where the base rules fail, else what the list says.

    Rows are judged each by itself, so repeated rows get equal verdicts and an empty table an empty result; a null
    text counts as empty and fails the base rules. Other columns are not read.
    """
    known = with_stats(docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text")), "__text", ["__id"])
    return known.select(
        F.col("__id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"),
    )


def kept_rows(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, that judge() keeps."""
    mine = [f"__c{i}" for i in range(len(docs.columns))]
    known = with_stats(docs.toDF(*mine), mine[docs.columns.index(text)], mine)
    return known.where(~base_failed() & verdict(rules)).select(mine).toDF(*docs.columns)
