"""Verdicts on URLs: rules by host and path, and gradient-boosted trees on lexical features where no rule fits.

The trees learn from the URLs that the rules decide. Features are binned; each level of a tree reads sums of gradients
by node, feature and bin, so only a few hundred numbers reach the driver. Gradients are summed as whole millionths, so
that reruns agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage
from .stats import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "path_depth", "path_length", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "suffix_rate"]
#: Labelled URLs to learn from, at most.
SAMPLE = 20_000
BINS, TREES, RATE, RIDGE = 32, 12, 0.4, 1.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    def __str__(self):
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    cut = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(cut(1), UPPER, LOWER), cut(2)


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<rule, block>; null if none does."""
    out = F.lit(None).cast("struct<rule: string, block: boolean>")
    for r in sorted(rules, key=lambda r: len(str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(str(r)).alias("rule"), F.lit(r.block).alias("block"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters of a text, in bits."""

    def of(chars):
        n = F.size(chars)
        counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
        return F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(let(F.split(text, ""), of))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds all FEATURES but suffix_rate, and `suffix`, to rows with url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda text, p: F.regexp_count(text, F.lit(p)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns({
        "url_length": F.length(url).cast("double"), "path_depth": count(F.col("path"), "/"), "path_length": F.length("path").cast("double"),
        "digit_ratio": F.coalesce(F.try_divide(count(url, "[0-9]"), F.length(url).cast("double")), F.lit(0.0)),
        "entropy": F.round(_entropy(url), 9), "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "labels": F.when(F.col("host") == "", 0.0).otherwise(count(F.col("host"), r"\.") + 1), "hyphens": count(url, "[-_]"),
        "suffix": F.substring_index("host", ".", -1),
    })


@dataclass(frozen=True)
class Model:
    """Score (log odds of block) = base + sum of trees over the features; `rates` has the suffix statistics."""

    base: float
    trees: tuple
    rates: DataFrame
    rate: float

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds `score` to rows of lexical(); the suffix table has a row for each suffix of the sample at most."""
        known = rows.join(F.broadcast(self.rates), "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(self.rate)))
        return known.withColumn("score", _sum(self.base, self.trees, F.col))


def _sum(base, trees, at) -> Column:
    out = F.lit(float(base))
    for t in trees:
        out = out + _tree(t, at)
    return out


def _tree(node, at) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    name, cut, below, above = node
    return F.when(at(name) >= cut, _tree(above, at)).otherwise(_tree(below, at))


def learn(rows: DataFrame) -> Model:
    """Trees from rows of lexical() with `block` (boolean) and `suffix`. Without rows of both kinds there are no trees,
    and the score is the log odds of the part that blocks, with one row of either kind added."""
    counts = rows.agg(F.count("*"), F.sum(F.col("block").cast("long"))).first()
    n, up = counts[0], counts[1] or 0
    rate = (up + 1) / (n + 2)
    by = rows.groupBy("suffix").agg(((F.sum(F.col("block").cast("double")) + 4 * rate) / (F.count("*") + 4)).alias("suffix_rate"))
    rates, base = stage(by), math.log(rate / (1 - rate))
    if not up or up == n:
        return Model(base, (), rates, rate)
    rows = rows.join(F.broadcast(rates), "suffix")
    cuts = rows.agg(*(F.percentile_approx(f, [k / BINS for k in range(BINS)], 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(cuts[f])) for f in FEATURES}
    known = stage(rows.select("block", *(_bin(F.col(f), cuts[f]).alias(f) for f in FEATURES)))
    trees = []
    for _ in range(TREES):
        score = _sum(base, trees, F.col)
        p = 1 / (1 + F.exp(-score))
        whole = lambda x: F.round(x * 1e6).cast("long")
        now = known.withColumn("g", whole(p - F.col("block").cast("double"))).withColumn("h", whole(p * (1 - p)))
        root = _split(now.withColumn("node", F.lit(0)))
        if 0 not in root:
            break
        name, cut = root[0][:2]
        below = _split(now.withColumn("node", (F.col(name) >= cut).cast("int")))
        sides = []
        for k in (0, 1):
            leaf = root[0][2 + k]
            sides.append((below[k][0], below[k][1], below[k][2], below[k][3]) if k in below else leaf)
        trees.append((name, cut, *sides))
    unstage(known)

    def real(node):
        if isinstance(node, float):
            return node
        name, b, below, above = node
        return name, float(cuts[name][b - 1]), real(below), real(above)

    return Model(base, tuple(map(real, trees)), rates, rate)


def _bin(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value))


def _split(rows: DataFrame) -> dict:
    """For each node the best (feature, bin, value below, value from there on); nodes without a gain are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES)))
    got = rows.select("node", "g", "h", pairs.alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    worth = lambda g, h: g * g / (h + RIDGE)
    value = lambda g, h: -RATE * g / (h + RIDGE)
    out = {}
    for node in sorted({r["node"] for r in got}):
        best, gain = None, 1e-3
        for f in FEATURES:
            bins = sorted((r["b"], r["g"] / 1e6, r["h"] / 1e6) for r in got if r["node"] == node and r["f"] == f)
            g_all, h_all = sum(b[1] for b in bins), sum(b[2] for b in bins)
            g = h = 0.0
            for i, (b, dg, dh) in enumerate(bins):
                if i:
                    up = worth(g, h) + worth(g_all - g, h_all - h) - worth(g_all, h_all)
                    if up > gain:
                        best, gain = (f, b, value(g, h), value(g_all - g, h_all - h)), up
                g, h = g + dg, h + dh
        if best:
            out[node] = best
    return out


def judge(pages: DataFrame, rules: list[Rule], rows: int = SAMPLE, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row: the verdict of the longest rule that fits, else block
    where the trees, learned from the distinct URLs that rules decide (`rows` of them at most, by hash), give odds of one or more.

    A null URL or one without :// has an empty host and path, fits no rule and is judged by the trees like any other.
    Repeated rows get equal verdicts; an empty table gives an empty result; other columns are not read.
    """
    host, path = parts(F.col("url"))
    known = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url")).withColumns({"host": host, "path": path})
    known = known.withColumn("hit", matched(F.col("host"), F.col("path"), rules))
    decided = known.where("hit is not null")
    # a URL counts once, however often it is repeated; twice the rows come by hash, so that enough are left to choose from
    n = decided.agg(F.approx_count_distinct("url")).first()[0]
    some = F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < F.lit(max(1, int((1 << 20) * min(1.0, 2 * rows / max(1, n)))))
    once = decided.where(some).select("url", "host", "path", F.col("hit.block").alias("block")).dropDuplicates(["url"])
    sample = stage(lexical(once.orderBy(F.xxhash64("url"), "url").limit(rows)))
    model = learn(sample)
    scored = model.scored(lexical(known))
    block = F.coalesce(F.col("hit.block"), F.col("score") >= 0)
    return scored.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.when(block, "block").otherwise("allow").alias("verdict"), "score"
    )
