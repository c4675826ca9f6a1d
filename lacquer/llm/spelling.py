"""Spelling variants by a relational trie: states move from node to node by joins with the table of its edges.

The words are the paths of a trie whose chains without branches are one edge, so a level of the walk is a branching
and not a character. A state is (word, position, node, edits). A word walks its own path without edits; where another
edge leaves the path the states that spend the one edit there go on alone and have to match to the end. Two words one
edit apart part in one node only, where the edit can be taken at the first difference, so a walk finds each pair once.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage

RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Signs before words that are walked as they are, and reversed.
_AHEAD, _BACK = "\u0001", "\u0002"
#: Copies of the edges of the first levels, over which the states of a node there are dealt.
SALTS = 16


def corpus_words(docs: DataFrame, key: str = "doc_id", text: str = "text", garble: int = 97, least: int = 5, seen: int = 3) -> DataFrame:
    """(word, n): the runs of letters of all whole texts that are counted as words, with their number.

    A-Z are lower-cased. Where `garble` divides the crc32 of `<key>:<run>` the run loses the code point that the crc32
    modulo its length names; `garble` 0 leaves all as they are. Words have `least` code points and `seen` occurrences
    or more. A null text has no runs, a null key counts as the empty text, repeated rows count again, and an empty
    table gives no words. Columns other than the two are not read.
    """
    runs = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"),
        F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text}`"), _UPPER, _LOWER), F.lit(f"({RUN})"))).alias("w"))
    if garble:
        runs = runs.select("w", F.crc32(F.concat("k", F.lit(":"), "w").cast("binary")).alias("h")).select(
            F.when(F.col("h") % garble == 0, F.expr("concat(substr(w, 1, cast(h % length(w) as int)), substr(w, cast(h % length(w) as int) + 2))"))
            .otherwise(F.col("w")).alias("w"))
    return runs.where(F.length("w") >= least).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def _common(a: Column, b: Column) -> Column:
    """The longest common prefix of two texts; that of null is empty."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([os.path.commonprefix([p or "", q]) for p, q in zip(a, b)])

    return run(a, b)


def _after(texts: DataFrame) -> DataFrame:
    """(x, before): each of the distinct texts and the one that precedes it in code-point order.

    Ranges of a sampled order are sorted each by itself; the first of a range takes the greatest of the last range
    before it, of which there is one row a range.
    """
    from pyspark.sql import Window

    placed = stage(texts.repartitionByRange("x").select("x", F.spark_partition_id().alias("p")))
    tops = placed.groupBy("p").agg(F.max("x").alias("top"))
    tops = tops.select("p", F.lag("top").over(Window.orderBy("p")).alias("top"))
    lag = F.lag("x").over(Window.partitionBy("p").orderBy("x"))
    out = stage(placed.select("x", "p", lag.alias("b")).join(tops, "p").select("x", F.coalesce("b", "top").alias("before")))
    unstage(placed)
    return out


def trie(words: DataFrame) -> DataFrame:
    """(parent, label, node, ends): the edges of the trie of distinct `word`s; nodes are named by their path from the
    root, which is the empty text, and `ends` says whether the path is a word. Empty words are left out."""
    words = words.where("word <> ''").select(F.col("word").alias("x"))
    after = _after(words)
    forks = after.select(_common("before", "x").alias("x"))
    nodes = words.withColumn("e", F.lit(1)).union(forks.withColumn("e", F.lit(0))).groupBy("x").agg(F.max("e").alias("e"))
    nodes = stage(nodes.where("x <> ''"))
    before = _after(nodes.select("x"))
    edges = before.select(_common("before", "x").alias("parent"), F.col("x").alias("node")).join(
        nodes.select(F.col("x").alias("node"), (F.col("e") == 1).alias("ends")), "node")
    out = stage(edges.select("parent", F.expr("substr(node, length(parent) + 1)").alias("label"), "node", "ends"))
    unstage(after, nodes, before)
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): each ordered pair of distinct `word`s that differ by one inserted, deleted or replaced code point.

    Two words one edit apart share the first half of the one or its last half. So every word walks twice, as it is and
    reversed, a sign before it telling which, and spends the edit only behind its half, where the trie has few branches.
    """
    words = words.where("word <> ''").select("word")
    half = F.expr("cast(floor(length(word) / 2) as int)")
    both = F.inline(F.array(
        F.struct(F.concat(F.lit(_AHEAD), "word").alias("word"), (half + 1).alias("spend")),
        F.struct(F.concat(F.lit(_BACK), F.reverse("word")).alias("word"), (F.length("word") - half + 1).alias("spend"))))
    found = _walk(words.select(both)).select(
        F.left("word", F.lit(1)).alias("sign"), F.expr("substr(word, 2)").alias("word"), F.expr("substr(near, 2)").alias("near"))
    ahead = found.where(F.col("sign") == _AHEAD).select("word", "near")
    back = found.where(F.col("sign") == _BACK).select(F.reverse("word").alias("word"), F.reverse("near").alias("near"))
    return ahead.union(back.where(F.left("word", half) != F.left("near", half)))


def _walk(words: DataFrame) -> DataFrame:
    """(word, near) of distinct (word, spend) whose words part at the code point `spend` of the word or behind it.

    Every round takes all states over one edge of the trie; the rounds end when no state is left, after as many as the
    most branchings on a path. A state is kept only if its node is an end for it or has an edge to go on with.
    """
    edges = stage(_looking_ahead(trie(words.select("word"))))
    states = stage(words.select(
        "word", "spend", F.lit(0).alias("at"), F.lit("").alias("node"), F.lit(0).alias("edits"), F.lit(False).alias("ends")))
    found: list[DataFrame] = []
    while not states.isEmpty():
        moved = stage(_step(states, edges))
        unstage(states)
        found.append(stage(_reached(moved)))
        states = moved
    unstage(states, edges)
    whole = words.select("word", F.col("word").alias("near")).limit(0)
    for x in found:
        whole = whole.union(x)
    return whole


def _looking_ahead(edges: DataFrame) -> DataFrame:
    """The edges with their first code point, and with those of the edges that follow (at most an alphabet), in one text."""
    first = F.left("label", F.lit(1))
    on = edges.groupBy(F.col("parent").alias("node")).agg(F.array_join(F.collect_list(first), "").alias("on"))
    return edges.join(on, "node", "left").select("parent", "label", first.alias("first"), "node", "ends", F.coalesce("on", F.lit("")).alias("on"))


def _reached(states: DataFrame) -> DataFrame:
    """Terminal states with one edit: at a word's node at their own end, or one code point before it with the edit left."""
    end = ((F.col("edits") == 1) & (F.col("at") == F.length("word"))) | (
        (F.col("edits") == 0) & (F.col("at") == F.length("word") - 1))
    return states.where(F.col("ends") & end).select("word", F.col("node").alias("near"))


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """All states one edge further: those that may spend the edit at their place over every edge of their node, the
    others over the one edge that begins as they go on. `rest` is what a state has still to match. Nodes near the root
    hold states of most words, so the few edges there are copied and the states dealt over the copies."""
    rest = F.expr("substr(word, at + 1)")
    here = states.select("word", "spend", "at", "edits", F.col("node").alias("parent"), rest.alias("rest"))
    shallow = F.length("parent") <= 2
    salt = F.when(shallow, F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)).alias("salt")
    copied = edges.select("*", F.explode(F.sequence(F.lit(0), F.when(shallow, F.lit(SALTS - 1)).otherwise(F.lit(0)))).alias("salt"))
    size = F.length("label")
    may = (F.col("edits") == 0) & (F.col("at") >= F.col("spend"))

    bound = here.where(~may).select("*", F.left("rest", F.lit(1)).alias("first"), salt)
    bound = bound.join(copied, ["parent", "first", "salt"]).where("startswith(rest, label)").select(
        "word", "spend", (F.col("at") + size).alias("at"), "node", "edits", "ends", "on")

    free = here.where(may).select("*", salt).join(copied, ["parent", "salt"])
    leaves = F.expr("first <> left(rest, 1)")
    go = lambda when, by, edits: F.when(when, F.struct((F.col("at") + by).alias("at"), F.lit(edits).alias("edits")))
    steps = F.array_compact(F.array(
        go(F.expr("startswith(rest, label)"), size, 0),
        go(leaves & F.expr("rest <> '' and startswith(substr(rest, 2), substr(label, 2))"), size, 1),
        go(leaves & F.expr("rest <> '' and startswith(substr(rest, 2), label)"), size + 1, 1),
        go(leaves & F.expr("startswith(rest, substr(label, 2))"), size - 1, 1)))
    free = free.select("word", "spend", "node", "ends", "on", F.explode(steps).alias("s")).select(
        "word", "spend", "s.at", "node", "s.edits", "ends", "on")

    end = F.col("at") == F.length("word")
    alive = (F.col("edits") == 0) | (end & F.col("ends")) | (~end & F.contains("on", F.expr("substr(word, at + 1, 1)")))
    return free.union(bound.select(free.columns)).where(alive).drop("on")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n).

    The form is the near word with the largest n, ties to the least in code-point order, if that n is at least twice
    the word's own; the root is where the forms lead, the word itself without one. Since n doubles at each step, roots
    are found by pointer jumping in rounds that grow with the logarithm of the number of steps.
    """
    words = stage(words)
    pairs = stage(neighbours(words.select("word")))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word").agg(
        F.count("*").alias("n_near"), best.alias("b"))
    taken = F.coalesce(-F.col("b.m") >= 2 * F.col("n"), F.lit(False))
    out = stage(words.join(near, "word", "left").select(
        "word", F.when(taken, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(taken, -F.col("b.m")).alias("form_n")))
    unstage(pairs)
    jumps = stage(out.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stage(jumps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        unstage(jumps)
        jumps = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return out.join(jumps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
