"""Removal of lines that spread over many sites.

The distinct sites of a line are estimated by HyperLogLog sketches that merge by aggregation. Lines whose estimate is
near the threshold are counted exactly; the others are decided by the estimate. A line decided as boilerplate goes
from every document that has a line of its own; texts of nothing but such lines stay for near-duplicate removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage

#: Sketches of 2^LG cells have a relative error of about 1.04 / 2^(LG / 2); MARGIN is over five times that.
LG = 11
MARGIN = 0.12


def _line(x: Column) -> Column:
    """What is compared: the line without white space around it."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def _key(x: Column) -> Column:
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"))


def _narrow(docs: DataFrame, doc_id: str | None, text: str, site: str) -> DataFrame:
    """(id, tie, site, a, b): one row for each distinct line of a text, written once; lines are 128-bit hashes, blank
    ones have no row. `tie` is the xxhash64 of the text."""
    own = F.col(f"`{doc_id}`") if doc_id else F.lit(None).cast("long")
    lines = docs.where(F.col(f"`{text}`").isNotNull()).select(
        own.alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("\u0000")).alias("site"),
        F.explode(F.array_distinct(F.transform(F.split(F.col(f"`{text}`"), "\n"), _line))).alias("line"),
    )
    return stage(lines.where("line <> ''").select("id", "tie", "site", _key(F.col("line")).alias("k")).select("id", "tie", "site", "k.a", "k.b"))


#: A line with this part of all rows or more is hot; there are at most as many such lines as this says.
HOT = 1000


class _Hot:
    """Joins of the lines with some of their keys in which no key's rows meet in one task.

    Lines that hold a HOT-th of the rows or more are at most HOT, whatever the table's size, so theirs is a broadcast
    join; the other lines are shuffled by their key.
    """

    def __init__(self, lines: DataFrame):
        self.lines = lines
        counts = lines.groupBy("a", "b").agg(F.count("*").alias("n"))
        self.often = stage(counts.where("n > 1"))
        least = F.greatest(F.lit(2), F.ceil(F.lit(lines.count() / HOT)))
        self.hot = F.broadcast(self.often.where(F.col("n") >= least).select("a", "b"))

    def join(self, keys: DataFrame) -> DataFrame:
        """The lines whose (a, b) is in `keys`, which holds each once."""
        few = F.broadcast(keys.join(self.hot, ["a", "b"], "left_semi"))
        rest = self.lines.join(self.hot, ["a", "b"], "left_anti")
        return self.lines.join(few, ["a", "b"], "left_semi").union(
            rest.join(keys.join(self.hot, ["a", "b"], "left_anti"), ["a", "b"], "left_semi"))


def _spread(hot: _Hot, sites: int) -> DataFrame:
    """(a, b) of the lines on `sites` or more distinct sites. A line in fewer documents than that needs no sketch."""
    often = hot.often.where(F.col("n") >= sites).select("a", "b")
    known = stage(
        hot.join(often).groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(LG)).alias("s"))
        .select("a", "b", F.hll_sketch_estimate("s").alias("about")).where(F.col("about") >= sites * (1 - MARGIN))
    )
    sure = known.where(F.col("about") > sites * (1 + MARGIN)).select("a", "b")
    near = known.where(F.col("about") <= sites * (1 + MARGIN)).select("a", "b")
    exact = (
        hot.join(near).groupBy("a", "b", "site").agg(F.lit(1).alias("one"))
        .groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("a", "b")
    )
    out = stage(sure.union(exact))
    unstage(known)
    return out


def spread_lines(docs: DataFrame, sites: int, text: str = "text", site: str = "source") -> DataFrame:
    """(a, b): 128-bit hashes of the lines that are on `sites` or more distinct sites. Blank lines have none; a null
    site is one site."""
    return _spread(_Hot(_narrow(docs, None, text, site)), sites)


def remove_spread(
    docs: DataFrame, sites: int = 10, doc_id: str = "doc_id", text: str = "text", site: str = "source",
    counts: tuple[str, str] = ("__lines", "__removed"),
) -> DataFrame:
    """All columns of `docs` with boilerplate lines taken out of the text, and two counts (long) named by `counts`:
    of lines and of removed ones.

    A line is boilerplate when it is on `sites` or more distinct sites; lines are compared without white space around
    them. It goes from every document that has a line of its own; a text all of whose lines are boilerplate stays as it
    is: there is nothing around which they stand. A null or blank text is left as it is (no lines). Rows that repeat a
    doc_id are cleaned each by its own text; an empty table gives an empty result. Other columns pass through, whatever
    their names; those named as the counts are replaced. Lines that stay are joined by \\n as they were.
    """
    found = _narrow(docs, doc_id, text, site)
    hot = _Hot(found)
    bad = _spread(hot, sites)
    kept = [c for c in docs.columns if c not in counts]
    mine = [f"c{i}" for i in range(len(kept))]
    body = mine[kept.index(text)]
    rows = docs.select(*(F.col(f"`{c}`").alias(m) for c, m in zip(kept, mine))).withColumn("mytie", F.xxhash64(body))
    hits = stage(hot.join(bad).groupBy("id", "tie").agg(F.collect_set("a").alias("hit")))
    unstage(found, hot.often, bad)
    met = rows.join(
        hits, F.col(mine[kept.index(doc_id)]).eqNullSafe(F.col("id")) & (F.col("mytie") == F.col("tie")), "left"
    ).select(*mine, "hit")
    split = met.withColumn("l", F.split(body, "\n"))
    # only lines of documents with a hit are looked at again
    own = F.when(F.col("hit").isNotNull(), F.filter("l", lambda x: (_line(x) == "") | ~F.array_contains(F.col("hit"), F.xxhash64(_line(x)))))
    split = split.withColumn("k", own)
    split = split.withColumn("cut", F.coalesce(F.exists("k", lambda x: _line(x) != ""), F.lit(False)))
    n = F.when(F.col(body).isNull(), 0).otherwise(F.size("l")).cast("long")
    gone = F.when(F.col("cut"), F.size("l") - F.size("k")).otherwise(0).cast("long")
    out = split.select(
        *(F.when(F.col("cut"), F.array_join("k", "\n")).otherwise(F.col(c)).alias(c) if c == body else F.col(c) for c in mine),
        n.alias("n"), gone.alias("gone"))
    return out.toDF(*kept, *counts)
