"""Connected components of link tables, by rounds of joins; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of (a, b) links the least node it reaches. Self links and repeats do nothing.

    Large-star and small-star rounds: each node hands its larger, then its smaller neighbours to the least one it
    sees, until nothing changes; a chain of n nodes takes about log n rounds. Every round is a written table.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    told = _told(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, True)
        new = stage(_star(large, False).distinct())
        now = _told(new)
        unstage(edges)
        edges = new
        if now == told:
            break
        told = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
    joined = edges.join(least, edges["a"] == least["u"])
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    )


def _told(edges: DataFrame):
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))), F.sum(F.shiftrightunsigned(h, 24))).first())
