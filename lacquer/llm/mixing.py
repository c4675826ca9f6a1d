"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source may be taken target / size-of-source times. The whole part is certain; the fraction is a
copy probability. Two fractions are paired and mass (probability times words) moves at random from one to the other
until one of them is 0 or 1, so the expected words of a source never change. What is left of a group is one fraction;
the fractions of groups meet again in groups, level by level, until each source has one, which is drawn. So the words
taken from a source differ from its target by less than one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import dense_index
from ..session import stage

#: Rows that are paired in one group of the tree.
GROUP = 4096
MOST_COPIES = 3


def word_count(text: str = "text"):
    """Words (runs other than space and \\t..\\r) of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: list[int]) -> DataFrame:
    """(source, source_size, target) of each source of (source, size) rows.

    Sources in code point order, null last, take the weights in turn and share all sizes by them; a target stops at
    MOST_COPIES times its source's size, and what is over is shared by weight among the others until none is above.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by = stage(by.withColumn("one", F.lit(1)))
    ranked = by.join(_ranks(by), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    ranked = stage(ranked.select("source", "source_size", "n_docs", w.cast("long").alias("w")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, -1
    while True:
        # sources that would pass their stop at this level of words for a unit of weight are full
        over = F.lit(False) if level is None else (MOST_COPIES * F.col("source_size") < level * F.col("w"))
        r = ranked.agg(
            F.sum(F.when(over, MOST_COPIES * F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("w"))),
            F.sum(over.cast("int")),
        ).first()
        if not r[1] or r[2] == full:
            break
        full, level = r[2], (total - r[0]) / r[1]
    level = F.lit(float(level or 0))
    return ranked.select(
        "source", "source_size", "n_docs",
        F.least(level * F.col("w"), (MOST_COPIES * F.col("source_size")).cast("double")).alias("target"),
    )


def _ranks(by: DataFrame) -> DataFrame:
    named = by.where("source is not null").select("one", "source")
    known = dense_index(named, ["one"], ["source"], F.substring("source", 1, 1), "place")
    rest = by.where("source is null").select(F.col("source").alias("s"), F.lit(named.count()).cast("long").alias("place"))
    return known.select(F.col("source").alias("s"), "place").union(rest)


def pivot(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> int:
    """Round fractions in place, pairing a running one with each next; returns the index left fractional, or -1.

    With masses a and b moving t words from one to the other keeps p_a * size_a + p_b * size_b; the two farthest
    moves are drawn with chances that keep both expectations.
    """
    run = -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if run < 0:
            run = i
            continue
        up = min((1 - p[run]) * size[run], p[i] * size[i])
        down = min(p[run] * size[run], (1 - p[i]) * size[i])
        to_run = draws[i] * (up + down) < down
        move = up if to_run else -down
        a, b = p[run] + move / size[run], p[i] - move / size[i]
        # the bound that was reached is exact; the other stays inside
        first = ((1 - p[run]) * size[run] <= p[i] * size[i]) if to_run else (p[run] * size[run] <= (1 - p[i]) * size[i])
        if first:
            p[run], p[i] = (1.0 if to_run else 0.0), min(max(b, 0.0), 1.0)
            run = i if 0 < p[i] < 1 else -1
        else:
            p[i], p[run] = (0.0 if to_run else 1.0), min(max(a, 0.0), 1.0)
            run = run if 0 < p[run] < 1 else -1
    return run


def _level(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the tree: rows of a (source, part) group rounded; the one left over has `open` set."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        order = np.lexsort((t["size"].to_numpy(), t["h"].to_numpy()))
        p, size = t["p"].to_numpy()[order].copy(), t["size"].to_numpy()[order].astype(float)
        draws = (t["draw"].to_numpy()[order].view(np.uint64) >> np.uint64(11)).astype(float) / 2**53
        left = pivot(p, size, draws)
        back = np.empty(len(p))
        back[order] = p
        opened = np.zeros(len(p), bool)
        if left >= 0:
            opened[order[left]] = True
        t = t.set_column(t.schema.get_field_index("p"), "p", pa.array(back)).append_column("open", pa.array(opened))
        yield from t.drop_columns(["part", "draw"]).to_batches()

    dealt = rows.withColumn("h", F.xxhash64("id", "tie", "nth", F.lit(seed + level)))
    # rows stand in the order of h, so the draws are of another hash: h itself would rise along them
    dealt = dealt.withColumn("draw", F.xxhash64(F.lit("draw"), "id", "tie", "nth", F.lit(seed + level)))
    dealt = dealt.withColumn("part", F.pmod(F.shiftright("h", 7), F.col("parts")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema if f.name not in ("part", "draw"))
    return dealt.groupBy("sx", "part").applyInArrow(run, kinds + ", open boolean").drop("h")


def _rounded(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (sx, id, tie, nth, size, p, parts, ...) with p rounded to 0 or 1, by levels; `parts` is the groups of the
    source at the first level."""
    done, level = [], 0
    while True:
        most = rows.agg(F.max("parts")).first()[0]
        if most is None:
            break
        out = stage(_level(rows, level, seed))
        done.append(out.where("not open"))
        rest = out.where("open").drop("open")
        if most == 1:
            # one fraction a source: drawn
            h = F.xxhash64("id", "tie", "nth", F.lit(seed - 1))
            chance = F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
            done.append(rest.withColumn("p", F.when(chance < F.col("p"), 1.0).otherwise(0.0)).withColumn("open", F.lit(False)))
            break
        rows, level = rest.withColumn("parts", F.ceil(F.col("parts") / GROUP).cast("long")), level + 1
    if not done:
        return rows.withColumn("open", F.lit(False))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix(docs: DataFrame, weights: list[int], seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, tie, source, size, source_size, target, copies, taken) of every row of `docs`; taken = copies * size.

    `size` is the words of the text (null: 0). See targets() for the targets; a null source is a source, and null and
    empty names differ. Copies are 0 to MOST_COPIES; a document without words is taken 0 times. The same input gives
    the same result: draws come from a hash of doc_id, text and `seed`. Rows equal in doc_id, source and text are
    told apart by number, which of them is taken more often is the same for both. An empty table gives an empty
    result; other columns are not read. `tie` is the xxhash64 of the text.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("tie"),
        F.col(f"`{source}`").cast("string").alias("source"), word_count(f"`{text}`").alias("size"),
    )
    rows = stage(rows.groupBy("id", "tie", "source", "size").agg(F.count("*").alias("times")))
    rows = rows.select("id", "tie", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
    goal = stage(targets(rows.select("source", "size"), weights))
    # a source's name may be long: its number stands for it below
    goal = goal.withColumn("sx", F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()))
    known = rows.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    each = F.when(F.col("size") > 0, each).otherwise(F.lit(0.0))
    known = stage(known.withColumn("sure", F.floor(each).cast("long")).withColumn("p", each - F.floor(each)))
    loose = known.where("p > 0 and p < 1").withColumn("parts", F.ceil(F.col("n_docs") / GROUP).cast("long"))
    fixed = known.where("not (p > 0 and p < 1)").withColumn("p", F.lit(0.0))
    names = ["id", "tie", "nth", "source", "size", "source_size", "target", "sure", "p"]
    out = _rounded(loose, seed).select(names).unionByName(fixed.select(names))
    copies = F.col("sure") + F.col("p").cast("long")
    return out.select(
        F.col("id").alias("doc_id"), "tie", "nth", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
