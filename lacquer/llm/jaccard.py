"""Jaccard join of word-shingle sets by signature trees.

Every set has a bitmap of its shingles. Sets that could be similar meet in a cell: they share a shingle of their
prefixes (the rarer part of a set, long enough that two similar sets cannot miss each other) and have near sizes. In a
cell a tree is built whose nodes hold OR-combined bitmaps and size ranges; a dual traversal drops node pairs whose
greatest possible overlap is too small. What is left is compared exactly. Equal sets are one class from the start, and
classes that a first round has linked through a hub are not compared with each other again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage, unstage
from . import sketch, words
from .components import components
from .substring import _slices

#: Most rows of a cell that meet in one task; larger cells are cut into parts, and every two parts meet.
CELL = 4096
FAN = 8
#: Bytes of bitmaps that a task lays side by side.
BYTES = 16_000_000
#: Bytes of text that a task describes at a time.
SLICE = 3_000_000
_SEEDS = np.arange(8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Most shingles that count as frequent: with all counts together known, only so many can reach the threshold.
FREQUENT = 2_000_000


def shingle_sets(data, offsets, width: int):
    """(text index, shingle hash) of each distinct shingle, by text and hash; a shorter text is one shingle."""
    data = words.lower(data)
    starts, ends, firsts = words.spans(data, offsets)
    h = words.hashes(data, starts, ends)
    own = words.whole(firsts, width)
    doc, token = np.searchsorted(firsts, own, "right") - 1, words.windows(h, width)[own] if len(own) else h[:0]
    count = np.diff(firsts)
    for n in range(1, width):
        few = np.flatnonzero(count == n)
        if len(few):
            token = np.r_[token, words.mix(words.windows(h, n)[firsts[few]] + np.uint64(n))]
            doc = np.r_[doc, few]
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new]


def _bounds(doc, n):
    return np.searchsorted(doc, np.arange(n + 1))


def prefix_size(n, percent: int):
    """Shingles of a set of n, of which a similar set has at least one."""
    return n - (n * percent + 99) // 100 + 1


def _describe(part, width, percent, frequent):
    """Size, digest, three least hashes, bitmap and prefix of each set of a part."""
    data, offsets = words.utf8(part.column("__text"))
    doc, token = shingle_sets(data, offsets, width)
    n_docs = len(offsets) - 1
    at = _bounds(doc, n_docs)
    n = np.diff(at)
    full = np.flatnonzero(n)
    columns = []
    for seed in (1, 2):
        d = np.zeros(n_docs, np.uint64)
        if len(full):
            d[full] = np.add.reduceat(words.mix(token + _SEEDS[seed]), at[full])
        columns.append(pa.array(words.signed(d)))
    for seed in (3, 4, 5):
        d = np.zeros(n_docs, np.uint64)
        if len(full):
            d[full] = np.minimum.reduceat(words.mix(token ^ np.uint64(seed * 0x51ED27)), at[full])
        columns.append(pa.array(words.signed(d)))
    bits = 1 << np.ceil(np.log2(np.maximum(64, 3 * n))).astype(np.int64)
    base = np.r_[0, np.cumsum(bits)]
    flags = np.zeros(int(base[-1]), np.uint8)
    flags[base[doc] + (words.mix(token).astype(np.int64) & (bits[doc] - 1))] = 1
    packed = np.packbits(flags, bitorder="little").tobytes()
    maps = pa.Array.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer((base // 8).astype(np.int32)), pa.py_buffer(packed)])
    last = frequent[np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)] == token if len(frequent) else np.zeros(len(token), bool)
    order = np.lexsort((token, last, doc))
    rank = np.arange(len(doc)) - at[doc]
    chosen = rank < prefix_size(n, percent)[doc]
    lead = token[order][chosen]
    cut = np.r_[0, np.cumsum(np.bincount(doc[chosen], minlength=n_docs))].astype(np.int32)
    prefix = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(words.signed(lead), pa.int64()))
    return pa.RecordBatch.from_arrays(
        [part.column("__id"), pa.array(n, pa.int64()), *columns, maps, prefix],
        names=["__id", "n", "d1", "d2", "m0", "m1", "m2", "bits", "prefix"],
    )


def _frequent(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles found often, from counts above one in each part of the input. They only move to the end of the order
    in which prefixes are taken, so any choice gives the same links."""

    def count(batches):
        for batch in batches:
            for part in _slices(batch, SLICE):
                _, token = shingle_sets(*words.utf8(part.column("__text")), width)
                token, n = np.unique(token, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.signed(token[n > 1])), pa.array(n[n > 1], pa.int64())], names=["token", "n"]
                )

    counts = stage(rows.select("__text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(8, total // FREQUENT + 1)
    found = counts.where(F.col("n") >= least).select("token").toArrow().column("token")
    unstage(counts)
    return np.sort(np.asarray(found.combine_chunks() if found.num_chunks else pa.array([], pa.int64())).astype(np.int64).view(np.uint64))


def _unpack(maps: list[bytes]) -> np.ndarray:
    """Bitmaps folded to the least width among them, as rows of 64-bit words."""
    least = min(map(len, maps))
    out = np.empty((len(maps), least // 8), np.uint64)
    for i, b in enumerate(maps):
        words_ = np.frombuffer(b, np.uint64)
        out[i] = words_ if len(b) == least else np.bitwise_or.reduce(words_.reshape(-1, least // 8), 0)
    return out


def _overlap(maps, x, y):
    """Greatest overlap that the bitmaps of two sets of x and y shingles leave."""
    one, two = _unpack(maps)
    both = int(np.bitwise_count(one & two).sum())
    return both + min(x - int(np.bitwise_count(one).sum()), y - int(np.bitwise_count(two).sum()))


def tree_pairs(n: np.ndarray, maps: list[bytes], percent: int, comp=None, left=None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets whose bitmaps and sizes leave the needed overlap possible.

    Nodes of a level are FAN consecutive nodes below, with OR-combined bitmaps, size range and the most shingles that
    may share bits. Members are laid out by size, those of a large component side by side. Pairs of one component, and
    pairs without a `left` member, are not wanted: nodes that can give no others are dropped too.
    """
    comp = np.arange(len(n)) if comp is None else comp
    left = np.ones(len(n), bool) if left is None else left.astype(bool)
    _, which, count = np.unique(comp, return_inverse=True, return_counts=True)
    order = np.lexsort((n, np.where(count[which] > FAN, which, -1)))
    size, bits = n[order], _unpack([maps[i] for i in order])
    spare = size - np.bitwise_count(bits).sum(1)
    levels = [(bits, size, size, spare, which[order], which[order], left[order])]
    while len(levels[-1][0]) > FAN:
        cut = np.arange(0, len(levels[-1][0]), FAN)
        ways = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum, np.logical_or)
        levels.append(tuple(f.reduceat(x, cut) for f, x in zip(ways, levels[-1])))
    i, j = np.triu_indices(len(levels[-1][0]))
    todo, found = [(len(levels) - 1, i, j)], []
    while todo:
        level, i, j = todo.pop()
        most_pairs = max(256, BYTES // (8 * bits.shape[1] * (FAN if level else 1)))
        if len(i) > most_pairs:
            todo += [(level, i[most_pairs:], j[most_pairs:])]
            i, j = i[:most_pairs], j[:most_pairs]
        b, lo, hi, ex, first, last, own = levels[level]
        keep = (100 * hi[i] >= percent * lo[j]) & (100 * hi[j] >= percent * lo[i]) & (own[i] | own[j])
        keep &= (first[i] != last[i]) | (first[j] != last[j]) | (first[i] != first[j])
        if level == 0:
            keep &= i < j
        i, j = i[keep], j[keep]
        both = np.bitwise_count(b[i] & b[j]).sum(1).astype(np.int64)
        most = np.minimum(both + np.minimum(ex[i], ex[j]), np.minimum(hi[i], hi[j]))
        keep = (100 + percent) * most >= percent * (lo[i] + lo[j])
        i, j = i[keep], j[keep]
        if level == 0:
            found.append((order[i], order[j]))
            continue
        below = len(levels[level - 1][0])
        a = np.repeat(i, FAN * FAN) * FAN + np.tile(np.repeat(np.arange(FAN), FAN), len(i))
        c = np.repeat(j, FAN * FAN) * FAN + np.tile(np.arange(FAN), FAN * len(j))
        keep = (a < below) & (c < below) & (a <= c)
        todo.append((level - 1, a[keep], c[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _cells(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b) candidates of every cell; rows of a cell stand together, a cell may span batches. A pair that meets in
    several cells comes from the least of them only: rows name the cells they are in, as `left` ones and as others."""

    def flush(rows):
        group, rep, comp, n, left, maps, lefts, others = rows
        a, b = tree_pairs(n, maps, percent, comp, left)
        here = [_least_meeting(lefts[i], others[i], lefts[j], others[j]) == group[0] for i, j in zip(a.tolist(), b.tolist())]
        here = np.array(here, bool)
        return rep[a[here]], rep[b[here]]

    def run(batches):
        held = None
        for batch in batches:
            table = held.append(batch) if isinstance(held, _Rows) else _Rows(batch)
            starts = table.starts()
            outs = [flush(table.part(lo, hi)) for lo, hi in zip(starts[:-1], starts[1:]) if hi - lo > 1]
            held = table.tail(starts[-1])
            yield _pairs(outs)
        if held is not None and len(held) > 1:
            yield _pairs([flush(held.part(0, len(held)))])

    return cells.mapInArrow(run, "a long, b long")


def _least_meeting(lefts_a, others_a, lefts_b, others_b):
    """The least cell in which two rows meet and at least one of them is a left one."""
    one, two = set(lefts_a), set(lefts_b)
    return min((one & two) | (one & set(others_b)) | (two & set(others_a)))


class _Rows:
    """Rows of cells in order, with the end of the batch before in front."""

    NAMES = ("g", "rep", "comp", "n", "left")

    def __init__(self, batch):
        self.columns = {c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in self.NAMES}
        self.maps, self.lefts, self.others = (batch.column(c).to_pylist() for c in ("bits", "lefts", "others"))

    def __len__(self):
        return len(self.maps)

    def append(self, batch):
        more = _Rows(batch)
        self.columns = {c: np.concatenate([v, more.columns[c]]) for c, v in self.columns.items()}
        self.maps, self.lefts, self.others = self.maps + more.maps, self.lefts + more.lefts, self.others + more.others
        return self

    def starts(self):
        g = self.columns["g"]
        return np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1] if len(g) else np.zeros(1, np.int64)

    def part(self, lo, hi):
        return (*(self.columns[c][lo:hi] for c in self.NAMES), self.maps[lo:hi], self.lefts[lo:hi], self.others[lo:hi])

    def tail(self, lo):
        self.columns = {c: v[lo:] for c, v in self.columns.items()}
        self.maps, self.lefts, self.others = self.maps[lo:], self.lefts[lo:], self.others[lo:]
        return self


def _pairs(outs):
    a = np.concatenate([x for x, _ in outs]) if outs else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in outs]) if outs else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], names=["a", "b"])


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, bits_a, bits_b) that sizes and bitmaps leave possible."""

    def run(batches):
        for batch in batches:
            keep = [
                (100 + percent) * min(_overlap([p, q], x, y), x, y) >= percent * (x + y)
                for x, y, p, q in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "bits_a", "bits_b")))
            ]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return pairs.where((100 * F.least("na", "nb")) >= percent * F.greatest("na", "nb")).mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar, by intersecting the sets; sets are read anew, only for documents in a pair."""
    spark = rows.sparkSession
    named = pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct()
    size = sketch.width_for(named.count())
    shared = spark.sparkContext.broadcast(sketch.members(named, size))

    def sets(batches):
        for batch in batches:
            for part in _slices(batch, SLICE):
                ids = part.column("__id")
                keys = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64)
                part = part.filter(pa.array(sketch.repeated(shared.value, keys, size)))
                doc, token = shingle_sets(*words.utf8(part.column("__text")), width)
                at = _bounds(doc, len(part)).astype(np.int32)
                full = np.diff(at) > 0
                digest = np.zeros(len(part), np.uint64)
                if full.any():
                    digest[full] = np.add.reduceat(words.mix(token + _SEEDS[1]), at[:-1][full])
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), pa.array(words.signed(digest)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(words.signed(token), pa.int64()))],
                    names=["i", "d", "set"],
                )

    known = rows.mapInArrow(sets, "i long, d long, set array<long>")
    known = stage(
        known.join(classes.select(F.col("rep").alias("i"), F.col("d1").alias("d")), ["i", "d"], "left_semi").dropDuplicates(["i"]).select("i", "set")
    )
    both = pairs.join(known.select(F.col("i").alias("a"), F.col("set").alias("x")), "a").join(
        known.select(F.col("i").alias("b"), F.col("set").alias("y")), "b"
    )
    shared_n = F.size(F.array_intersect("x", "y"))
    out = stage(
        both.select("a", "b", shared_n.alias("k"), (F.size("x") + F.size("y")).alias("s"))
        .where(100 * F.col("k") >= percent * (F.col("s") - F.col("k"))).select("a", "b")
    )
    unstage(known)
    return out


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`.

    A set holds the distinct `width`-word shingles of the text, A-Z lower-cased; a text of fewer words is one shingle,
    a null or empty one has none and is linked with nothing. Two rows are linked when 100 * |intersection| >=
    `percent` * |union|; component_id is the least doc_id reachable by links, itself included. Rows that repeat a
    doc_id each take the component of their own text. A row with a null doc_id links with nothing and has a null
    component. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    frequent = spark.sparkContext.broadcast(_frequent(rows, width))

    def describe(batches):
        for batch in batches:
            for part in _slices(batch, SLICE):
                yield _describe(part, width, percent, frequent.value)

    kinds = "__id long, n long, d1 long, d2 long, m0 long, m1 long, m2 long, bits binary, prefix array<long>"
    sets = stage(rows.mapInArrow(describe, kinds))
    classes = stage(
        sets.where("n > 0 and __id is not null").groupBy("n", "d1", "d2").agg(F.min("__id").alias("rep"))
    )
    key = ["n", "d1", "d2"]
    reps = sets.join(classes.withColumnRenamed("rep", "__id"), [*key, "__id"], "left_semi").withColumnRenamed("__id", "rep")
    reps = reps.dropDuplicates(["rep"])
    # first round: each class against the least of those that share a least hash with it
    able = stage(reps.where(F.col("n") >= _least_size(percent)))
    slim = able.select("rep", F.posexplode(F.array("m0", "m1", "m2")).alias("k", "m"))
    hubs = slim.groupBy("k", "m").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top")
    pairs = slim.join(hubs, ["k", "m"]).where("rep > hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    mapped = able.select("rep", "n", "bits")
    pairs = pairs.join(mapped.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a").join(
        mapped.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b"
    )
    first = stage(_possible(pairs, percent))
    linked = _verify(first, rows, classes, width, percent)
    unstage(first)
    label = components(linked)
    # second round, exact: every two classes of different components that share a prefix shingle and a size band
    grouped = able.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    grouped = stage(grouped.select("rep", "comp", "n", "bits", "prefix"))
    token = Window.partitionBy("token")
    meet = (
        grouped.select("rep", "comp", "n", F.explode("prefix").alias("token"))
        .withColumns({"lo": F.min("comp").over(token), "hi": F.max("comp").over(token)}).where("lo < hi")
        .select("token", "rep", "comp", "n")
    )
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    cell = Window.partitionBy("token", "band")
    meet = (
        meet.withColumn("own", band)
        .withColumn("band", F.explode(F.array(F.col("own"), F.col("own") - 1)))
        .withColumns({"lo": F.min("comp").over(cell), "hi": F.max("comp").over(cell), "rows": F.count("*").over(cell),
                      "lefts": F.max(F.col("own") == F.col("band")).over(cell),
                      "who": F.bit_xor(F.xxhash64("rep")).over(cell), "too": F.bit_xor(F.xxhash64("rep", F.lit(1))).over(cell)})
        .where("lo < hi and lefts")
        .withColumn("parts", F.ceil(F.col("rows") / CELL).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.xxhash64("who", "too", "rows", "band", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"),
            "rep", "comp", "n", (F.col("own") == F.col("band")).alias("left"),
        )
    )
    # a passage gives many shingles to the same documents: cells with the same members are one
    meet = stage(meet.distinct())
    where = meet.groupBy("rep").agg(F.collect_set(F.when(F.col("left"), F.col("g"))).alias("lefts"), F.collect_set(F.when(~F.col("left"), F.col("g"))).alias("others"))
    cells = meet.join(where, "rep").join(grouped.select("rep", "bits"), "rep").repartition("g").sortWithinPartitions("g")
    second = stage(_cells(cells.select("g", "rep", "comp", "n", "left", "bits", "lefts", "others"), percent).distinct())
    unstage(meet, grouped, able)
    more = _verify(second, rows, classes, width, percent)
    final = stage(components(linked.union(more)))
    unstage(second, linked, more)
    named = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        *key, F.coalesce("component", "rep").alias("component_id")
    )
    own = sets.where("n > 0 and __id is not null").select("__id", *key).join(named, key)
    rest = sets.where("n = 0 or __id is null").select("__id", "n", F.when(F.col("n") >= 0, F.col("__id")).alias("component_id"))
    out = own.select("__id", "n", "component_id").union(rest)
    return out.select(F.col("__id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def _least_size(percent: int) -> int:
    """Smaller sets are linked only with equal ones: n / (n + 1) is under the threshold."""
    return 1 if percent <= 0 else -(-percent // (100 - percent)) if percent < 100 else 1 << 62
