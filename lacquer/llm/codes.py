"""Product codes of vectors: codebooks per part, learned and applied through trees of balls (anchors hierarchy).

A block of vectors gets one tree per part position. It is grown middle-out: anchors far from each other take the
points nearest to them, neighbouring anchors are joined upwards into balls, and each anchor is split the same way
downwards. A ball caches number and sum of its points. Walking down with the codebook, a ball passes to its children
only the entries that can still be nearest to a point of it; a ball with one entry left is wholly owned and adds its
cached sum at once. Components are integers, so all sums and distances are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage

#: Points of a ball that is not split further; vectors of a block; pairs of a point and an entry that are held at once.
LEAF, BLOCK, PAIRS = 24, 4096, 1 << 19


def _spread(points: np.ndarray, rows: np.ndarray, most: int) -> tuple[list[np.ndarray], list[int], list[np.ndarray]]:
    """Anchors of the points `rows`: the rows each one owns, its own row, and their squared distances, farthest first.

    Each new anchor is the point farthest from its owner. An owner's points are held by falling distance, so those
    within half the way to the new anchor, which it cannot win, are the tail and are not looked at.
    """
    def away(some, from_):
        d = points[some] - points[from_]
        return np.einsum("ij,ij->i", d, d)

    dist = away(rows, rows[0])
    order = np.argsort(-dist, kind="stable")
    owned, centres, dists = [rows[order]], [int(rows[0])], [dist[order]]
    while len(owned) < most:
        widest = max(range(len(owned)), key=lambda a: dists[a][0])
        if dists[widest][0] == 0:
            break
        new = int(owned[widest][0])
        won, at = [], []
        for a, (mine, d) in enumerate(zip(owned, dists)):
            gap = points[centres[a]] - points[new]
            near = int(np.searchsorted(-d, -float(gap @ gap) / 4.0, "right"))  # beyond half the way
            if not near:
                continue
            theirs = away(mine[:near], new)
            lost = theirs < d[:near]
            if lost.any():
                won.append(mine[:near][lost])
                at.append(theirs[lost])
                keep = np.r_[~lost, np.ones(len(mine) - near, bool)]
                owned[a], dists[a] = mine[keep], d[keep]
        mine, d = np.concatenate(won), np.concatenate(at)
        order = np.argsort(-d, kind="stable")
        owned.append(mine[order])
        centres.append(new)
        dists.append(d[order])
    return owned, centres, dists


class Tree:
    """Balls over the rows of an integer matrix: order of the points, and per ball its range in it, children, centre,
    radius and sum. Children lie before their parent, the root is last."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.order: list[np.ndarray] = []
        self.nodes: list[tuple] = []
        self.placed = 0
        self.grow(np.arange(len(points)))
        self.pack(points)

    def add(self, start: int, left: int, right: int) -> int:
        self.nodes.append((start, self.placed, left, right))
        return len(self.nodes) - 1

    def leaf(self, rows: np.ndarray) -> int:
        start = self.placed
        self.order.append(rows)
        self.placed += len(rows)
        return self.add(start, -1, -1)

    def grow(self, rows: np.ndarray) -> int:
        if len(rows) <= LEAF:
            return self.leaf(rows)
        owned, centres, _ = _spread(self.points, rows, max(2, int(np.sqrt(len(rows)))))
        return self.leaf(rows) if len(owned) == 1 else self.merge(owned, centres)

    def merge(self, owned: list[np.ndarray], centres: list[int]) -> int:
        """A binary tree over anchors: the nearest two become one ball, again and again; then it is walked so that the
        points of every ball are consecutive."""
        n = len(owned)
        at = np.empty((2 * n - 1, self.points.shape[1]))
        at[:n] = self.points[centres]
        gap = np.full((2 * n - 1, 2 * n - 1), np.inf)
        sq = np.einsum("ij,ij->i", at[:n], at[:n])
        gap[:n, :n] = sq[:, None] + sq[None, :] - 2 * at[:n] @ at[:n].T
        gap[np.arange(n), np.arange(n)] = np.inf
        size, kids, live = [len(x) for x in owned], {}, np.zeros(2 * n - 1, bool)
        live[:n] = True
        for new in range(n, 2 * n - 1):
            a, b = divmod(int(np.argmin(gap[:new, :new])), new)
            kids[new] = (a, b)
            at[new] = (at[a] * size[a] + at[b] * size[b]) / (size[a] + size[b])
            size.append(size[a] + size[b])
            live[[a, b]] = False
            gap[[a, b], :] = gap[:, [a, b]] = np.inf
            there = np.flatnonzero(live)
            d = at[there] - at[new]
            gap[new, there] = gap[there, new] = np.einsum("ij,ij->i", d, d)
            live[new] = True

        def build(x: int) -> int:
            start = self.placed
            if x < n:
                return self.grow(owned[x])
            left = build(kids[x][0])
            return self.add(start, left, build(kids[x][1]))

        return build(2 * n - 2)

    def pack(self, points: np.ndarray) -> None:
        self.order = np.concatenate(self.order).astype(np.int32)
        self.nodes = np.asarray(self.nodes, np.int32)
        there = points[self.order].astype(np.int64)
        upto = np.vstack([np.zeros((1, there.shape[1]), np.int64), np.cumsum(there, 0)])
        start, end = self.nodes[:, 0], self.nodes[:, 1]
        self.sums = upto[end] - upto[start]
        centre = self.sums / (end - start)[:, None]
        self.radius = np.empty(len(start))
        for k in range(len(start)):
            d = there[start[k] : end[k]] - centre[k]
            self.radius[k] = np.sqrt(np.einsum("ij,ij->i", d, d).max())
        self.there = there


def assign(there: np.ndarray, nodes: np.ndarray, sums: np.ndarray, radius: np.ndarray, entries: np.ndarray):
    """Nearest entry of each point in tree order, ties to the lower index, with the balls owned whole: (entry of each
    point, ball and entry of each owned ball, mask of the points that were looked at themselves)."""
    book = entries.astype(np.float64)
    centre = sums / (nodes[:, 1] - nodes[:, 0])[:, None]
    out = np.zeros(len(there), np.int64)
    single = np.zeros(len(there), bool)
    balls, owners = [], []
    node, entry = np.full(len(book), len(nodes) - 1), np.arange(len(book))  # lists of candidates, as pairs
    while len(node):
        d = _apart(centre, node, book, entry)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        count = np.diff(np.r_[first, len(node)])
        group = np.repeat(np.arange(len(first)), count)
        least = np.minimum.reduceat(d, first)
        best = entry[np.flatnonzero(d == least[group])[np.searchsorted(group[d == least[group]], np.arange(len(first)))]]
        span = book[entry] - book[best[group]]
        between = np.sqrt(np.einsum("ij,ij->i", span, span))
        # Further than the radius from the plane between both, with room for rounding; an equal entry of higher index never wins.
        out_of = d - least[group] > 2 * radius[node] * between * (1 + 1e-9) + 1e-6 * (1 + np.abs(d))
        out_of |= (between == 0) & (entry > best[group])
        node, entry, group = node[~out_of], entry[~out_of], group[~out_of]
        count = np.bincount(group, minlength=len(first))
        sole = count[group] == 1
        for k, e in zip(node[sole].tolist(), entry[sole].tolist()):
            out[nodes[k, 0] : nodes[k, 1]] = e
        balls.append(node[sole])
        owners.append(entry[sole])
        node, entry = node[~sole], entry[~sole]
        leaf = nodes[node, 2] < 0
        _leaves(there, nodes, node[leaf], entry[leaf], book, out, single)
        node, entry = node[~leaf], entry[~leaf]
        both = np.concatenate([nodes[node, 2], nodes[node, 3]])
        by = np.lexsort((np.tile(entry, 2), both))
        node, entry = both[by], np.tile(entry, 2)[by]
    return out, np.concatenate(balls), np.concatenate(owners), single


def _apart(points, i, book, j) -> np.ndarray:
    out = np.empty(len(i))
    for lo in range(0, len(i), PAIRS):
        d = points[i[lo : lo + PAIRS]] - book[j[lo : lo + PAIRS]]
        out[lo : lo + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def _leaves(there, nodes, node, entry, book, out, single) -> None:
    """Each point of a ball that is not split against the entries left on the ball's list."""
    if not len(node):
        return
    points = there.astype(np.float64)
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    for lo, hi in zip(first.tolist(), np.r_[first[1:], len(node)].tolist()):
        a, b = nodes[node[lo], 0], nodes[node[lo], 1]
        list_ = entry[lo:hi]
        d = points[a:b, None, :] - book[list_][None, :, :]
        out[a:b] = list_[np.einsum("ijk,ijk->ij", d, d).argmin(1)]
        single[a:b] = True


def _integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    x = np.floor(vectors.astype(np.float64) * scale)
    if x.size and 4 * x.shape[1] * np.abs(x).max() ** 2 >= 2**52:
        raise ValueError("components are too large for exact distances; lower the scale")
    return x.astype(np.int64)


def _usable(vectors: DataFrame, key: str, vector: str, label: str | None, parts: int) -> DataFrame:
    """(k, v, l) of the rows whose vector holds finite numbers only."""
    rows = vectors.select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
        (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("l"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & whole)


class Codec:
    """Codebooks of `parts` equal parts of vectors, `books[part][entry]`."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    @property
    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


class Forest:
    """Blocks of vectors with a tree per part, written once; every round walks the written trees.

    vectors: (key, vector, label). Vectors that are null, empty, hold null or non-finite components, or whose length
    is no multiple of `parts` or differs from the length at the smallest key, are left out. Components become
    floor(scale * x). Keys may repeat or be null (nulls last), other columns are not read; with no vectors left there
    are no codes. Components so large that a distance would not be exact are an error. A common vector is one ball of
    radius 0 in each block and is decided at once.
    """

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label",
                 parts: int = 4, entries: int = 256, scale: float = 1024.0):
        rows = _usable(vectors, key, vector, label, parts)
        self.parts, self.names, self.spark = parts, (key, label), vectors.sparkSession
        order = F.col("k").asc_nulls_last(), F.col("v")
        least = rows.orderBy(*order).select(F.size("v").alias("n")).first()
        width = least.n if least else 0
        rows = rows.where(F.size("v") == width)
        seeds = [r.v for r in rows.orderBy(*order).limit(entries).select("v").collect()] if width else []  # `entries` rows
        start = _integers(np.asarray(seeds, np.float64).reshape(len(seeds), width), scale)
        self.codec = Codec(np.split(start, parts, axis=1) if width else [])
        self.schema = rows.schema
        self.trees = stage(_grown(rows, parts, scale))

    def learn(self, rounds: int = 4) -> Codec:
        """Rounds of assigning every part and moving every entry to floor(sum / count); unused ones stay."""
        for _ in range(rounds if self.codec.books else 0):
            moved = [b.copy() for b in self.codec.books]
            sums = _sums(self.trees, self.codec.books).groupBy("part", "entry").agg(
                F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(moved[0].shape[1])])
            for row in sums.collect():  # one row an entry
                moved[row.part][row.entry] = np.asarray(row[3:], np.int64) // row.n
            self.codec = Codec(moved)
        return self.codec

    def encode(self) -> DataFrame:
        """(key, label, code, error): indices in hexadecimal by part, and the squared distances summed over the parts."""
        books, parts = self.codec.books, self.parts

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    n = len(row["k"])
                    code, error = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
                    for p in range(parts):
                        there, nodes, sums, radius, order = _read(row["trees"][p], books[p].shape[1])
                        own = assign(there, nodes, sums, radius, books[p])[0]
                        d = there - books[p][own]
                        code[order, p] = own
                        error[order] += np.einsum("ij,ij->i", d, d)
                    said = ["".join(f"{x:02x}" for x in c) for c in code.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["k"], batch.schema.field("k").type.value_type), pa.array(row["l"], batch.schema.field("l").type.value_type),
                         pa.array(said, pa.string()), pa.array(error)], names=["k", "l", "code", "error"])

        k, l = (self.schema[c].dataType.simpleString() for c in "kl")
        return self.trees.mapInArrow(run, f"k {k}, l {l}, code string, error bigint")

    def drop(self) -> None:
        unstage(self.trees)


def _grown(rows: DataFrame, parts: int, scale: float) -> DataFrame:
    def block(k, l, v, kinds):
        points = _integers(np.asarray(v, np.float64), scale)
        packed = []
        for part in np.split(points, parts, axis=1):
            t = Tree(part)
            packed.append(b"".join(x.tobytes() for x in (
                np.asarray([len(t.order), len(t.nodes)], np.int64), t.order, t.nodes, t.radius, t.sums, t.there.astype(np.int32))))
        return pa.RecordBatch.from_arrays(
            [pa.array([k], pa.list_(kinds[0])), pa.array([l], pa.list_(kinds[1])), pa.array([packed], pa.list_(pa.binary()))],
            names=["k", "l", "trees"])

    def run(batches):
        held = ([], [], [])
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in ("k", "l")]
            for to, c in zip(held, ("k", "l", "v")):
                to.extend(batch.column(c).to_pylist())
            while len(held[0]) >= BLOCK:
                yield block(*(x[:BLOCK] for x in held), kinds)
                held = tuple(x[BLOCK:] for x in held)
        if held[0]:
            yield block(*held, kinds)

    k, l = (rows.schema[c].dataType.simpleString() for c in "kl")
    return rows.select("k", "l", "v").mapInArrow(run, f"k array<{k}>, l array<{l}>, trees array<binary>")


def _read(raw: bytes, width: int):
    n, m = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for kind, shape in ((np.int32, (n,)), (np.int32, (m, 4)), (np.float64, (m,)), (np.int64, (m, width)), (np.int32, (n, width))):
        size = int(np.prod(shape))
        out.append(np.frombuffer(raw, kind, size, at).reshape(shape))
        at += size * np.dtype(kind).itemsize
    order, nodes, radius, sums, there = out
    return there.astype(np.int64), nodes, sums, radius, order


def _sums(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, n, s): per block the points of each entry, owned balls by their cached sums."""
    def run(batches):
        for batch in batches:
            for packed in batch.column("trees").to_pylist():
                for p, raw in enumerate(packed):
                    there, nodes, sums, radius, _ = _read(raw, books[p].shape[1])
                    out, balls, owners, single = assign(there, nodes, sums, radius, books[p])
                    total = np.zeros(books[p].shape, np.int64)
                    n = np.bincount(owners, nodes[balls, 1] - nodes[balls, 0], minlength=len(total)).astype(np.int64)
                    np.add.at(total, owners, sums[balls])
                    np.add.at(total, out[single], there[single])
                    n += np.bincount(out[single], minlength=len(total))
                    used = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]),
                         pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    return trees.select("trees").mapInArrow(run, "part int, entry int, n bigint, s array<bigint>")


def label_errors(coded: DataFrame, label: str = "l", error: str = "error") -> DataFrame:
    """The rows with label_error, the error summed over rows of equal label, nulls together. The sums are taken per
    label before the shuffle and written, so the join is broadcast or, with many labels, sorted with AQE's splitting."""
    sums = stage(coded.groupBy(F.col(label).alias("_l")).agg(F.sum(error).alias("label_error")))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of (vec_id, embedding, label); edges as in Forest."""
    forest = Forest(vectors, parts=parts, entries=entries, scale=scale)
    codec = forest.learn(rounds)
    coded = stage(forest.encode())
    forest.drop()
    return label_errors(coded).select(
        F.col("k").alias("vec_id"), "code", "error", "label_error", F.lit(codec.sha256).alias("codebooks_sha256"))
