"""Improbable-feature digests of whole texts, and their likeness.

A window of `WINDOW` bytes has a Shannon entropy; how rare that entropy is over all windows of the table ranks it. In
every neighbourhood of `NEAR` windows the rarest (leftmost first) gets a vote, and windows with enough votes are the
features of a text. Their hashes go into chained Bloom filters of `FILTER` bits, a new filter after every `FILL`
features. Likeness is the overlap of filter bits above what chance gives, between no overlap (0) and full (1).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

WINDOW, NEAR, VOTES = 32, 32, 8
FILTER, FILL, BITS = 2048, 160, 5
#: Entropies are told apart in steps of 1 / STEP bits.
STEP = 64
LEVELS = 5 * STEP + 1
#: Windows under this entropy say little (runs of one sign); they rank behind all others.
LEAST = int(1.5 * STEP)
_SCALE = 1 << 20
_F = np.array([0.0] + [n * np.log2(n) for n in range(1, WINDOW + 1)])
#: What another equal byte adds to the sum of n log2 n over byte counts, in fixed point.
_GAIN = np.rint(np.diff(_F) * _SCALE).astype(np.int64)
_POP = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy level of the window that starts at each byte, by incremental counts: the sum of n log2 n changes by the
    count of the byte that enters and of the byte that leaves."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    enter = np.zeros(len(data), np.uint8)  # equal bytes among the WINDOW - 1 before
    leave = np.zeros(len(data), np.uint8)  # and among the WINDOW - 1 behind
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        enter[d:] += same
        leave[:-d] += same
    first = np.rint(_F[np.bincount(data[:WINDOW], minlength=256)] * _SCALE).astype(np.int64).sum()
    total = np.empty(n, np.int64)
    total[0] = first
    total[1:] = first + np.cumsum(_GAIN[enter[WINDOW:]] - _GAIN[leave[: n - 1]])
    return np.clip(5 * STEP - (total * STEP + WINDOW * _SCALE // 2) // (WINDOW * _SCALE), 0, LEVELS - 1)


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Whether the window at each byte lies within one text."""
    flag = np.zeros(n + 1, np.int32)
    room = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    ok = room > 0
    np.add.at(flag, offsets[:-1][ok], 1)
    np.add.at(flag, (offsets[:-1] + room)[ok], -1)
    return np.cumsum(flag)[:n] > 0


def features(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each feature in order of place. A text shorter than a window is one feature; a text in
    which no window gets enough votes has its first neighbourhood's rarest; an empty text has none."""
    n_docs, size = len(offsets) - 1, np.diff(offsets)
    n = len(data) - WINDOW + 1
    doc, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > 0:
        inside = _inside(offsets, n)
        big = np.int64(1) << 40
        key = rank[entropy_levels(data)] * big + np.arange(n)
        # within a text only: windows across an edge can never win, and no neighbourhood reaches over it
        key[~inside] = np.int64(1) << 62
        low, span = key, 1
        while span < NEAR:
            reach = min(span, NEAR - span)
            nxt = np.full(n, np.int64(1) << 62)
            nxt[: max(0, n - reach)] = low[reach:]
            low, span = np.minimum(low, nxt), span + reach
        at = np.flatnonzero(inside)
        d = np.searchsorted(offsets, at, "right") - 1
        best = (low[at] & (big - 1)).astype(np.int64)
        # a neighbourhood that reaches into the next text keeps to its own end
        end = offsets[d + 1] - WINDOW
        late = at + NEAR - 1 > end
        if late.any():
            own = key[at[late][::-1]]
            own_d = d[late][::-1]
            starts = np.flatnonzero(np.r_[True, own_d[1:] != own_d[:-1]])
            run = _running_min(own, starts)
            best[late] = (run[::-1] & (big - 1)).astype(np.int64)
        votes = np.bincount(best, minlength=n)
        chosen = np.flatnonzero(votes >= VOTES)
        have = np.zeros(n_docs, bool)
        have[np.searchsorted(offsets, chosen, "right") - 1] = True
        lone = np.flatnonzero(~have & (size >= WINDOW))
        if len(lone):
            chosen = np.sort(np.r_[chosen, best[np.searchsorted(at, offsets[lone])]])
        doc, place = np.searchsorted(offsets, chosen, "right") - 1, chosen
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    start, stop = np.r_[place, offsets[short]], np.r_[place + WINDOW, offsets[short] + size[short]]
    doc = np.r_[doc, short]
    h = words.hashes(data, start, stop, 5)
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def _running_min(values, starts):
    """Minimum so far within each run that begins at `starts`, by doublings."""
    out, n = values.copy(), len(values)
    begin = np.zeros(n, np.int64)
    begin[starts] = starts
    begin = np.maximum.accumulate(begin)
    step, longest = 1, int(np.diff(np.r_[starts, n]).max())
    while step < longest:
        ok = np.arange(n) - step >= begin
        out[ok] = np.minimum(out[ok], out[np.flatnonzero(ok) - step])
        step *= 2
    return out


def filters(doc: np.ndarray, h: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """Chained filters of each text, as rows of FILTER / 8 bytes; features found again in a text are skipped."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    again = np.zeros(len(h), bool)
    if len(h):
        again[order[1:]] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    doc, h = doc[~again], h[~again]
    at = np.searchsorted(doc, np.arange(n_docs + 1))
    link = (np.arange(len(doc)) - at[doc]) // FILL
    chains = -(-np.diff(at) // FILL)
    base = np.r_[0, np.cumsum(chains)]
    flags = np.zeros(int(base[-1]) * FILTER, np.uint8)
    row = (base[doc] + link) * FILTER
    width = FILTER.bit_length() - 1
    for k in range(BITS):
        flags[row + ((h >> np.uint64(k * width)) & np.uint64(FILTER - 1)).astype(np.int64)] = 1
    packed = np.packbits(flags).reshape(-1, FILTER // 8)
    return [packed[base[i] : base[i + 1]] for i in range(n_docs)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against the best of the other, overlap above chance over the most
    possible above chance. Two empty chains are alike (1), an empty and a filled one are not (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    ones, twos = _POP[a].sum(1), _POP[b].sum(1)
    total = 0.0
    for own, x in zip(a, ones):
        least = np.minimum(x, twos).astype(float)
        chance = x * twos / FILTER
        over = (_POP[own & b].sum(1) - chance) / np.maximum(least - chance, 1e-9)
        total += float(np.clip(over, 0, 1).max())
    return total / len(a)


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy level: rare levels first, levels under LEAST last. Counts all windows of all texts; one
    number a level reaches the driver."""

    def count(batches):
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for part in _parts(batch):
                data, offsets = words.utf8(part.column("__text"))
                level = entropy_levels(data)
                total += np.bincount(level[_inside(offsets, len(level))], minlength=LEVELS) if len(level) else 0
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], names=["level", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("__text")).mapInArrow(count, "level long, n long")
    n = np.zeros(LEVELS, np.int64)
    for r in rows.groupBy("level").agg(F.sum("n").alias("n")).collect():
        n[r["level"]] = r["n"]
    order = sorted(range(LEVELS), key=lambda k: (k < LEAST, int(n[k]), k))
    out = np.empty(LEVELS, np.int64)
    out[order] = np.arange(LEVELS)
    return out


def _parts(batch, most=2_000_000):
    from .substring import _slices

    return _slices(batch, most)


def _chains(texts: list[bytes], rank) -> list[np.ndarray]:
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    return filters(*features(data, offsets, rank), len(texts))


def fingerprint(docs: DataFrame, text: str = "text", rank: np.ndarray | None = None) -> DataFrame:
    """All columns of `docs` and `fingerprint`: the chained filters of the whole text as hex, FILTER / 4 digits a
    filter; empty for a null or empty text. Equal texts have equal fingerprints under one `rank` (by default that of
    this table). A column named fingerprint is replaced."""
    rank = rarity(docs, text) if rank is None else rank
    keep = [c for c in docs.columns if c != "fingerprint"]
    mine = [f"c{i}" for i in range(len(keep))]
    sent = docs.select(*(F.col(f"`{c}`").alias(m) for c, m in zip(keep, mine)), F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in sent.schema[:-1]), "fingerprint string"])

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                own = [(t or "").encode() for t in part.column("__text").to_pylist()]
                prints = [c.tobytes().hex() for c in _chains(own, rank)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in mine), pa.array(prints, pa.string())], names=[*mine, "fingerprint"])

    return sent.mapInArrow(run, schema).toDF(*keep, "fingerprint")


def _firsts(ids: DataFrame, rows_each: int, most: int = 100_000) -> np.ndarray:
    """Least id of each of some ranges of consecutive ids (column x), ascending: at most `most` numbers, so that they
    can be broadcast; only ids are shuffled for them."""
    n = ids.count()
    cut = ids.repartitionByRange(max(1, min(most, n // rows_each)), "x")
    found = cut.groupBy(F.spark_partition_id().alias("p")).agg(F.min("x").alias("x")).select("x").toArrow()
    return np.sort(np.asarray(found.column("x").combine_chunks()).astype(np.int64)) if found.num_rows else np.zeros(0, np.int64)


def edited_pairs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rank: np.ndarray | None = None, rows_each: int = 2000
) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and the likeness to the edited and to the next text.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next row's
    text; next is by ascending doc_id, nulls last, rows of one doc_id by text; after the last comes the first. A table
    of one row is its own next. A null text counts as empty. An empty table gives an empty result. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; other columns are not read.

    Rows are dealt to ranges of consecutive ids; each range ends with a copy of the first row of the next one, so
    every row meets its next one in one pass over sorted rows, which are held one part at a time.
    """
    rank = rarity(docs, text) if rank is None else rank
    own_id = F.col(f"`{doc_id}`").cast("long")
    rows = docs.select(
        own_id.alias("id"), F.coalesce(own_id, F.lit(2**63 - 1)).alias("x"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")
    )
    firsts = docs.sparkSession.sparkContext.broadcast(_firsts(rows.select("x"), rows_each))

    @F.pandas_udf("array<long>")
    def ranges(x):
        f = firsts.value
        k = np.searchsorted(f, x.to_numpy(), "right") - 1
        opens = f[k] == x.to_numpy()
        return x.__class__([[i, (i - 1) % len(f)] if o else [i] for i, o in zip(k.tolist(), opens.tolist())])

    met = (
        rows.select("id", "x", "__text", F.posexplode(ranges("x")).alias("extra", "k"))
        .repartition("k").sortWithinPartitions("k", "extra", "x", "__text").select("id", "extra", "__text")
    )

    def run(batches):
        held = None
        for batch in batches:
            for part in _parts(batch):
                ids, extra, texts = (part.column(c).to_pylist() for c in ("id", "extra", "__text"))
                if held:
                    ids, extra, texts = ([h, *c] for h, c in zip(held, (ids, extra, texts)))
                held = ids[-1], extra[-1], texts[-1]
                own = [i for i in range(len(ids) - 1) if not extra[i]]
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
                edited = [t.encode() for t in edited]
                chains = _chains([t.encode() for t in texts], rank)
                changed = _chains(edited, rank)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                        pa.array([chains[i].tobytes().hex() for i in own], pa.string()),
                        pa.array([c.tobytes().hex() for c in changed], pa.string()),
                        pa.array([likeness(chains[i], c) for i, c in zip(own, changed)], pa.float64()),
                        pa.array([likeness(chains[i], chains[i + 1]) for i in own], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return met.mapInArrow(run, kinds)
