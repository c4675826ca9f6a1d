"""Removal of word windows that occurred before, exact, behind a count-min prefilter.

Pass 1 gives every window a key, the least hash among the 8-word runs in it (neighbouring windows mostly share one),
and counts the places of keys in partition sketches, which merge by aggregation. Equal windows have their key at the
same place inside, so a window found twice has a key counted twice: the sketch overestimates and loses none. Pass 2
groups exactly, by 96-bit hashes of the word sequence, only windows whose key is estimated repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from . import sketch, words

GRAM = 8


def window_keys(a: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: its key, and the place of the key (the leftmost least 8-word hash)."""
    g = words.windows(a, min(GRAM, width))
    n = len(a) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least, place = g[:n].copy(), np.arange(n)
    for k in range(1, len(g) - n + 1):
        better = g[k : k + n] < least
        np.copyto(least, g[k : k + n], where=better)
        np.copyto(place, np.arange(k, k + n), where=better)
    return least, place


def _slices(batch, most=8_000_000):
    """Parts of a batch whose texts have some bytes together."""
    texts = batch.column("__text")
    sizes = np.frombuffer(texts.cast(pa.large_binary()).fill_null(b"").buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    k = 0
    while k < len(texts):
        end = int(np.searchsorted(sizes, sizes[k] + most))
        end = min(max(end, k + 1), len(texts))
        yield batch.slice(k, end - k)
        k = end


def _rows(docs, doc_id, text):
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.xxhash64(t).alias("__tie"), t.alias("__text"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """(__id, __tie, at, n): runs of n window starts from word `at` on whose word sequences also start earlier, in a
    smaller doc_id or before in the same document.

    Windows lie within one text; null, empty and short texts have none. A null doc_id comes before all others. Rows of
    one doc_id and different texts are separate documents in the order of `__tie`, the xxhash64 of the text; rows
    equal in both are one document given twice and share its runs.
    """
    spark = docs.sparkSession
    rows = _rows(docs, doc_id, text)
    size = sketch.width_for(sketch.expected_keys(rows, "__text", 3 * max(2, width - GRAM)))

    def count(batches):
        for batch in batches:
            for part in _slices(batch):
                data, offsets = words.utf8(part.column("__text"))
                starts, ends, firsts = words.spans(data, offsets)
                least, place = window_keys(words.hashes(data, starts, ends), width)
                own = words.whole(firsts, width)
                _, one = np.unique(place[own], return_index=True)
                yield sketch.touched(least[own][one], size)

    merged = stage(sketch.merge(rows.select("__text").mapInArrow(count, sketch.SCHEMA)))
    shared = spark.sparkContext.broadcast(sketch.load(merged, size))

    def suspects(batches):
        for batch in batches:
            for part in _slices(batch):
                yield _suspects(part, shared.value, size, width)

    found = rows.mapInArrow(suspects, "ha long, hb int, __id long, __tie long, at int, n int")
    place = F.struct("__id", "__tie", "at")
    first = F.min(F.when(F.col("n") == 0, place)).over(Window.partitionBy("ha", "hb"))
    return found.withColumn("first", first).where((F.col("n") > 0) | (place > F.col("first"))).select(
        "__id", "__tie", "at", F.greatest("n", F.lit(1)).alias("n")
    )


def _suspects(part: pa.RecordBatch, bits: np.ndarray, size: int, width: int) -> pa.RecordBatch:
    """Windows whose key is estimated repeated. Of equal windows in this part only the first goes on to be grouped
    (n = 0); the others are settled and leave as runs (n > 0), so a very common window brings one row from each part.
    """
    data, offsets = words.utf8(part.column("__text"))
    starts, ends, firsts = words.spans(data, offsets)
    a = words.hashes(data, starts, ends)
    own = words.whole(firsts, width)
    own = own[sketch.repeated(bits, window_keys(a, width)[0][own], size)] if len(own) else own
    b = words.hashes(data, starts, ends, 7)
    ha = words.signed(words.windows(a, width)[own])
    hb = (words.windows(b, width)[own] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    doc = np.searchsorted(firsts, own, "right") - 1
    ids, tie = (np.asarray(part.column(c).fill_null(-(2**63)))[doc] for c in ("__id", "__tie"))
    at = own - firsts[doc]
    order = np.lexsort((at, tie, ids, hb, ha))
    opens = np.ones(len(order), bool)
    opens[1:] = (ha[order][1:] != ha[order][:-1]) | (hb[order][1:] != hb[order][:-1])
    first = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))] if len(order) else order
    later = np.zeros(len(order), bool)
    later[order] = (ids[order] != ids[first]) | (tie[order] != tie[first]) | (at[order] != at[first])
    go, run = np.flatnonzero(~later), np.flatnonzero(later)
    heads = np.ones(len(run), bool)
    heads[1:] = (np.diff(own[run]) != 1) | (np.diff(doc[run]) != 0)
    heads = np.flatnonzero(heads)
    lengths = np.diff(np.r_[heads, len(run)])
    take = np.r_[go, run[heads]]
    spread = (words.mix((own[run[heads]] + 1).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    idc = pa.array(ids[take], mask=ids[take] == -(2**63))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[ha[go], tie[run[heads]]]), pa.array(np.r_[hb[go], spread]), idc, pa.array(tie[take]),
            pa.array(at[take].astype(np.int32)), pa.array(np.r_[np.zeros(len(go), np.int32), lengths.astype(np.int32)]),
        ],
        names=["ha", "hb", "__id", "__tie", "at", "n"],
    )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 20, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): every row of `docs` without the words that a repeated window
    covers; kept words are joined by one space. Windows are judged on the input. See repeats() for ties and nulls;
    an empty table gives an empty result, a text without repeats keeps all its words. Other columns are not read."""
    gone = repeats(docs, doc_id, text, width).groupBy(F.col("__id").alias("i"), F.col("__tie").alias("t")).agg(
        F.collect_list("at").alias("at"), F.collect_list("n").alias("n")
    )
    rows = _rows(docs, doc_id, text)
    both = rows.join(gone, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__tie") == F.col("t")), "left")

    def cut(batches):
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            columns = (batch.column(c).to_pylist() for c in ("__text", "at", "n"))
            for body, at, n in zip(*columns):
                own = body.encode().split()
                size, kept = len(own), own
                if at:
                    cover = np.zeros(size + 1, np.int32)
                    at = np.array(at)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + np.array(n) + width - 1, -1)
                    stay = np.cumsum(cover)[:size] == 0
                    kept = [own[i] for i in np.flatnonzero(stay)]
                joined = b" ".join(kept)
                out["n_words"].append(size)
                out["n_removed"].append(size - len(kept))
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                if texts:
                    out["kept"].append(joined.decode())
            kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.string()} if texts else {})
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), *(pa.array(out[c], k) for c, k in kinds.items())], names=["doc_id", *kinds]
            )

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return both.select("__id", "__text", "at", "n").mapInArrow(cut, schema)
