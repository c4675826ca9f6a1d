"""Count-min sketches of partitions that merge by aggregation.

A partition sends only the cells it touched, as sorted cell numbers inside blocks, so a sketch of many cells costs
what the partition holds. A cell counts up to two: a filter needs no more than "once" and "repeated".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of one block; blocks are what tasks merge.
BLOCK = 1 << 18


def width_for(keys: int, most: int = 1 << 30) -> int:
    """Cells for each of the two rows: four to eight for each expected key, a power of two; `most` bounds what is
    broadcast (a bit a cell: 128 MB a row). Fuller sketches only estimate higher."""
    return max(BLOCK, min(most, 1 << int(max(1, 4 * keys)).bit_length()))


def cells(keys: np.ndarray, width: int) -> np.ndarray:
    """Cell of each 64-bit key in row 0 and in row 1; row 1 lies behind row 0."""
    shift = np.uint64(64 - width.bit_length() + 1)
    a = (keys * np.uint64(0x9E3779B97F4A7C15)) >> shift
    b = ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift
    return np.stack([a, b + np.uint64(width)]).astype(np.int64)


def touched(keys: np.ndarray, width: int) -> pa.RecordBatch:
    """Partial sketch of these keys: (block, cells as int32 of once, cells of repeated)."""
    cell, n = np.unique(cells(keys, width).ravel(), return_counts=True)
    block = cell // BLOCK
    inside = (cell % BLOCK).astype("<i4")
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(cell) else np.zeros(0, np.int64)
    ends = np.r_[first[1:], len(cell)].astype(np.int64)
    once, more = [], []
    for lo, hi in zip(first, ends):
        part, twice = inside[lo:hi], n[lo:hi] > 1
        once.append(part[~twice].tobytes())
        more.append(part[twice].tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(block[first], pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
        names=["block", "once", "more"],
    )


SCHEMA = "block long, once binary, more binary"


def merge(parts: DataFrame, least: int = 2) -> DataFrame:
    """(block, bits): a bit for each cell that counts `least` (1 or 2) or more over all partial sketches."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BLOCK, np.uint8)
        for batch in batches:
            for once, more in zip(batch.column("once").to_pylist(), batch.column("more").to_pylist()):
                cell = np.frombuffer(once, "<i4")
                count[cell] = np.minimum(count[cell] + 1, 2)
                count[np.frombuffer(more, "<i4")] = 2
        bits = np.packbits(count >= least, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([bits], pa.binary())], names=["block", "bits"])

    return parts.groupBy("block").applyInArrow(run, "block long, bits binary")


def load(merged: DataFrame, width: int) -> np.ndarray:
    """The merged sketch on the driver, to be broadcast: 2 * width bits, whatever the input."""
    out = np.zeros(2 * width // 8, np.uint8)
    for row in merged.toLocalIterator():
        at = row["block"] * BLOCK // 8
        out[at : at + BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def members(ids: DataFrame, width: int) -> np.ndarray:
    """Bits of all values of the one long column of `ids`, for repeated() as a test of membership without misses."""
    name = ids.columns[0]

    def run(batches):
        for batch in batches:
            keys = np.asarray(batch.column(name).drop_null()).astype(np.int64).view(np.uint64)
            yield touched(np.unique(keys), width)

    return load(merge(ids.mapInArrow(run, SCHEMA), 1), width)


def repeated(bits: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """Whether the estimate (the lower of both rows) of each key is two or more."""
    if not len(keys):
        return np.zeros(0, bool)
    at = cells(keys, width)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def expected_keys(docs: DataFrame, text: str, chars_a_key: int) -> int:
    """Upper guess of the number of keys, from the characters of all texts: one number to the driver."""
    n = docs.agg(F.sum(F.length(F.col(text)).cast("long"))).first()[0] or 0
    return n // chars_a_key + 1
