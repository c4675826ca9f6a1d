"""Words of whole texts as NumPy offsets and hashes, for the operators that run inside Arrow batches.

A word is a maximal run of bytes other than space and \\t..\\r, so words never depend on letter tables. A null text
counts as empty everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_A, _B, _C = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the offset of each text with the end behind them."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not data or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; bytes of other characters stay."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word, with the end behind them."""
    solid = ~_SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = True, True
    starts = np.flatnonzero(solid & before)
    return starts, np.flatnonzero(solid & after) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts, in order."""
    return mix(a * _C + (b ^ _A))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; eight bytes of all spans are taken at a time."""
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * _C + np.uint64(seed))
    todo, at = np.arange(len(starts)), 0
    while len(todo := todo[size[todo] > at]):
        part, left = eights[starts[todo] + at], size[todo] - at
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[todo] = mix(h[todo] ^ (part * _C))
        at += 8
    return h


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive items, from doublings; runs across texts are the caller's to drop."""
    out, done, power, span = None, 0, h, 1
    while True:
        if width & span:
            if out is None:
                out = power
            else:
                n = len(h) - done - span + 1
                out = join(out[:n], power[done : done + n]) if n > 0 else power[:0]
            done += span
        if done == width:
            return out
        power = join(power[:-span], power[span:]) if len(power) > span else power[:0]
        span *= 2


def whole(firsts: np.ndarray, width: int) -> np.ndarray:
    """Indices of the runs of `width` items that lie within one text."""
    n = int(firsts[-1])
    if n < width:
        return np.zeros(0, np.int64)
    keep = np.zeros(n + 1, np.int32)
    room = np.maximum(np.diff(firsts) - width + 1, 0)
    np.add.at(keep, firsts[:-1], room > 0)
    np.add.at(keep, firsts[:-1] + room, -(room > 0).astype(np.int32))
    return np.flatnonzero(np.cumsum(keep)[:n])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
