"""Structured Streaming forms of the three chunk carries: envelope tail, event overlap, previous spectrum.

Block files arrive in any order; per capture and channel they are taken in block order. A block that is early waits
in state, one that was already taken is ignored, so replays change nothing. Each state holds one chunk's carry, and
behind the last block only the mark that the series has ended.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..operators.impulses import CLIP_PADDING, HALO, MAX_EVENT, MAX_IMPULSE, MIN_IMPULSE_CONFIDENCE, impulse_scores

BLOCK_STREAM = "capture_id string, channel int, block_ix bigint, start_sample bigint, samples array<double>, last boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_block_stream(spark, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(BLOCK_STREAM).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class InOrder(StatefulProcessor):
    """Hands blocks to `take` in order; subclasses keep their carry in `carry` (an array of doubles)."""

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "ix bigint")
        self.waiting = handle.getMapState("waiting", "ix bigint", "start bigint, xs array<double>, last boolean")
        self.carry = handle.getValueState("carry", StructType([StructField("xs", ArrayType(DoubleType()))]))

    def handleInputRows(self, key, rows, timer_values):
        at = self.next.get()[0] if self.next.exists() else 0
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if at >= 0 and r.block_ix >= at:
                    self.waiting.updateValue((int(r.block_ix),), (int(r.start_sample), np.asarray(r.samples, dtype=float).tolist(), bool(r.last)))
        while at >= 0 and self.waiting.containsKey((at,)):
            start, xs, last = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            yield self.take(key, int(start), np.asarray(xs, dtype=float), bool(last))
            at += 1
            if last:
                at = -1
                self.carry.clear()
                self.waiting.clear()
        self.next.update((at,))

    def held(self) -> np.ndarray:
        return np.asarray(self.carry.get()[0], dtype=float) if self.carry.exists() else np.empty(0)

    def keep(self, xs: np.ndarray) -> None:
        self.carry.update((np.asarray(xs, dtype=float).tolist(),))

    def close(self) -> None:
        pass


class EnvelopeCarry(InOrder):
    def __init__(self, window: int) -> None:
        self.window = window

    def take(self, key, start, xs, last):
        tail = self.held()
        x = np.concatenate([tail, xs])
        first = (start - tail.size) // self.window
        full = x.size // self.window
        parts = list(x[: full * self.window].reshape(-1, self.window))
        rest = x[full * self.window :]
        if last and rest.size:
            parts.append(rest)
            rest = rest[:0]
        self.keep(rest)
        db = [20.0 * np.log10(max(np.sqrt(np.mean(p**2)), 1e-9)) for p in parts]
        return pd.DataFrame({"capture_id": [key[0]] * len(db), "channel": [int(key[1])] * len(db), "win_ix": np.arange(first, first + len(db)), "rms_db": db})


class EventCarry(InOrder):
    """Impulses and clipped runs of one channel with a 1024-sample overlap; an event belongs to the block in whose
    inner part its peak lies, and comes out with that block. None is kept back or dropped; those too long to be
    repaired say so."""

    def __init__(self, overlap: int = HALO) -> None:
        self.overlap = overlap

    def found(self, x: np.ndarray):
        hot = np.flatnonzero(np.abs(x) >= 0.9999)
        clips = []
        for run in np.split(hot, np.flatnonzero(np.diff(hot) > 17) + 1):
            if run.size:
                peak = run[np.argmax(np.abs(x[run]))]
                clips.append((1, float(min(1.0, abs(x[peak]))), int(run[0]), int(run[-1] + 1), int(peak)))
        out = list(clips)
        score = impulse_scores(x)
        hit = np.flatnonzero(score)
        for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
            if not run.size:
                continue
            peak = run[np.argmax(score[run])]
            near = any(a - CLIP_PADDING < run[-1] + 1 and b + CLIP_PADDING > run[0] for _, _, a, b, _ in clips)
            if score[peak] >= MIN_IMPULSE_CONFIDENCE and not near:
                out.append((0, float(score[peak]), int(run[0]), int(run[-1] + 1), int(peak)))
        return out

    def take(self, key, start, xs, last):
        tail = self.held()
        x = np.concatenate([tail, xs])
        base = start - tail.size
        half = min(self.overlap // 2, x.size // 2)
        lo = 0 if base == 0 else half
        hi = x.size if last else x.size - half
        own = [(c, s, base + a, base + b, base + p) for c, s, a, b, p in self.found(x) if lo <= p < hi]
        if not last:
            self.keep(x[-min(self.overlap, x.size) :])
        return pd.DataFrame(
            [(key[0], int(key[1]), "clipped" if c else "impulse", a, b, p, s, b - a <= (MAX_EVENT if c else MAX_IMPULSE)) for c, s, a, b, p in own],
            columns=["capture_id", "channel", "kind", "start_ix", "end_ix", "peak_ix", "confidence", "repairable"])


class FluxCarry(InOrder):
    """Spectral flux of consecutive frames: each block's samples are one normalized spectrum."""

    def take(self, key, start, xs, last):
        before = self.held()
        flux = float(np.maximum(xs - before, 0.0).sum()) if before.size else 0.0
        self.keep(xs)
        return pd.DataFrame({"capture_id": [key[0]], "channel": [int(key[1])], "win_ix": [start], "flux": [min(1.0, flux)]})


def _carried(stream: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """State with variables needs the RocksDB store: set spark.sql.streaming.stateStore.providerClass to STORE."""
    return stream.groupBy("capture_id", "channel").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def stream_envelope(stream: DataFrame, window: int) -> DataFrame:
    return _carried(stream, EnvelopeCarry(window), "capture_id string, channel int, win_ix bigint, rms_db double")


def stream_events(stream: DataFrame) -> DataFrame:
    return _carried(stream, EventCarry(), EVENTS)


EVENTS = "capture_id string, channel int, kind string, start_ix bigint, end_ix bigint, peak_ix bigint, confidence double, repairable boolean"


def stream_flux(stream: DataFrame) -> DataFrame:
    """One row per frame; `start_sample` carries the frame number and is the order key's value."""
    return _carried(stream, FluxCarry(), "capture_id string, channel int, win_ix bigint, flux double")


def run_available(out: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived and stop; the parquet sink and the checkpoint make each output row appear once."""
    q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
