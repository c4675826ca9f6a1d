"""Requested evidence windows, and the evaluation of a reviewed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as ev
from ..operators import envelope
from ..operators import spectral as sx
from ..session import stage


def evidence_windows(blocks: DataFrame, requests: DataFrame, rate: int, block: int, points: int = 240, bands: int = 64) -> dict[str, DataFrame]:
    """Waveform, spectrogram, transients and focus comparison of many requested windows.

    requests: (capture_id, request_id, start_ix, end_ix); the focus is a window's middle sample.
    """
    cut = stage(sx.cut_windows(blocks, requests, block, ["request_id"]))
    side = stage(sx.all_channels(cut, ["request_id"]))
    flat = cut.select("request_id", "channel", F.posexplode("samples").alias("sample_ix", "amp"))
    return {
        "waveform": envelope.minmax_buckets(flat, points, ["request_id", "channel"]),
        "spectrogram": sx.measured(side, sx.spectrogram(rate, bands), sx.SPECTROGRAM_SCHEMA, "channels"),
        "focus": sx.focus_compared(sx.measured(side, sx.focus_measures(rate), sx.FOCUS_SCHEMA, "channels"), rate),
    }


def evaluate_corpus(records: DataFrame, cfg: ev.EvaluationConfig, baseline: str | None = None, candidate: str | None = None) -> dict[str, DataFrame]:
    """Coverage, split, typed metrics, sufficiency and, when two configs are named, their paired comparison."""
    r = stage(ev.with_split(records.drop("split"), cfg))
    metrics = stage(ev.typed_metrics(r, cfg))
    out = {
        "coverage": ev.coverage(r), "configs": ev.keyed_coverage(r, ["config"]), "kinds": ev.keyed_coverage(r, ["kind"]),
        "splits": ev.split_report(r), "metrics": metrics, "sufficiency": ev.sufficiency(r, metrics),
    }
    if baseline and candidate:
        out["comparison"] = ev.compare_configs(r, baseline, candidate, cfg)
    return out
