"""Stream results equal the batch ones when blocks come out of order and are replayed."""

import numpy as np
import pytest

from lacquer.operators.impulses import impulse_events
from lacquer.sources.blocks import to_blocks
from lacquer.streaming import carries


def feed(spark, root, name, rows):
    spark.createDataFrame(rows, carries.BLOCK_STREAM).coalesce(1).write.mode("append").parquet(f"{root}/{name}")


def pieces(x, size, channel=0):
    n = -(-len(x) // size)
    return [("c", channel, k, k * size, x[k * size : (k + 1) * size].tolist(), k == n - 1) for k in range(n)]


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", carries.STORE)


def test_envelope_waits_for_early_blocks_and_ignores_replays(spark, tmp_path):
    root, x = str(tmp_path), np.random.default_rng(1).normal(size=1003)
    p = pieces(x, 100)
    for batch in ([p[2], p[0]], [p[1], p[0]], [p[4], p[3], p[2]], p[5:]):
        feed(spark, root, "in", batch)
        out = carries.stream_envelope(carries.read_block_stream(spark, f"{root}/in"), 7)
        carries.run_available(out, f"{root}/out", f"{root}/state")
    got = spark.read.parquet(f"{root}/out").orderBy("win_ix").collect()
    want = [20 * np.log10(np.sqrt(np.mean(x[k : k + 7] ** 2))) for k in range(0, 1003, 7)]
    assert [r.win_ix for r in got] == list(range(len(want))) and np.allclose([r.rms_db for r in got], want)


def test_events_match_the_batch_scan(spark, tmp_path):
    root, n = str(tmp_path), 16000
    x = 0.05 * np.sin(2 * np.pi * 40 * np.arange(n) / 8000) + np.random.default_rng(2).normal(0, 1e-4, n)
    x[np.arange(700, n - 500, 1300)] += 0.4
    feed(spark, root, "in", pieces(x, 4096) + pieces(-x[::-1], 4096, 1) + pieces(x, 4096)[:2])
    carries.run_available(carries.stream_events(carries.read_block_stream(spark, f"{root}/in")), f"{root}/out", f"{root}/state")
    got = spark.read.parquet(f"{root}/out")
    assert got.where("channel = 1").count() > 5
    s = spark.createDataFrame([("c", 0, i, float(v)) for i, v in enumerate(x)], "capture_id string, channel int, sample_ix bigint, amp double")
    batch = {r.peak_ix for r in impulse_events(to_blocks(s, 4096)).where("confidence > 0.5").collect()}
    assert {r.peak_ix for r in got.where("channel = 0 and confidence > 0.5").collect()} == batch
