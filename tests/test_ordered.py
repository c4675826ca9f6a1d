"""Chunked ordered operators against plain NumPy, with chunks small enough to cross many edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacquer.operators import ordered as od
from lacquer.operators import quantiles as qt
from lacquer.operators import regions as rg
from lacquer.operators.envelope import smooth, summarize_waveform
from lacquer.operators.intervals import overlapping, points_in


def series(spark, values, key="a"):
    rows = [(key, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ix bigint, v double")


def test_dense_index_equals_a_global_order(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 3 else "b", int(t), i) for i, t in enumerate(rng.integers(0, 40, 300))]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint")
    got = od.dense_index(df, ["k"], ["t", "id"], F.expr("t div 7"), "ix").collect()
    for k in "ab":
        ordered = sorted((r.t, r.id) for r in got if r.k == k)
        assert [r.ix for r in sorted((r for r in got if r.k == k), key=lambda r: (r.t, r.id))] == list(range(len(ordered)))


@pytest.mark.parametrize("chunk", [20, 1000])
def test_dense_index_of_long_and_short_keys(spark, chunk):
    """Keys over and under `chunk` rows get the same positions and running sums."""
    rng = np.random.default_rng(3)
    rows = [("a" if i % 9 else f"b{i % 4}", int(t), i, int(i % 5)) for i, t in enumerate(rng.integers(0, 40, 300))]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint, v bigint")
    got = od.dense_index(df, ["k"], ["t", "id"], F.expr("t div 7"), "ix", {"total": F.col("v")}, chunk=chunk).collect()
    assert len(got) == 300
    for k in {r.k for r in got}:
        own = sorted((r for r in got if r.k == k), key=lambda r: (r.t, r.id))
        assert [r.ix for r in own] == list(range(len(own)))
        assert [r.total for r in own] == np.cumsum([r.v for r in own]).tolist()


@pytest.mark.parametrize("chunk", [4, 7, 1000])
def test_smoothing_repeats_the_ends(spark, chunk):
    x = np.random.default_rng(2).normal(size=50)
    env = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)], "capture_id string, win_ix bigint, rms_db double")
    got = [r.db for r in smooth(env, 5, chunk).orderBy("win_ix").collect()]
    want = np.convolve(np.pad(x, 2, mode="edge"), np.ones(5) / 5, mode="valid")
    assert np.allclose(got, want)


def test_smoothing_leaves_short_series(spark):
    env = spark.createDataFrame([("c", 0, 1.0), ("c", 1, 5.0)], "capture_id string, win_ix bigint, rms_db double")
    assert [r.db for r in smooth(env, 5).orderBy("win_ix").collect()] == [1.0, 5.0]


@pytest.mark.parametrize("chunk", [3, 5, 64])
@pytest.mark.parametrize("gap", [0, 2])
def test_runs_cross_chunk_edges(spark, chunk, gap):
    mask = np.random.default_rng(3).random(200) < 0.6
    got = od.flag_runs(series(spark, mask), ["k"], "ix", F.col("v") > 0, gap, chunk=chunk)
    runs, at = [], np.flatnonzero(mask)
    for group in np.split(at, np.flatnonzero(np.diff(at) > gap + 1) + 1):
        runs.append((int(group[0]), int(group[-1]) + 1, len(group)))
    assert sorted((r.start_ix, r.end_ix, r.n_parts) for r in got.collect()) == runs


def test_a_run_over_the_whole_series(spark):
    got = od.flag_runs(series(spark, np.ones(100)), ["k"], "ix", F.col("v") > 0, chunk=8).collect()
    assert [(r.start_ix, r.end_ix, r.n_parts) for r in got] == [(0, 100, 100)]


@pytest.mark.parametrize("chunk", [4, 9])
def test_prefix_sum_and_max(spark, chunk):
    x = np.random.default_rng(4).integers(-5, 9, 60).astype(float)
    df = series(spark, x)
    s = [r.s for r in od.prefix_sums(df, ["k"], "ix", {"s": F.col("v")}, chunk).orderBy("ix").collect()]
    m = [r.m for r in od.prefix_max(df, ["k"], "ix", F.col("v"), "m", chunk).orderBy("ix").collect()]
    assert np.allclose(s, np.cumsum(x)) and np.allclose(m, np.maximum.accumulate(x))


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    data = {"mixed": np.r_[rng.normal(size=301), np.zeros(40), -rng.exponential(size=77)], "same": np.full(25, -3.5), "one": np.array([2.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in qt.exact_quantiles(df, ["k"], "v", {"a": 0.03, "b": 0.5, "c": 0.9}, count_name="n").collect()}
    low = {r.k: r for r in qt.exact_quantiles(df, ["k"], "v", {"a": 0.05, "c": 0.9}, method="lower").collect()}
    for k, vs in data.items():
        assert np.allclose([got[k].a, got[k].b, got[k].c], np.percentile(vs, [3, 50, 90])) and got[k].n == len(vs)
        o = np.sort(vs)
        assert low[k].a == o[int((len(o) - 1) * 0.05)] and low[k].c == o[int((len(o) - 1) * 0.9)]


@pytest.mark.parametrize("silent", [10, 300])
def test_silent_windows_are_left_out_unless_too_few_remain(spark, silent):
    x = np.r_[np.full(silent, -120.0), np.random.default_rng(9).uniform(-60, -10, 25 if silent == 10 else 15)]
    r = qt.exact_quantiles(series(spark, x), ["k"], "v", {"a": 0.5}, skip_at_most=-90.0, min_kept=F.greatest(F.lit(20), F.expr("_n div 200"))).first()
    kept = x[x > -90]
    assert np.isclose(r.a, np.median(kept if kept.size >= 20 else x))


def test_median_and_mad(spark):
    x = np.random.default_rng(6).normal(size=99)
    r = qt.median_mad(series(spark, x), ["k"], "v", "c", "m", "n").first()
    assert np.isclose(r.c, np.median(x)) and np.isclose(r.m, np.median(np.abs(x - np.median(x)))) and r.n == 99


def test_interval_joins_meet_each_pair_once(spark):
    rng = np.random.default_rng(7)
    a = [(i, int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(0, 300, 40), rng.integers(1, 90, 40)))]
    b = [(i, int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(0, 300, 40), rng.integers(1, 90, 40)))]
    left = spark.createDataFrame([("x", *r) for r in a], "k string, l bigint, start_ix bigint, end_ix bigint")
    right = spark.createDataFrame([("x", *r) for r in b], "k string, r bigint, r_start bigint, r_end bigint")
    got = sorted((r.l, r.r) for r in overlapping(left, right, ["k"], bucket=16).collect())
    assert got == sorted((i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e)
    pts = spark.createDataFrame([("x", p) for p in range(0, 400, 3)], "k string, ix bigint")
    none = sorted(r.ix for r in points_in(pts, left, ["k"], "ix", bucket=16, how="left_anti").collect())
    assert none == [p for p in range(0, 400, 3) if not any(s <= p < e for _, s, e in a)]


def test_complement_of_nested_regions(spark):
    r = spark.createDataFrame([("s", 10, 90), ("s", 20, 30), ("s", 85, 100), ("s", 150, 160)], "scope_id string, start_sample bigint, end_sample bigint")
    sc = spark.createDataFrame([("s", 0, 200), ("bare", 5, 9)], "scope_id string, scope_start bigint, scope_end bigint")
    got = sorted((x.scope_id, x.start_sample, x.end_sample) for x in rg.complement(r, sc, wide=32).collect())
    assert got == [("bare", 5, 9), ("s", 0, 10), ("s", 100, 150), ("s", 160, 200)]


def test_waveform_edges_equal_truncated_linspace(spark):
    x = np.random.default_rng(8).uniform(-80, 0, 997)
    env = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)], "capture_id string, win_ix bigint, db double")
    got = [r.level for r in summarize_waveform(env, 120).orderBy("bucket").collect()]
    edges = np.linspace(0, 997, 121, dtype=np.int64)
    level = np.clip((x + 72) / 66, 0, 1)
    assert np.allclose(got, [round(float(level[a:b].max()), 5) for a, b in zip(edges, edges[1:])])


def test_ranks_of_a_hot_key_spread_over_ranges(spark):
    """One key with equal leading columns: the whole order tuple cuts it, so no range holds more than its share."""
    from lacquer.operators.ordering import rank_by

    df = spark.range(40_000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("k"), F.lit(1.0).alias("score"),
        F.when(F.col("id") % 3 == 0, None).otherwise(F.xxhash64("id") % 5000).alias("title"), "id")
    order = [F.col("score").desc(), F.col("title").asc(), F.col("id").desc()]
    got = {(r.k, r.id): r["rank"] for r in rank_by(df, ["k"], order).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r.k, []).append((r.title is not None, r.title or 0, -r.id))
    for k, rows in by.items():
        assert [got[k, -i] for _, _, i in sorted(rows)] == list(range(1, len(rows) + 1))
    cut = df.repartitionByRange(4, "k", *order).groupBy(F.spark_partition_id().alias("p")).count()  # as many as asked for: not drawn together
    assert cut.agg(F.max("count")).first()[0] < 20_000


def test_index_of_short_keys_leaves_rows_dealt_by_the_key(spark):
    """Steps by the same key that follow need no second shuffle."""
    df = spark.range(400).select((F.col("id") % 90).alias("k"), "id")
    got = od.dense_index(df, ["k"], ["id"], F.expr("id div 7"), "ix").groupBy("k").agg(F.max("ix").alias("top"), F.sum("ix").alias("s"))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    assert {(r.k, r.top) for r in got.collect()} == {(k, len(range(k, 400, 90)) - 1) for k in range(90)}


@pytest.mark.parametrize("chunk", [20, 1000])
def test_quantiles_of_long_and_short_keys(spark, chunk):
    """Keys over and under `chunk` rows, the same results; nulls do not count."""
    rng = np.random.default_rng(8)
    x = {"a": rng.normal(size=300).round(2), "b": rng.normal(size=7), "c": np.array([-3.0]), "d": np.array([2.0, -1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in x.items() for v in vs] + [("a", None), ("e", None)], "k string, v double")
    got = {r.k: r for r in qt.exact_quantiles(df, ["k"], "v", {"p": 0.3, "q": 0.9}, count_name="n", chunk=chunk).collect()}
    low = {r.k: r for r in qt.exact_quantiles(df, ["k"], "v", {"p": 0.3}, method="lower", chunk=chunk).collect()}
    mad = {r.k: r for r in qt.median_mad(df, ["k"], "v", "c", "m", "n", chunk=chunk).collect()}
    assert set(got) == set(low) == set(mad) == set(x)
    for k, v in x.items():
        assert got[k].n == mad[k].n == v.size
        assert np.allclose([got[k].p, got[k].q], np.quantile(v, [0.3, 0.9])) and low[k].p == np.quantile(v, 0.3, method="lower")
        assert np.allclose([mad[k].c, mad[k].m], [np.median(v), np.median(np.abs(v - np.median(v)))])


def test_quantiles_of_short_keys_take_one_shuffle(spark):
    df = spark.range(400).select((F.col("id") % 90).alias("k"), F.rand(1).alias("v"))
    plan = qt.median_mad(df, ["k"], "v", "c", "m", "n")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_complement_of_short_and_long_scopes(spark):
    rng = np.random.default_rng(5)
    rows = [(s, int(a), int(a + n)) for s in range(6) for a, n in zip(rng.integers(10, 400, 4 * s), rng.integers(0, 40, 4 * s))] + [(9, 50, 50)]
    r = spark.createDataFrame(rows, "scope_id int, start_sample bigint, end_sample bigint")
    sc = spark.createDataFrame([(s, 0, 500) for s in [*range(6), 9]], "scope_id int, scope_start bigint, scope_end bigint")
    want = []
    for s in [*range(6), 9]:
        free = [i for i in range(500) if not any(x == s and a <= i < b for x, a, b in rows)]
        starts = [i for i in free if i - 1 not in free]
        want += [(s, a, next(i for i in range(a, 501) if i not in free)) for a in starts]
    for chunk in (1 << 16, 8):
        got = rg.complement(r, sc, wide=32, chunk=chunk)
        assert sorted((x.scope_id, x.start_sample, x.end_sample) for x in got.collect()) == sorted(want)


def test_many_short_keys_are_dealt_into_parts_that_fit_a_task(spark):
    """More rows than the session's partitions may hold go to more parts; a key stays in one, positions are the same."""
    df = spark.range(4000).select((F.col("id") % 500).alias("k"), "id")
    many, few = od.dealt(df, ["k"], 4000, most=100), od.dealt(df, ["k"], 4000, most=1000)
    assert many.rdd.getNumPartitions() == 40 and few is df
    assert many.select("k", F.spark_partition_id().alias("p")).distinct().count() == 500
    got = od.dense_index(many, ["k"], ["id"], F.expr("id div 7"), "ix")
    assert got.where("ix <> id div 500").count() == 0


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_crowded_buckets_hold_all_long_keys(spark, buckets):
    rows = [(k, "x" if k % 2 else None) for k in range(40) for _ in range(k % 7 + (60 if k in (3, 18) else 0))]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    crowded = od.maybe_long(df, ["k", "t"], 50, buckets)
    assert sorted(r.k for r in od.long_keys(crowded, ["k", "t"], 50).collect()) == [3, 18]
    assert od.maybe_long(df, ["k", "t"], 300, buckets) is None
    src = spark.createDataFrame([(k, i) for k in range(5) for i in range(30 * (k == 2) + 3)], "k int, i int").repartition(3)
    got = od.dense_index(src, ["k"], ["i"], F.expr("i div 4"), "ix", chunk=20, undealt=True)
    assert {(r.k, r.i, r.ix) for r in got.collect()} == {(k, i, i) for k in range(5) for i in range(30 * (k == 2) + 3)}
