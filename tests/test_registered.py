"""Registered queries against their SQL on tables that give each of them rows: one or more of every family."""

import pytest

import __spark_entry__ as entry
import check

SAMPLE = [
    "e1_rms_envelope", "e5_gap_statistics", "g8_automatic_selection", "d2_clip_anti_join", "b16_hash_split", "e21_paired_comparison",
    "e14_robust_ratio", "j7_identify_release", "f16_feasible_targets", "c5_side_contiguity", "a6_match_payload", "d11_inventory_diff",
    "j14_catalog_status", "f24_complement_ranges", "i8_profile_reduction", "j1_admitted_segments", "j6_guarded_speed",
    "j7_guarded_identity", "j17_evidence_window",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, sf_dir, name):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    con = check.connect(sf_dir)
    note, ok = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert ok, note


def test_every_query_can_be_built(spark, sf_dir):
    """Every entry gives a plan at the smallest scale, whatever its builder runs for it."""
    from concurrent.futures import ThreadPoolExecutor

    def build(name):
        try:
            assert entry.queries()[name](spark, sf_dir).columns
        except Exception as e:
            return f"{name}: {type(e).__name__} {str(e)[:300]}"

    with ThreadPoolExecutor(4) as pool:
        bad = [x for x in pool.map(build, sorted(entry.queries())) if x]
    assert not bad, bad


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["i13_clipped_runs", "e28_merge_channels", "b15_event_identity", "e31_render_metrics"])
def test_clips_equal_their_sql_where_a_run_is_uneven(spark, tmp_path, name):
    """A run whose first sample is short of full scale, and one that bridges samples of the value they are patched with."""
    import duckdb

    con = duckdb.connect()
    con.execute("""create table events as select i as event_id, timestamp '2024-01-01' + interval (i) second as ts, i % 7 as user_id,
        case when i < 400 then 'a' else 'b' end as event_type, '{"k": 1}' as props,
        case i % 400 when 100 then 249.99 when 101 then 269.99 when 103 then 400.0 when 104 then 150.0 when 105 then 160.0
          when 106 then 300.0 else 60.0 end as value from range(800) t(i)""")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    note, ok = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert ok, note
