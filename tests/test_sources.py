"""Files in, files out: track lists, records, blocks, cue sheets, stores."""

import hashlib
import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lacquer.functions.text import cue_quoted, duration, identity_text
from lacquer.operators import validate as va
from lacquer.sources import blocks as bl
from lacquer.sources import sinks
from lacquer.sources import stores as st
from lacquer.sources import tracklists as tl


def test_text_track_list(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿Artist: Someone\n# note\n\n01 | One\tTwo | 3:05\nA2. Second 4:10\n3) Third | 1:61\n5 | 90\nAlbum Artist: X\n")
    docs = tl.read_documents(spark, str(tmp_path))
    got = [(r.position, r.title, r.duration) for r in tl.parse_text(docs).orderBy("position").collect()]
    assert got == [(1, "One | Two", 185.0), (2, "Second 4:10", None), (3, "Third | 1:61", None), (4, "5", 90.0)]
    meta = {r.key: r.value for r in tl.text_lines(docs).where("kind = 'metadata'").collect()}
    assert meta == {"artist": "Someone", "album_artist": "X"}


def test_json_track_list(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"artist": "Z", "tracks": [{"title": "One", "duration": "3:05"}, {"name": "Two", "length": "1:02:03.5"}, {"duration": "x"}]}))
    got = tl.parse_json(tl.read_documents(spark, str(tmp_path))).orderBy("position").collect()
    assert [(r.title, r.duration, r.valid) for r in got] == [("One", 185.0, True), ("Two", 3723.5, True), ("Track 03", None, False)]


def test_durations(spark):
    cases = {"90": (True, 90.0), "0": (True, None), "-3": (True, None), "nan": (False, None), "inf": (False, None), "3:60": (False, None), "1:60:00": (False, None), "99:59": (True, 5999.0)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: (r.d.valid, r.d.seconds) for r in df.select("t", duration(F.col("t")).alias("d")).collect()} == cases


def test_identity_text_folds_scripts(spark):
    df = spark.createDataFrame([("  Straße Ét",)], "t string")
    assert df.select(identity_text(F.col("t")).alias("x")).first().x == "strasse ét"


def test_records_must_carry_their_hash(spark, tmp_path):
    body = '{"a":1}'
    (tmp_path / (hashlib.sha256(body.encode()).hexdigest() + ".json")).write_text(body)
    (tmp_path / ("0" * 64 + ".json")).write_text(body)
    got = st.verified_records(st.read_records(spark, str(tmp_path))).collect()
    assert sorted(r.intact for r in got) == [False, True]


def test_append_is_idempotent_and_proposals_are_written_once(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("x",), ("y",), ("x",)], "body string")
    st.append_records(first.limit(0), first, path)
    st.append_records(spark.read.parquet(path), first, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(AnalysisException):
        st.write_new(first, path)


def test_range_filter_reaches_the_block_scan(spark, tmp_path):
    path = str(tmp_path / "blocks")
    s = spark.range(5000).select(F.lit("c").alias("capture_id"), F.lit(0).alias("channel"), F.col("id").alias("sample_ix"), F.col("id").cast("double").alias("amp"))
    bl.write_blocks(bl.to_blocks(s, 64), path)
    part = bl.read_range(bl.read_blocks(spark, path), 640, 1000, 64)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block_ix,10)" in plan and "LessThanOrEqual(block_ix,15)" in plan
    assert part.count() == 360


def test_cue_sheet_file(spark, tmp_path):
    t = spark.createDataFrame([("al", 1, "A", 1, 'Say "hi"', "Me", "a.wav", 0, "T", "Me"), ("al", 1, "A", 2, "Two", "Me", "a.wav", 44100 * 61, "T", "Me")],
                              "album string, side_order int, label string, album_number int, title string, artist string, file_path string, file_start bigint, album_title string, album_artist string")
    sinks.write_cues(sinks.cue_lines(t, 44100), str(tmp_path / "cue"))
    text = [r.value for r in spark.read.text(str(tmp_path / "cue"), wholetext=True).collect()][0]
    assert text.splitlines()[3:9] == ['REM SIDE "A"', 'FILE "a.wav" WAVE', "  TRACK 01 AUDIO", "    TITLE \"Say ''hi''\"", '    PERFORMER "Me"', "    INDEX 01 00:00:00"]
    assert text.splitlines()[-1] == "    INDEX 01 01:01:00"


def test_payload_guard():
    deep = json.dumps({"a": 1})
    for _ in range(13):
        deep = '{"a":' + deep + "}"
    assert va.payload_problem('{"note":"ok","n":[1,2.5,null,true]}') == ""
    assert [va.payload_problem(x) for x in ('{"file_name":1}', '{"myfilepath":1}', deep, '{"n":1e999}', '{"A":1}', "{", json.dumps({"a": list(range(3000))}))] == [
        "private_key", "private_key", "too_deep", "not_finite", "key_not_supported", "not_json", "too_many_items"]


def test_payload_guard_walks_to_the_end():
    assert va.payload_problem(json.dumps({"a": [*range(3000), {"password": 1}]})) == "private_key"
    deep = '{"file":1}'
    for _ in range(40):
        deep = '{"a":' + deep + "}"
    assert va.payload_problem(deep) == "private_key"
    assert va.payload_problem("[" * 200_000 + "]" * 200_000) == "too_deep"


def test_expired_rows_are_flagged_not_dropped(spark):
    from lacquer.sources import stores as st

    h = spark.createDataFrame([("p", i, 10) for i in range(8)] + [("q", 0, 500)], "project_id string, sequence bigint, bytes bigint")
    got = {(r.project_id, r.sequence): r.expired for r in st.retained_history(h, 5, 30).collect()}
    assert got == {**{("p", i): i < 5 for i in range(8)}, ("q", 0): False}
    e = spark.createDataFrame([("p", i, i, "set", "s") for i in range(6)] + [("p", 5, 9, "remove", None)], "project_id string, name_key bigint, sequence bigint, action string, state string")
    assert {r.name_key: r.expired for r in st.latest_checkpoints(e, 2).collect()} == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_export_manifest_tells_order_over_file_edges(spark, tmp_path):
    from lacquer.sources import stores as st

    docs = spark.createDataFrame([(f"text {i % 700}",) for i in range(1000)], "body string").repartition(6)
    m = st.write_export(docs, f"{tmp_path}/a").orderBy("first").collect()
    hashes = sorted(hashlib.sha256(f"text {i}".encode()).hexdigest() for i in range(700))
    at = 0
    for r in m:
        assert (r.first, r.last, r.offset, r.ordered) == (hashes[at], hashes[at + r.records - 1], at, True)
        at += r.records
    assert at == 700 and len(m) >= 1
    two = spark.createDataFrame([(h,) for h in hashes], "sha256 string")
    two.coalesce(1).where(F.col("sha256") > hashes[300]).write.parquet(f"{tmp_path}/b")
    two.coalesce(1).where(F.col("sha256") < hashes[302]).write.mode("append").parquet(f"{tmp_path}/b")
    assert not all(r.ordered for r in st.export_manifest(spark.read.parquet(f"{tmp_path}/b")).collect())
    two.coalesce(1).sort(F.desc("sha256")).write.parquet(f"{tmp_path}/c")
    assert not st.export_manifest(spark.read.parquet(f"{tmp_path}/c")).first().ordered


def test_cycles_equal_depth_first_search(spark):
    rng = random.Random(2)
    edges, want = [], set()
    for g in range(60):
        n = rng.randint(2, 14)
        own = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, n + 2))}
        own = [(a, b) for a, b in own if a != b and (g % 3 or a < b)]
        edges += [(g, a, b) for a, b in own]
        reach = set(own)
        while more := {(a, d) for a, b in reach for c, d in own if b == c} - reach:
            reach |= more
        want |= {g} if any(a == b for a, b in reach) else set()
    edges += [(100, i, i + 1) for i in range(10_000)] + [(101, i, i + 1) for i in range(3000)] + [(101, 3000, 0)] + [(102, i, i + 1) for i in range(50)] + [(102, 30, 10)]
    df = spark.createDataFrame(edges, "graph bigint, node bigint, depends_on bigint")
    assert {r.graph for r in va.cyclic_graphs(df).collect()} == want | {101, 102}


def test_long_cycles_are_found(spark):
    nodes = [("g", f"n{i}") for i in range(30)] + [("h", f"n{i}") for i in range(30)]
    edges = [("g", f"n{i}", f"n{i + 1}") for i in range(29)] + [("h", f"n{i}", f"n{(i + 1) % 30}") for i in range(30)] + [("g", "n3", "gone")]
    got = va.graph_problems(spark.createDataFrame(nodes, "graph string, node string"), spark.createDataFrame(edges, "graph string, node string, depends_on string"))
    assert {(r.graph, r.code) for r in got.collect()} == {("h", "cycle"), ("g", "missing_node")}


def test_repeated_labels_are_not_repinned(spark):
    album = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "z", 1), ("a", "w", 1)], "album string, label string, pin int")
    current = spark.createDataFrame([("a", "x", 2), ("a", "y", 2), ("a", "y", 3), ("a", "w", 5)], "album string, label string, pin int")
    got = {r.label: (r.pin, r.reason, r.repinned) for r in st.pin_state(album, current, ["pin"], F.col("label") != "w").collect()}
    assert got == {"x": (2, None, True), "y": (1, "repeated_label", False), "z": (1, "unknown_label", False), "w": (1, None, False)}


def test_match_documents_are_read_once(spark):
    from lacquer.sources.catalogs import parse_matches

    rel = '{"releases":[{"id":"r1","title":"A"},{"id":"r1","title":"a"},null,{"id":"","title":""}],"id":"g"}'
    rec = lambda t, g: f'{{"id":"x","title":"{t}","artists":[{{"name":"N"}}],"releasegroups":[{g}]}}'
    body = f'{{"results":[{{"score":".5","recordings":[{rec("One", rel)}]}},{{"score":".7","recordings":[{rec("ONE", rel + ",null")},{rec("Two", "")}]}}]}}'
    out = parse_matches(spark.createDataFrame([(1, body)], "doc int, body string"))
    assert sorted((r.title, r.score, r.release_count) for r in out.collect()) == [("ONE", 0.7, 1), ("Two", 0.7, 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "Join" not in plan


def test_ranks_of_long_and_short_keys(spark):
    from lacquer.operators.ordering import rank_by

    df = spark.range(300).selectExpr("id % 3 as k", "id * 37 % 101 as v", "id")
    order = [F.col("v").desc(), F.col("id").asc()]
    few, many = (sorted(map(tuple, rank_by(df, ["k"], order, chunk=n).collect())) for n in (1000, 20))
    assert few == many and {r[-1] for r in few} == set(range(1, 101))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_payloads_are_parsed_once(spark):
    from lacquer.sources import catalogs as cat

    release = '{"id":"r","media":[{"format":"12\\" Vinyl","tracks":[{"number":"A1","title":"x","length":1000}]}]}'
    docs = spark.createDataFrame([(1, release), (2, "{}"), (3, "no json"), (4, None)], "doc int, body string")
    tracks = cat.release_tracks(cat.parse_releases(docs))
    assert [(r.doc, r.medium, r.side, r.side_position, r.duration) for r in tracks.collect()] == [(1, 1, "A", 1, 1.0)]
    lists = spark.createDataFrame([(1, '[{"title":"x","duration":"0:34"}]'), (2, '{"tracks":[]}'), (3, None)], "doc int, body string")
    songs = tl.parse_json(lists)
    assert [(r.doc, r.title, r.duration, r.valid) for r in songs.collect()] == [(1, "x", 34.0, True)]
    assert plan_of(tracks).count("from_json(") == plan_of(songs).count("from_json(") == 1


def test_text_lines_are_cut_once_and_lines_without_fields_left_out(spark):
    lines = spark.createDataFrame([(1, "1 | x | 0:34\n | |\n2 | y"), (2, "|")], "doc int, body string")
    got = tl.parse_text(lines)
    assert [(r.doc, r.position, r.title, r.duration) for r in got.orderBy("position").collect()] == [(1, 1, "x", 34.0), (1, 2, "y", None)]
    assert plan_of(got).count(r"\t|\s*\|\s*") == 1


def test_clock_parts_are_cut_without_the_pattern(spark):
    text = ["1:02:03.25", "0:34", "12:05\n", "9:99", "1:61:00", "1:2:3:4", "a:b:12", "1:30.", "100:10", "12:30.5.5", "nan", " 7 ", ""]
    want = [3723.25, 34.0, 725.0, None, None, None, None, None, None, None, None, 7.0, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").select("i", duration(F.col("t")).alias("d"))
    assert [r.d.seconds for r in df.orderBy("i").collect()] == want
    assert "regexp_extract(trim" not in plan_of(df.select("d.seconds"))


def test_graph_nodes_are_grouped_once(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "graph int, node string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (2, "c", "c"), (2, "c", "x"), (3, "y", "y")], "graph int, node string, depends_on string")
    got = va.graph_problems(nodes, edges)
    assert sorted((r.graph, r.code) for r in got.collect()) == [
        (1, "cycle"), (1, "duplicate_node"), (2, "missing_node"), (2, "self_edge"), (3, "missing_node"), (3, "self_edge")]
    assert "Join" not in plan_of(got)


def test_cue_line_counts_are_those_of_the_lines(spark):
    rows = [(a, 1 + n // 3, n + 1, f"s{n // f}.wav") for a, f in (("x", 3), ("y", 2), ("z", 9)) for n in range(7)]
    t = spark.createDataFrame(rows, "album string, side_order int, album_number int, file_path string")
    t = t.selectExpr("*", "'l' label", "'t' title", "'p' artist", "0L file_start", "'a' album_title", "'b' album_artist")
    lines = sinks.cue_lines(t, 1000).groupBy("album").count()
    counts = sinks.cue_line_counts(t)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, lines.collect()))
    assert "regexp_replace" not in plan_of(counts)


CUE_TRACKS = "album string, side_order int, album_number int, file_path string"


def test_cue_tracks_are_ordered_once_and_without_their_texts(spark):
    """Texts made behind cue_starts() stay out of the sort, and no track is copied for its successor."""
    rows = [(a, 1 + n // 3, n + 1, f"s{n // f}.wav") for a, f in (("x", 3), ("y", 2)) for n in range(7)]
    started = sinks.cue_starts(spark.createDataFrame(rows, CUE_TRACKS))
    t = started.selectExpr("*", "concat('Side ', side_order) label", "concat('Part ', album_number) title", "'p' artist", "0L file_start", "'a' album_title", "'b' album_artist")
    plan = plan_of(sinks.started_lines(t, 1000))
    assert plan.count("Sort [") == 1 and "sequence(" not in plan
    assert "Part " not in plan[plan.index("Sort ["):]


def test_cue_starts_of_long_and_short_albums(spark):
    rows = [(a, 1 + n // 3, n + 1, f"s{n // f % 2}.wav") for a, f, m in (("x", 3, 40), ("y", 2, 7), ("z", 9, 1)) for n in range(m)]
    t = spark.createDataFrame(rows[::-1], CUE_TRACKS)
    got = [sorted(map(tuple, sinks.cue_starts(t, chunk=c).select("album", "album_number", "_first", "_new_side", "_new_file").collect())) for c in (5, 1000)]
    assert got[0] == got[1]
    want = [(a, n, n == 1, (n - 1) % 3 == 0, n == 1 or p != q) for a, n, p, q in
            ((a, n, p, rows[i - 1][3]) for i, (a, _, n, p) in enumerate(rows))]
    assert got[1] == sorted(want)


def test_cue_text_is_one_line(spark):
    text = ["a\x00b", " \x00 a \t\n b\x00", 'say  "x"', ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(text)], "i int, t string")
    assert [r.q for r in df.orderBy("i").select(cue_quoted(F.col("t")).alias("q")).collect()] == ['"a b"', '"a b"', "\"say ''x''\"", '""']
