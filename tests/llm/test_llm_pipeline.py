"""The corpus pipeline: every stage against brute force on its own input, on the smallest tables, and run() as a whole."""

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from lacquer.llm import bpe, rules
from test_llm_operators import WORD, brute_components, brute_stats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows before the first stage and after each, read back from Parquet as the pipeline does."""
    root, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, step) in enumerate(pipeline.STAGES):
        step(spark, out[-1], sf_dir).write.parquet(f"{root}/{k}")
        out.append(spark.read.parquet(f"{root}/{k}"))
    return [d.collect() for d in out], [d.columns for d in out]


def test_columns_stay_until_the_last_stage(stages):
    assert stages[1][:-1] == [COLUMNS] * 5 and stages[1][-1][:4] == ["doc_id", "lang", "source", "n_chars"]


def test_quality_stage_drops_what_the_rules_reject(spark, sf_dir, stages):
    before, after = stages[0][0], stages[0][1]
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in rules.judge(docs, rules.learned(docs, labels)).collect()}
    assert {r.doc_id for r in after} == {i for i, (_, kept) in verdict.items() if kept}
    for r in before:
        n, _, _, _, repeated = brute_stats(r.text)
        assert verdict[r.doc_id][0] == (n < 20 or 100 * repeated > 30 * n)
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id] == r.text for r in after)


def test_line_stage_takes_spread_lines_out(stages):
    before, after = stages[0][1], {r.doc_id: r for r in stages[0][2]}
    trim = lambda x: x.strip(" \t\n\x0b\f\r")
    sites = defaultdict(set)
    for r in before:
        for x in r.text.split("\n"):
            sites[trim(x)].add(r.source)
    assert len(after) == len(before)
    for r in before:
        own = r.text.split("\n")
        kept = [x for x in own if not trim(x) or len(sites[trim(x)]) < 10]
        want = "\n".join(kept if any(map(trim, kept)) else own)
        assert after[r.doc_id].text == want and (len(want) == after[r.doc_id].n_chars or want == r.text)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[0][2], stages[0][3]
    found = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert {r.doc_id for r in after} == {i for i, (_, c) in found.items() if c == i}


def test_repeated_ids_go_by_their_own_text(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (7, text("b")), (7, text("c")), (7, text("c")), (8, ""), (8, ""), (9, None), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs.repartition(3), "").collect())
    assert got == Counter([(1, text("a")), (5, text("b")), (7, text("c")), (8, ""), (9, None), (None, text("a"))])


def test_mix_comes_near_its_targets(stages):
    before, after = stages[0][3], stages[0][4]
    size = {r.doc_id: len(WORD.findall(r.text)) for r in before}
    times = Counter(r.doc_id for r in after)
    by = defaultdict(list)
    for r in before:
        by[r.source].append(r.doc_id)
    order = sorted(by, key=lambda s: s.encode())
    total, weights = sum(size.values()), [1 + k % 3 for k in range(len(by))]
    own = {s: sum(size[i] for i in by[s]) for s in by}
    goal = {s: total * w / sum(weights) for s, w in zip(order, weights)}
    if all(goal[s] <= 3 * own[s] for s in by):
        for s in by:
            assert abs(sum(times[i] * size[i] for i in by[s]) - goal[s]) <= max(size[i] for i in by[s])
    assert max(times.values()) <= 3 and set(times) <= set(size)


def test_last_stage_encodes_every_row(stages):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = bpe.vocabulary(public.path("byte_bpe_multi_50k.tiktoken")).ranks
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in stages[0][4]}
    assert Counter(r.doc_id for r in stages[0][5]) == Counter(r.doc_id for r in stages[0][4])
    for r in stages[0][5]:
        assert r.ids == encoding.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_same_rows_and_survives_odd_tables(spark, sf_dir, stages, tmp_path):
    got = pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in got) == sorted((r.doc_id, r.ids_sha256) for r in stages[0][5])
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, "no id " * 30, None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0),
           *[(3, "some words of one row given twice " * 9 + " ".join(map(str, range(60))), "en", "a", 9)] * 2]
    for name, rows in (("odd", odd), ("empty", [])):
        spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        out = pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in out} <= {3} and (rows or not out)


def test_stages_stand_any_further_columns(spark, sf_dir):
    """Names that the stages use themselves, on a table with nulls, repeats and empty texts; and an empty table."""
    from pyspark.sql import functions as F

    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(i, text(i % 9) if i % 5 else "", "en", f"s{i % 3}" if i % 4 else None, 9) for i in range(40)] + [(None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    names = ["i", "t", "s", "n", "k", "copies", "tie", "row", "__row", "held", "all", "lines", "removed", "__lines", "__removed", "c0", "c1", "c9",
             "id", "hit", "cut", "__text", "__t", "__n", "__k", "component_id", "n_shingles"]
    wide = docs
    for c in names:
        wide = wide.withColumn(c, F.lit(c))
    plain = lambda rs: Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rs)
    for name, step in pipeline.STAGES[:-1]:
        out = step(spark, wide, sf_dir)
        assert out.columns == wide.columns, name
        got = out.collect()
        assert all(r[c] == c for r in got for c in names), name
        assert plain(got) == plain(step(spark, docs, sf_dir).collect()), name
        assert step(spark, wide.limit(0), sf_dir).collect() == [], name
    out = pipeline.encode(spark, wide, sf_dir)
    assert set(names) <= set(out.columns) and out.count() == wide.count() and pipeline.encode(spark, docs.limit(0), sf_dir).collect() == []
