"""Validation operators: each row or key gets its reason codes, never a bare verdict."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import stage
from .ordered import dense_index, windowed

# Supported profile: fixed values.
RATES = [44100, 48000, 88200, 96000, 176400, 192000]
BITS = [16, 24]
MAX_SECONDS = 6 * 60 * 60
MAX_FILE_BYTES = 64 * 1024**3
MAX_PCM_BYTES = 32 * 1024**3
MAX_WINDOWS = 2_000_000
MAX_SAMPLES = MAX_SECONDS * 192000
CODECS = {
    "flac": ["flac"], "wav": ["pcm_s16le", "pcm_s24le"], "wave": ["pcm_s16le", "pcm_s24le"],
    "aif": ["pcm_s16be", "pcm_s24be"], "aiff": ["pcm_s16be", "pcm_s24be"],
}


def codes(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))


def admission(captures: DataFrame, analysis_rate: int = 8000, window_ms: int = 50) -> DataFrame:
    """Capture metadata against the supported profile. Rejected captures never reach a sample scan."""
    c = F.col
    name_ok = c("filename").isNotNull() & (c("filename") != "") & ~c("filename").rlike(r"[/\x00-\x1f]")
    ext = F.when(name_ok, F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))).otherwise("")
    known = ext.isin(*CODECS)
    codec_ok = F.lit(False)
    for e, names in CODECS.items():
        codec_ok = codec_ok | ((ext == e) & c("codec_name").isin(*names))
    dur, rate, n = c("duration_seconds"), c("sample_rate"), c("sample_count")
    dur_ok = dur.isNotNull() & ~F.isnan(dur) & (dur > 0)
    within = dur_ok & (dur <= MAX_SECONDS)
    bits = c("bits_per_raw_sample")
    n_ok = n.isNotNull() & (n > 0) & (n <= MAX_SAMPLES)
    pcm = n.cast("decimal(20,0)") * c("channels") * F.floor((bits + 7) / 8)
    settings_ok = 1 <= analysis_rate <= 192000 and 1 <= window_ms <= 10000
    width = max(1, (analysis_rate * window_ms + 500) // 1000)
    windows = F.ceil(F.ceil(dur * analysis_rate) / F.lit(width))
    false = F.lit(False)
    yes = lambda x: F.coalesce(x, false)
    reasons = codes(
        (~yes(name_ok), "filename_invalid"), (~yes(known), "container_not_supported"),
        (~yes(codec_ok), "codec_container_not_supported"), (~yes(rate.isin(*RATES)), "sample_rate_not_supported"),
        (~yes(c("channels").isin(1, 2)), "channel_count_not_supported"), (bits.isNull(), "bit_depth_unknown"),
        (bits.isNotNull() & ~bits.isin(*BITS), "bit_depth_not_supported"), (~yes(dur_ok), "duration_invalid"),
        (yes(dur_ok & (dur > MAX_SECONDS)), "duration_exceeds_limit"),
        (~yes(c("size_bytes") > 0), "source_size_invalid"), (yes(c("size_bytes") > MAX_FILE_BYTES), "source_size_exceeds_limit"),
        (n.isNull(), "sample_count_missing"), (yes(n <= 0), "sample_count_invalid"),
        (yes(n > MAX_SAMPLES), "sample_count_exceeds_limit"),
        (yes(n_ok & rate.isin(*RATES) & within & (F.abs(n - F.bround(dur * rate)) > 2)), "sample_count_inconsistent"),
        (yes(n_ok & (pcm > MAX_PCM_BYTES)), "decoded_pcm_exceeds_limit"),
        (F.lit(not settings_ok), "analysis_settings_invalid"),
        (yes(F.lit(settings_ok) & within & (windows > MAX_WINDOWS)), "analysis_window_count_exceeds_limit"),
    )
    return captures.withColumn("reasons", reasons).withColumn("supported", F.size("reasons") == 0)


def region_geometry(regions: DataFrame, scopes: DataFrame) -> DataFrame:
    """Regions ordered, disjoint, inside their scope and uniquely labelled. scopes: (scope_id, scope_start, scope_end)."""
    ix = dense_index(regions, ["scope_id"], ["start_sample", "end_sample", "label"], F.floor(F.col("start_sample") / 1000000), "_ix")
    prev = windowed(ix, ["scope_id"], "_ix", 1, 0, {"_prev": lambda w: F.lag("end_sample").over(w)})
    twice = regions.groupBy("scope_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    j = prev.join(twice, ["scope_id", "label"]).join(scopes, "scope_id", "left")
    return j.withColumn("reasons", codes(
        (F.col("end_sample") <= F.col("start_sample"), "empty_region"),
        (F.coalesce((F.col("start_sample") < F.col("scope_start")) | (F.col("end_sample") > F.col("scope_end")), F.lit(True)), "outside_scope"),
        (F.coalesce(F.col("start_sample") < F.col("_prev"), F.lit(False)), "overlaps_previous"),
        (F.col("_n") > 1, "label_repeats"),
    )).drop("_ix", "_prev", "_n", "scope_start", "scope_end")


def record_strictness(records: DataFrame) -> DataFrame:
    """Digests, ranges, channel order and the agreement of project and source in a review record."""
    hexed = r"^[0-9a-f]{64}$"
    return records.withColumn("reasons", codes(
        (~F.col("record_sha256").rlike(hexed), "record_digest_invalid"),
        (~F.col("source_sha256").rlike(hexed), "source_digest_invalid"),
        (F.col("project_source_sha256") != F.col("source_sha256"), "project_source_disagree"),
        ((F.col("start_frame") < 0) | (F.col("end_frame") <= F.col("start_frame")) | (F.col("end_frame") > F.col("sample_count")), "region_invalid"),
        ((F.size("channels") == 0) | (F.array_sort(F.array_distinct("channels")) != F.col("channels")), "channels_invalid"),
        (F.coalesce(F.element_at("channels", -1) >= F.col("channel_count"), F.lit(True)), "channel_out_of_range"),
    ))


# Fixed word lists of the privacy guard.
PRIVATE_PARTS = {
    "api_key", "audio", "base64", "bearer", "blob", "credential", "data_uri", "file", "password", "path", "pcm",
    "secret", "samples", "spectrogram", "token", "waveform",
}
PRIVATE_STARTS = (
    "api_key", "audio", "base64", "bearer", "credential", "file", "password", "pcm", "secret", "token", "waveform",
)
PRIVATE_ENDS = ("path", "filename")
MAX_DEPTH, MAX_ITEMS = 12, 2048


def payload_problem(text: str | None) -> str:
    """First problem of one JSON payload: key shape, private keys, numbers out of range, path-like text; depth and size
    where nothing else is wrong. The walk goes to the end, so what lies behind a limit is named all the same."""
    try:
        todo = [(json.loads(text), 0)]
    except RecursionError:
        return "too_deep"
    except (TypeError, ValueError):
        return "not_json"
    seen, deepest = 0, 0
    while todo:
        item, depth = todo.pop()
        seen += 1
        deepest = max(deepest, depth)
        if isinstance(item, float) and not math.isfinite(item):
            return "not_finite"
        if type(item) is int and not -(1 << 63) <= item < 1 << 63:
            return "integer_out_of_range"
        if isinstance(item, str) and ("/" in item or "\\" in item):
            return "path_like_text"
        if isinstance(item, dict):
            for k in item:
                if not (k and len(k) <= 64 and k[0].islower() and all(ch.islower() or ch.isdigit() or ch == "_" for ch in k) and k.isascii()):
                    return "key_not_supported"
                if set(k.split("_")) & PRIVATE_PARTS or k.startswith(PRIVATE_STARTS) or k.endswith(PRIVATE_ENDS):
                    return "private_key"
        kids = item.values() if isinstance(item, dict) else item if isinstance(item, list) else ()
        todo += [(kid, depth + 1) for kid in kids]
    return "too_deep" if deepest > MAX_DEPTH else "too_many_items" if seen > MAX_ITEMS else ""


def payload_guard(payload: Column) -> Column:
    check = F.pandas_udf(lambda s: s.map(payload_problem), StringType())
    check.func.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return check(payload)


def graph_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Duplicate nodes, edges to nothing, self edges and cycles per graph.

    nodes: (graph, node); edges: (graph, node, depends_on). A graph with a cycle is named once, whatever its cycles.
    """
    known = stage(nodes.groupBy("graph", "node").agg(F.count(F.lit(1)).alias("n")))
    dup = known.where("n > 1").select("graph", F.lit("duplicate_node").alias("code"))
    own = known.select("graph", F.col("node").alias("depends_on"), F.lit(True).alias("_own"))
    edges = stage(edges.join(own, ["graph", "depends_on"], "left"))
    gone = edges.where("_own is null").select("graph", F.lit("missing_node").alias("code"))
    loops = edges.where("node = depends_on").select("graph", F.lit("self_edge").alias("code"))
    live = stage(edges.where("_own and node <> depends_on").select("graph", "node", "depends_on").join(
        known, ["graph", "node"], "left_semi").distinct())
    cycles = cyclic_graphs(live).select("graph", F.lit("cycle").alias("code"))
    return dup.unionByName(gone).unionByName(loops).unionByName(cycles).distinct()


def cyclic_graphs(edges: DataFrame) -> DataFrame:
    """(graph) of the graphs whose distinct edges (graph, node, depends_on) hold a cycle.

    A round takes away edges from nodes that nothing depends on and edges to nodes without dependencies, then draws
    every chain of nodes with one edge in and one out together into one edge, by doubling pointers. So chains of any
    length go in rounds that grow with its logarithm; rounds are as many as a graph has branchings one behind another.
    An edge that comes back to its own node, and chains without an end, are cycles; so is what no round can take.
    """
    live, found, left = stage(edges), [], None
    while True:
        ins = live.select("graph", F.col("depends_on").alias("node")).groupBy("graph", "node").agg(F.count(F.lit(1)).alias("i"))
        outs = live.groupBy("graph", "node").agg(F.count(F.lit(1)).alias("o"), F.min("depends_on").alias("next"))
        degrees = stage(outs.join(ins, ["graph", "node"], "full"))
        inner = degrees.where("i is not null and o is not null").select("graph", "node")
        kept = live.join(inner, ["graph", "node"], "left_semi").join(inner.withColumnRenamed("node", "depends_on"), ["graph", "depends_on"], "left_semi")
        single = degrees.where("i = 1 and o = 1").select("graph", "node", "next")
        ends, endless = _chain_ends(single)
        found.append(endless)
        drawn = kept.join(single.select("graph", "node"), ["graph", "node"], "left_anti").join(
            ends.withColumnRenamed("node", "depends_on"), ["graph", "depends_on"], "left").select("graph", "node", F.coalesce("end", "depends_on").alias("depends_on"))
        drawn = stage(drawn.distinct())
        loops = stage(drawn.where("node = depends_on").select("graph").distinct())
        found.append(loops)
        known = loops.union(endless).distinct()
        live = stage(drawn.join(known, "graph", "left_anti"))
        now = tuple(live.agg(F.count(F.lit(1)), F.sum(F.xxhash64("graph", "node", "depends_on").bitwiseAND((1 << 40) - 1))).first())
        if now == left or not now[0]:
            break
        left = now
    out = live.select("graph")
    for f in found:
        out = out.union(f)
    return out.distinct()


def _chain_ends(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph, node, end): the first node after a chain of single nodes (graph, node, next); and the graphs with a chain
    that has no end. After k rounds a pointer reaches 2^k nodes ahead, so 2^k > nodes decides."""
    jumps = stage(single.select("graph", "node", F.col("next").alias("end")))
    size = jumps.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(size).bit_length()):
        on = jumps.select("graph", F.col("node").alias("end"), F.col("end").alias("far"))
        jumps = stage(jumps.join(on, ["graph", "end"], "left").select("graph", "node", F.coalesce("far", "end").alias("end")))
    endless = jumps.join(jumps.select("graph", F.col("node").alias("end")), ["graph", "end"], "left_semi").select("graph").distinct()
    return jumps, stage(endless)


def node_inputs(nodes: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Roles a node's inputs lack or have too many of. nodes: (graph, node, kind, roles array)."""
    want = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    need = F.coalesce(want[F.col("kind")], F.array().cast("array<string>"))
    return nodes.withColumn("missing", F.array_sort(F.array_except(need, "roles"))).withColumn(
        "unexpected", F.array_sort(F.array_except("roles", need))).withColumn(
        "reasons", codes((F.size("missing") > 0, "input_missing"), (F.size("unexpected") > 0, "input_unexpected")))


def profile_rules(plans: DataFrame, order: list[str], needs: dict[str, str]) -> DataFrame:
    """Profiles of a plan: known, in fixed order, unique, with matching outputs and their prerequisites.

    plans: (plan, profiles array, outputs array).
    """
    rank = F.create_map(*[x for i, p in enumerate(order) for x in (F.lit(p), F.lit(i))])
    at = F.transform("profiles", lambda p: F.coalesce(rank[p], F.lit(-1)))
    lacking = F.lit(False)
    for p, q in needs.items():
        lacking = lacking | (F.array_contains("profiles", p) & ~F.array_contains("profiles", q))
    return plans.withColumn("reasons", codes(
        (F.exists(at, lambda a: a < 0), "unknown_profile"),
        (F.size(F.array_distinct("profiles")) < F.size("profiles"), "profile_repeats"),
        (F.array_sort(at) != at, "profiles_out_of_order"),
        ((F.size(F.array_except("profiles", "outputs")) > 0) | (F.size(F.array_except("outputs", "profiles")) > 0), "outputs_differ"),
        (lacking, "prerequisite_missing"),
    ))


def decision_problems(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every candidate decided exactly once; approvals need a repairable one, protections a class.

    candidates: (scan, event_id, repairable); decisions: (scan, event_id, decision, protected_class).
    """
    d = decisions.groupBy("scan", "event_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("decision") == "approved", True)).alias("_a"),
        F.max(F.when((F.col("decision") == "protected") & F.col("protected_class").isNull(), True)).alias("_p"))
    j = candidates.withColumn("_c", F.lit(True)).join(d, ["scan", "event_id"], "full_outer")
    no = F.lit(False)
    return j.select("scan", "event_id", codes(
        (F.col("_c").isNull(), "unknown_candidate"), (F.col("_n").isNull(), "undecided"), (F.coalesce(F.col("_n") > 1, no), "decided_twice"),
        (F.coalesce(F.col("_a") & ~F.col("repairable"), no), "approved_not_repairable"), (F.coalesce(F.col("_p"), no), "protected_without_class"),
    ).alias("reasons")).where(F.size("reasons") > 0)


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only (as sets), with the side: empty exactly when the two sets are equal."""
    cols = left.columns
    both = left.select(*cols, F.lit(0).alias("_s")).unionByName(right.select(*cols, F.lit(1).alias("_s")))
    sides = both.groupBy(*cols).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    return sides.where("_lo = _hi").select(*cols, F.when(F.col("_lo") == 0, "left").otherwise("right").alias("only_in"))


def rederivation_mismatches(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Stored result rows against the same rows computed again, duplicates counted: any row left was edited."""
    cols = stored.columns
    count = lambda s, d: [F.lit(s).cast("bigint").alias("s"), F.lit(d).cast("bigint").alias("d")]
    both = stored.select(*cols, *count(1, 0)).unionByName(derived.select(*cols, *count(0, 1)))
    return both.groupBy(*cols).agg(F.sum("s").alias("stored"), F.sum("d").alias("derived")).where("stored <> derived")


def history_chain(history: DataFrame, current: DataFrame, most: int = 100, most_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """Per project: consecutive sequences, each before-hash equal to the last after-hash, the end equal to now.

    history: (project_id, sequence, before, after, bytes); current: (project_id, state).
    """
    ix = dense_index(history, ["project_id"], ["sequence"], F.expr("sequence div 4096"), "_ix")
    near = windowed(ix, ["project_id"], "_ix", 1, 1, {
        "_ps": lambda w: F.lag("sequence").over(w), "_pa": lambda w: F.lag("after").over(w), "_nx": lambda w: F.lead("sequence").over(w)})
    no = F.lit(False)
    agg = near.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("_bytes"),
        F.max(F.coalesce(F.col("sequence") != F.col("_ps") + 1, no)).alias("_gap"),
        F.max(F.coalesce(F.col("before") != F.col("_pa"), no)).alias("_break"),
        F.max(F.when(F.col("_nx").isNull(), F.col("after"))).alias("_end"))
    j = agg.join(current, "project_id", "left")
    return j.select("project_id", "entries", codes(
        (F.col("_gap"), "sequence_gap"), (F.col("_break"), "hash_chain_broken"),
        (~F.col("_end").eqNullSafe(F.col("state")), "current_state_differs"), (F.col("entries") > most, "too_many_entries"),
        (F.col("_bytes") > most_bytes, "history_too_large"),
    ).alias("reasons"))


def navigation_problems(tracks: DataFrame, most: int = 99) -> DataFrame:
    """Per album: side orders 1..n, album numbers 1..m within the limit, one file per name key, unique labels.

    tracks: (album, side_order, label_key, album_number, file_key, file_sha256).
    """
    ix = dense_index(tracks, ["album"], ["side_order", "album_number"], F.expr("side_order div 64"), "_ix")
    order = ix.groupBy("album").agg(
        F.max(F.col("album_number") != F.col("_ix") + 1).alias("_num"), F.count(F.lit(1)).alias("tracks"))
    sides = tracks.groupBy("album", "side_order").agg(F.min("label_key").alias("lk"), F.max("label_key").alias("lk2"))
    s = sides.groupBy("album").agg(F.count(F.lit(1)).alias("sides"), F.max("side_order").alias("_top"), F.min("side_order").alias("_low"),
                                   F.max(F.col("lk") != F.col("lk2")).alias("_mixed"))
    labels = sides.groupBy("album", "lk").agg(F.count(F.lit(1)).alias("n")).groupBy("album").agg((F.max("n") > 1).alias("_rep"))
    files = tracks.groupBy("album", "file_key").agg((F.min("file_sha256") != F.max("file_sha256")).alias("x")).groupBy("album").agg(F.max("x").alias("_clash"))
    j = order.join(s, "album").join(labels, "album").join(files, "album")
    return j.select("album", "tracks", "sides", codes(
        ((F.col("_low") != 1) | (F.col("_top") != F.col("sides")), "side_orders_not_contiguous"),
        (F.col("_rep") | F.col("_mixed"), "side_labels_not_unique"), (F.col("_num"), "album_numbers_not_contiguous"),
        (F.col("tracks") > most, "too_many_tracks"), (F.col("_clash"), "file_names_collide"),
    ).alias("reasons"))
