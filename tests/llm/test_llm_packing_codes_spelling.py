import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lacquer.llm import codes, packing, spelling

WORDS = public_tokenizers.path("word_bpe_49k.json")

NASTY = [
    None, "", " ", "Don't WE'LL they'd I'M", "a b c\x1cd\x85e", "é ́x ΑΣ Σ. ΟΔΟΣ",
    "<|endoftext|> x<|startoftext|>y", "1234 ½ ²³", "naïve ÀÉÎ ß İstanbul", "日本語 テキスト 한국어", "🙂🙂 a🙂b", "\x00 ﻿",
    "x" * 5000, "ab " * 3000, "\t\n\r\x0b\x0c", "'s't 're", "don' t", "ạ̈ ̣̈",
]


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    encoder = packing.Encoder(WORDS)
    texts = [t or "" for t in NASTY + NASTY[::-1]] + [chr(c) + "x'S" + chr(c) + "0" + chr(c) for c in range(0x2100)]
    for t, raw in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    assert encoder.encode([]) == [] and all(len(c if isinstance(c, str) else c[0]) <= packing.LONGEST for c in encoder.known)


def test_pieces_are_the_ids_of_whole_texts(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(NASTY)] + [(99, "a b c", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece string")
    got = packing.pieces(docs, WORDS, size=16, ids=True).collect()
    want = Counter()
    for k, t, _ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for p, lo in enumerate(range(0, len(ids), 16)):
            part = ids[lo : lo + 16]
            want[k, p, lo, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want


def whole_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(by)


@pytest.mark.parametrize("lengths, least", [
    ([1], 1), ([7] * 900, 65), (list(range(1, 101)) * 9, 455), ([60, 41] * 300, 450), ([100] * 50, 50)])
def test_packing_keeps_every_row_and_nears_the_least(spark, lengths, least):
    rows = [(i // 2, n, "s", 5) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id bigint, length bigint, sequence_id string, row bigint")
    out = packing.pack(df, size=100, group=256, fan=2, carry=16)
    assert out.columns == ["doc_id", "length", "row", "sequence_id", "offset"]
    got = out.collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter((i, n) for i, n, *_ in rows)
    used = whole_packing(got, 100)
    assert least <= used <= least + max(1, least // 25)  # groups are far smaller than by default


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, length bigint")
    assert packing.pack(empty).collect() == []
    for bad in (0, None, 4097):
        with pytest.raises(Exception, match="a length is"):
            packing.pack(spark.createDataFrame([(1, bad)], "doc_id bigint, length bigint")).collect()


def test_local_search_empties_bins():
    rng = np.random.default_rng(3)
    for lo, hi in ((1, 100), (20, 45), (30, 60), (51, 100)):
        lengths = rng.integers(lo, hi, 700)
        start = np.arange(700)  # one bin each: the search does all of the packing
        filled = lambda bins: int((np.bincount(bins, lengths).astype(int) ** 2).sum())
        search = packing.Search(lengths, start, 100)
        end = search.run()
        assert np.bincount(end, lengths).max() <= 100 and filled(end) >= filled(start)
        fitted = packing.best_fit(lengths, 100)
        after = packing.Search(lengths, fitted, 100).run()
        assert len(set(after.tolist())) <= len(set(fitted.tolist()))
    # One of each kind of exchange alone empties a bin.
    cases = [  # lengths, bins, bins needed
        ([60, 30, 10], [0, 0, 1], 1), ([50, 40, 45, 55, 10], [0, 0, 1, 1, 2], 2), ([70, 25, 60, 40, 5], [0, 0, 1, 1, 2], 2),
    ]
    for lengths, bins, need in cases:
        got = packing.Search(np.asarray(lengths), np.asarray(bins), 100).run()
        assert len(set(got.tolist())) == need
    one = packing.Search(np.asarray([60, 35, 40, 38]), np.asarray([0, 0, 1, 1]), 100)
    assert one.one_for_one(1, np.asarray([2, 3])) and one.bins.tolist() == [0, 1, 0, 1]  # 35 for 40 fills bin 0
    two = packing.Search(np.asarray([60, 35, 20, 18]), np.asarray([0, 0, 1, 1]), 100)
    assert two.two_for_one(1, np.asarray([2, 3])) and two.bins.tolist() == [0, 1, 0, 0]  # 20 + 18 for 35
    pair = packing.Search(np.asarray([60, 18, 17, 38]), np.asarray([0, 0, 0, 1]), 100)
    assert pair.one_for_two(1, np.asarray([3]), np.asarray([0])) and pair.bins.tolist() == [0, 1, 1, 0]  # 38 for 18 + 17


def test_sequences_are_the_ids(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(40)], "doc_id bigint, text string")
    rows = packing.pieces(docs, WORDS, size=16, ids=True)
    out = packing.sequences(packing.pack(rows, size=16)).collect()
    assert sum(len(r.ids) for r in out) == sum(i % 7 + 1 for i in range(40)) and all(len(r.ids) <= 16 for r in out)


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(k, v, l) for k, v, l in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.floor(np.asarray([np.float32(v) for _, v, _ in kept], np.float64) * 1024).astype(np.int64)
    cut = np.split(x, parts, 1)
    books = [c[:entries].copy() for c in cut]
    near = lambda c, b: ((c[:, None] - b[None]) ** 2).sum(2)
    for _ in range(rounds):
        for c, b in zip(cut, books):
            own = near(c, b).argmin(1)
            for e in set(own.tolist()):
                b[e] = c[own == e].sum(0) // (own == e).sum()
    d = [near(c, b) for c, b in zip(cut, books)]
    said = hashlib.sha256(",".join(str(y) for b in books for y in b.ravel().tolist()).encode()).hexdigest()
    error = sum(m.min(1) for m in d)
    by = Counter()
    for (_, _, l), e in zip(kept, error.tolist()):
        by[l] += e
    return Counter((k, "".join(f"{m[i].argmin():02x}" for m in d), int(error[i]), by[l], said) for i, (k, _, l) in enumerate(kept))


@pytest.mark.parametrize("n, spread", [(3, 1.0), (700, 1.0), (3000, 0.01)])
def test_codes_equal_brute_force(spark, monkeypatch, n, spread):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(9, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 9] + spread * rng.normal(size=8)], i % 5 if i % 7 else None) for i in range(n)]
    rows += [(n + i, rows[0][1], 1) for i in range(n // 3)] + [rows[1]] * 3  # a common vector, repeated rows
    rows += [(-1, None, 0), (-2, [1.0, None] * 4, 0), (-3, [float("nan")] * 8, 0), (-4, [float("inf")] * 8, None), (None, rows[0][1], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, code string").repartition(3)
    entries = 16 if n == 700 else 256
    got = codes.compress(df, entries=entries).collect()
    assert Counter(tuple(r) for r in got) == brute_codes(rows, entries=entries)


def test_codes_edges(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert codes.compress(spark.createDataFrame([], schema)).collect() == []
    odd = [(0, [0.5] * 8, 1), (1, [0.5] * 12, 1), (2, [0.5] * 7, 1), (3, [], 1), (4, [0.25] * 8, 1)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codes.compress(spark.createDataFrame(odd, schema)).collect()}
    assert got == {0: ("00000000", 0, 0), 4: ("01010101", 0, 0)}
    with pytest.raises(Exception, match="too large"):
        codes.compress(spark.createDataFrame([(0, [1e30] * 8, 1)], schema)).collect()


def test_balls_bound_their_points_and_cache_their_sums():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-900, 900, (500, 6)), np.repeat(rng.integers(-9, 9, (1, 6)), 300, 0)])
    tree = codes.Tree(points)
    assert sorted(tree.order.tolist()) == list(range(800)) and (points[tree.order] == tree.there).all()
    for (a, b, left, right), s, r in zip(tree.nodes.tolist(), tree.sums, tree.radius):
        inside = tree.there[a:b]
        assert (inside.sum(0) == s).all() and np.sqrt(((inside - s / (b - a)) ** 2).sum(1)).max() <= r + 1e-9
        if left >= 0:
            assert tree.nodes[left][0] == a and tree.nodes[right][1] == b and tree.nodes[left][1] == tree.nodes[right][0]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 8))) for _ in range(250)} | {"x" * 3000, "x" * 2999 + "y", "x" * 2999, "", "日本", "日"}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string").repartition(5)
    got = [tuple(r) for r in spelling.neighbours(df).collect()]
    want = {(a, b) for a in words for b in words if a and b and near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want
    assert spelling.neighbours(df.limit(0)).collect() == []


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    counts = {"".join(rng.choice(list("ab"), rng.integers(4, 8))): int(2 ** rng.integers(0, 9)) for _ in range(60)}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()
    form, n_near = {}, {}
    for w, n in counts.items():
        close = sorted((-m, x) for x, m in counts.items() if near(w, x))
        n_near[w] = len(close)
        form[w] = close[0][1] if close and -close[0][0] >= 2 * n else None
    want = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        want.add((w, form[w], root, n, n_near[w], counts.get(form[w])))
    assert {tuple(r) for r in got} == want and len(got) == len(counts)


def test_corpus_words_equal_brute_force(spark):
    import re

    texts = ["Hello hello HELLO world", None, "", "Àb×÷ÿ straße Éclair éclair", "x" * 9000, "a-b_c1d hello", "🙂hello\nworld\tworld"] * 40
    rows = [(i if i % 11 else None, t, "n") for i, t in enumerate(texts)]
    count = Counter()
    for k, t, _ in rows:
        for run in re.findall(spelling.RUN, t or ""):
            w = run.translate(str.maketrans(spelling._UPPER, spelling._LOWER))
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 7 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string")
    got = spelling.corpus_words(df, garble=7).collect()
    assert {r.word: r.n for r in got} == {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    assert spelling.corpus_words(df.limit(0)).collect() == []
