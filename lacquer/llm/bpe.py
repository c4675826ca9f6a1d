"""Byte-level BPE by ranks, encoded and decoded on padded matrices.

Distinct pieces of a batch are padded into matrices of like length. In every round each row merges its leftmost pair
of least rank; ranks of pairs come from an open-addressed hash table, and the row closes up behind the merge. Rows
without a pair are done. A piece longer than `LONG` bytes would need as many rounds as bytes; it takes the same
merges from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
LONG = 256
#: Most pieces whose ids a task remembers; beyond it the memory starts anew.
REMEMBER = 400_000


class Vocabulary:
    """Ranks of a .tiktoken file and the table of pairs that merge."""

    def __init__(self, path: str):
        rows = [line.split() for line in open(path, "rb") if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.said = list(map(str, range(len(self.tokens))))
        self.single = np.full(256, -1, np.int32)
        for b in range(256):
            self.single[b] = self.ranks[bytes([b])]
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(len(pairs) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.probes, slot = 1, self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into; NONE without one or where either id is -1."""
        keys = (left.astype(np.int64) << 32) | np.maximum(right, 0)
        slot = self._slot(keys)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys, slot = keys.ravel()[todo], slot.ravel()[todo]
        flat = out.reshape(-1)
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == keys
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            if not on.any():
                break
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of like length: one merge for each piece and round. A piece is a column, so that every step
        runs along contiguous memory."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        width = int(sizes.max())
        padded = np.full((n, width), -1, np.int32)
        padded[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.ascontiguousarray(padded.T)
        ranks = np.stack([self.pair_ranks(ids[j], ids[j + 1]) for j in range(width - 1)] or [np.full(n, NONE)])
        out: list = [None] * n
        rows = np.arange(n)
        while True:
            least = ranks[: max(width - 1, 1)].min(0)
            live = least != NONE
            if live.sum() <= 0.7 * len(rows):
                done = np.ascontiguousarray(ids[:, ~live].T)
                for row, own, size in zip(rows[~live].tolist(), done, (done >= 0).sum(1).tolist()):
                    out[row] = own[:size]
                rows, least, ids, ranks = rows[live], least[live], ids[:, live], ranks[:, live]
                live = live[live]
                if not len(rows):
                    return out
            at = np.full(len(rows), width, np.int64)
            for j in range(width - 2, -1, -1):
                np.copyto(at, j, where=(ranks[j] == least) & live)
            for j in range(1, width - 1):
                behind = at < j
                np.copyto(ids[j], ids[j + 1], where=behind)
                if j < width - 2:
                    np.copyto(ranks[j], ranks[j + 1], where=behind)
            k = np.flatnonzero(live)
            ids[width - 1, k], ids[at[k], k], ranks[max(width - 2, 0), k] = -1, least[k], NONE
            if not (ids[width - 1] >= 0).any():
                width -= 1
            for near in (at - 1, at):
                k = np.flatnonzero(live & (near >= 0) & (near < width - 1))
                ranks[near[k], k] = self.pair_ranks(ids[near[k], k], ids[near[k] + 1, k])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, from a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].copy()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(ids[:-1], ids[1:])
        heap = [(int(r), i, int(ids[i]), int(ids[i + 1])) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        ids = ids.tolist()

        def offer(i):
            if i >= 0 and after[i] < n:
                r = self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[after[i]]])
                if r is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; pieces are dealt to matrices by length, the widest matrix of some MB."""
        out: list = [None] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        k = 0
        while k < len(order):
            size = len(pieces[order[k]])
            if size == 0 or size > LONG:
                out[order[k]] = self.merge_long(pieces[order[k]]) if size else np.zeros(0, np.int32)
                k += 1
                continue
            most, end = min(LONG, size + max(1, size // 4)), k
            while end < len(order) and len(pieces[order[end]]) <= most and (end - k) * most < 1_000_000:
                end += 1
            for i, ids in zip(order[k:end], self.merge_rows([pieces[i] for i in order[k:end]])):
                out[i] = ids
            k = end
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Codec:
    """Encodes whole texts: each match of the pattern on its own, ids of known pieces remembered."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.pattern = vocabulary(path), regex.compile(pattern)
        self.ids: dict[str, bytes] = {}
        self.said: dict[str, str] = {}

    def learn(self, pieces: list[str]) -> None:
        ranks, said = self.vocabulary.ranks, self.vocabulary.said
        raw = [p.encode() for p in pieces]
        rest = [i for i, b in enumerate(raw) if b not in ranks]
        for p, b in zip(pieces, raw):
            if b in ranks:
                self.ids[p], self.said[p] = np.int32(ranks[b]).tobytes(), said[ranks[b]]
        for i, own in zip(rest, self.vocabulary.encode_pieces([raw[i] for i in rest])):
            self.ids[pieces[i]] = own.tobytes()
            self.said[pieces[i]] = ",".join([said[x] for x in own.tolist()])

    def encode(self, texts: list[str]):
        """For each text: its ids, and the same as decimal numbers joined by commas."""
        cut = [self.pattern.findall(t) for t in texts]
        rows = [list(map(self.ids.get, c)) for c in cut]
        if new := {p for c, row in zip(cut, rows) if None in row for p, x in zip(c, row) if x is None}:
            if len(self.ids) + len(new) > REMEMBER:
                self.ids, self.said = {}, {}
                new = {p for c in cut for p in c}
            self.learn(sorted(new))
        for c, row in zip(cut, rows):
            row = list(map(self.ids.get, c)) if None in row else row
            yield np.frombuffer(b"".join(row), np.int32).tolist(), ",".join(map(self.said.__getitem__, c))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def _place(path: str) -> str:
    """A file that was sent with addFile(), or the path itself where every worker has it."""
    return SparkFiles.get(path[len("sent:") :]) if path.startswith("sent:") else path


def _blocks(texts: list, most: int = 2_000_000):
    """Index ranges whose texts have some characters together, so a batch of long texts never is held as pieces."""
    k = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield k, i + 1
            k, size = i + 1, 0
    if k < len(texts):
        yield k, len(texts)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of each row (all but the text by default), with n_tokens, ids (array<int>), ids_sha256 and
    decoded_sha256 of its whole text.

    A null text counts as empty: no ids, and the hash of no bytes. Rows never move or meet, so repeated rows give
    repeated results and an empty table an empty one. Result columns replace columns of `docs` of the same name.
    `ranks` is a .tiktoken file that every worker can open, or "sent:<name>" of one given to addFile().
    """
    made = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _run(docs, ranks, pattern, text, keep, made)


def digests(docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As encode(), without the ids themselves."""
    made = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _run(docs, ranks, pattern, text, keep, made)


def _run(docs, ranks, pattern, text, keep, made):
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made and (c != text or keep is not None)]
    mine = [f"c{i}" for i in range(len(keep))]
    kinds = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    sent = docs.select(*(F.col(f"`{c}`").alias(m) for c, m in zip(keep, mine)), F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in sent.schema[:-1]), *(f"{c} {kinds[c]}" for c in made)])

    def run(batches):
        codec = Codec(_place(ranks), pattern)
        for batch in batches:
            texts = batch.column("__text")
            for lo, hi in _blocks(texts.to_pylist()):
                rows = {c: [] for c in made}
                part = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                for ids, said in codec.encode(part):
                    rows["n_tokens"].append(len(ids))
                    if "ids" in rows:
                        rows["ids"].append(ids)
                    rows["ids_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in mine), *(pa.array(rows[c], t) for c, t in made.items())],
                    names=[*mine, *made],
                )

    return sent.mapInArrow(run, schema).toDF(*keep, *made)


def decoded(ids: Column, ranks: str) -> Column:
    """The text of an array of ids; bytes that are no UTF-8 become replacement characters."""
    from pyspark.sql.functions import pandas_udf

    def run(series):
        tokens = vocabulary(_place(ranks)).tokens
        return series.map(lambda x: None if x is None else b"".join(tokens[int(i)] for i in x).decode(errors="replace"))

    return pandas_udf(run, "string")(ids)
