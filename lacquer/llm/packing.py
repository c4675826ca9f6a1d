"""Packing of token pieces into sequences of a fixed size, as few as a local search can reach.

Documents are cut into pieces of at most `size` tokens. Pieces are dealt to bounded groups, each packed best-fit by
falling length; then documents of the emptiest bin are moved, exchanged one for one or two for one with those of
fuller bins, always so that the squared fill grows, until the bin is empty. The emptiest bins of a group meet those of
other groups in the next round, so the bins that stay half empty do not add up with the number of groups.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage
from .bpe import _blocks

#: Most pieces whose ids a task remembers, and the longest that it does; beyond the first the memory starts anew.
REMEMBER, LONGEST = 1_000_000, 64


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(SparkFiles.get(path[len("sent:") :]) if path.startswith("sent:") else path)


# The classes of the vocabulary's pattern, for texts of these characters only. None of them changes under
# NFC, and its lower case is one letter; the first classes begin differently, so their order does not matter.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\x00-\x7f{_LETTERS}–—‘’“”„…€]*")
_PIECE = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[^{_LETTERS}0-9\x20\t-\r]+")
_CHUNK = re.compile(r"[^\x20\t-\r]+")


def _byte_letters() -> list[str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, each distinct piece given to the tokenizer once.

    The vocabulary's pattern never matches white space, and neither its normal form nor its lower case looks past a
    blank, so a text's ids are those of its chunks between ASCII blanks. Chunks of common characters are lower-cased and
    cut on into the pattern's own pieces, which go to the tokenizer's model; others and those that may hold a special
    token go to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.letters = _tokenizer(path), {}, _byte_letters()
        self.model = self.tokenizer.model

    def cut(self, text: str) -> list:
        """Pieces as texts, whole chunks as 1-tuples."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _PIECE.findall(text.lower())
        out = []
        for c in _CHUNK.findall(text):
            if _PLAIN.fullmatch(c) and "<|" not in c:
                out += _PIECE.findall(c.lower())
            else:
                out.append((c,))
        return out

    def learn(self, new: set) -> None:
        letters, tokenize = self.letters, self.model.tokenize
        for c in new:
            if isinstance(c, tuple):
                ids = self.tokenizer.encode(c[0], add_special_tokens=False).ids
            else:
                ids = [t.id for t in tokenize(c if c.isascii() and c.isprintable() else "".join([letters[b] for b in c.encode()]))]
            self.known[c] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBER:
            self.known = {}
        cut = [self.cut(t) for t in texts]
        new = set().union(*cut).difference(self.known)
        self.learn(new)
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        for c in new:
            if len(c if isinstance(c, str) else c[0]) > LONGEST:
                del self.known[c]
        return out


@cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 4096, end: int = 1, ids: bool = False
) -> DataFrame:
    """One row per piece: (key, piece, start, length, ids_crc32) and, if asked for, `ids` (array<int>).

    A document is the ids of its whole text (null: empty) with `end` behind them; only one that is longer than `size`
    is cut, into pieces of `size` and a rest. So an empty text is one piece of length 1. Rows never meet: repeated
    rows give repeated pieces, null keys stay null, an empty table gives none, other columns are not read. `tokenizer`
    is a file of the tokenizers library that every worker can open, or "sent:<name>" of one given to addFile().
    """
    sent = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    made = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    said = f"k {sent.schema['k'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    if ids:
        made["ids"], said = pa.list_(pa.int32()), said + ", ids array<int>"

    def run(batches):
        encoder, last = _encoder(tokenizer), struct.pack("<I", end)
        for batch in batches:
            keys, texts = batch.column("k"), batch.column("t").to_pylist()
            for lo, hi in _blocks(texts):
                at, rows = [], {c: [] for c in made}
                for i, raw in enumerate(encoder.encode([t or "" for t in texts[lo:hi]]), lo):
                    raw += last
                    for p, first in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[first : first + 4 * size]
                        at.append(i)
                        for c, x in zip(made, (p, first // 4, len(part) // 4, zlib.crc32(part))):
                            rows[c].append(x)
                        if ids:
                            rows["ids"].append(np.frombuffer(part, "<i4").tolist())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at, pa.int64())), *(pa.array(rows[c], t) for c, t in made.items())], names=["k", *made])

    return sent.mapInArrow(run, said).withColumnRenamed("k", key)


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each item: longest first, each into the fullest bin that still takes it."""
    bins, made, mask = np.zeros(len(lengths), np.int64), 0, 0
    room: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, b, made = size, made, made + 1
        bins[i] = b
        if free > n:
            if not room.setdefault(free - n, []):
                mask |= 1 << (free - n)
            room[free - n].append(b)
    return bins


class Search:
    """Local search that empties bins: every step takes tokens from the emptiest bin into a fuller one."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, size: int):
        self.lengths, self.bins, self.size = lengths, bins.copy(), size
        self.free = size - np.bincount(bins, lengths, minlength=int(bins.max()) + 1).astype(np.int64)

    def put(self, item: int, to: int) -> None:
        self.free[self.bins[item]] += self.lengths[item]
        self.free[to] -= self.lengths[item]
        self.bins[item] = to

    def run(self, patience: int = 64) -> np.ndarray:
        """Bins after the search: it ends at the least number that the sum allows, where what is free elsewhere cannot
        hold the emptiest bin, or after `patience` bins in a row that could not be emptied."""
        total, stuck = int(self.lengths.sum()), set()
        while len(stuck) < patience:
            used = np.flatnonzero(self.free < self.size)
            if len(used) <= -(-total // self.size):
                break
            tries = used[~np.isin(used, list(stuck))] if stuck else used
            if not len(tries):
                break
            donor = int(tries[np.argmax(self.free[tries])])
            if self.free[used].sum() - self.free[donor] < self.size - self.free[donor]:
                break
            while self.free[donor] < self.size and self.step(donor):
                pass
            if self.free[donor] < self.size:
                stuck.add(donor)
            else:
                stuck.clear()
        return self.bins

    def step(self, donor: int) -> bool:
        own = np.flatnonzero(self.bins == donor)
        own = own[np.argsort(-self.lengths[own], kind="stable")]
        _, first = np.unique(-self.lengths[own], return_index=True)  # items of equal length are as good
        own = own[first]
        open_ = np.flatnonzero((self.free > 0) & (self.free <= self.free[donor]))
        open_ = open_[open_ != donor]
        if not len(own) or not len(open_):
            return False
        return self.move(own, open_) or self.one_for_one(donor, own) or self.two_for_one(donor, own) or self.one_for_two(donor, own, open_)

    def move(self, own, open_) -> bool:
        free = self.free[open_]
        for i in own.tolist():
            fits = open_[free >= self.lengths[i]]
            if len(fits):
                self.put(i, int(fits[np.argmin(self.free[fits])]))
                return True
        return False

    def others(self, donor: int) -> np.ndarray:
        """Items of underfull bins that are at least as full as the donor."""
        free = self.free[self.bins]
        return np.flatnonzero((free > 0) & (free <= self.free[donor]) & (self.bins != donor))

    def one_for_one(self, donor: int, own) -> bool:
        there, best = self.others(donor), (0, -1, -1)
        size, free = self.lengths[there], self.free[self.bins[there]]
        for i in own.tolist():
            gain = self.lengths[i] - size
            gain = np.where(gain <= free, gain, 0)
            k = int(np.argmax(gain)) if len(gain) else -1
            if k >= 0 and gain[k] > best[0]:
                best = (int(gain[k]), i, int(there[k]))
        return self.swap(donor, best[1:2], best[2:]) if best[0] else False

    def two_for_one(self, donor: int, own) -> bool:
        """Two documents of the emptiest bin for one of a fuller one."""
        there, mine = self.others(donor), np.flatnonzero(self.bins == donor)
        by: dict[int, tuple] = {}
        held: dict[int, list] = {}
        for i in mine.tolist():
            held.setdefault(int(self.lengths[i]), []).append(i)
        for a in held:
            for b in held:
                if a < b or a == b and len(held[a]) > 1:
                    by[a + b] = (held[a][0], held[b][-1])
        if not by or not len(there):
            return False
        sums = np.asarray(sorted(by), np.int64)
        size, free = self.lengths[there], self.free[self.bins[there]]
        k = np.searchsorted(sums, size + free, "right") - 1
        gain = np.where(k >= 0, sums[np.maximum(k, 0)] - size, 0)
        j = int(np.argmax(gain))
        return self.swap(donor, by[int(sums[k[j]])], [int(there[j])]) if gain[j] > 0 else False

    def one_for_two(self, donor: int, own, open_) -> bool:
        """One document of the emptiest bin for two of a fuller one, the roomiest bins first."""
        sizes = self.lengths[own]
        there = self.others(donor)
        there = there[np.argsort(self.bins[there], kind="stable")]
        cuts = np.flatnonzero(np.diff(self.bins[there])) + 1
        for items in sorted(np.split(there, cuts), key=lambda x: -int(self.free[self.bins[x[0]]]) if len(x) else 0):
            if len(items) < 2:
                continue
            free, n = int(self.free[self.bins[items[0]]]), self.lengths[items]
            items = items[np.argsort(n, kind="stable")]
            n = self.lengths[items]
            items = items[np.r_[True, True, n[2:] != n[:-2]]]  # two of each length are as good as all
            n = self.lengths[items]
            pair = n[:, None] + n[None, :]
            a, b = np.triu_indices(len(items), 1)
            gain = sizes[:, None] - pair[a, b][None, :]
            gain = np.where(gain <= free, gain, 0)
            k = int(np.argmax(gain))
            if gain.flat[k] > 0:
                x, p = divmod(k, len(a))
                return self.swap(donor, [int(own[x])], [int(items[a[p]]), int(items[b[p]])])
        return False

    def swap(self, donor: int, out, back) -> bool:
        to = int(self.bins[back[0]])
        for i in back:
            self.put(i, donor)
        for i in out:
            self.put(i, to)
        return True


def pack(
    parts: DataFrame, length: str = "length", size: int = 4096, group: int = 16384, fan: int = 16, carry: int = 64
) -> DataFrame:
    """The rows of `parts` with sequence_id and offset: rows of one sequence_id lie gapless from 0 and sum to `size` at most.

    Rows are dealt by a hash of their place in the written table to groups of about `group`; the at most `carry`
    emptiest bins of each go on to the next round, `fan` groups together, until one group is left. No group grows with
    the table. Equal rows are packed each for itself; columns may have any name, `sequence_id` and `offset` are
    replaced; an empty table gives an empty one. A length that is null, below 1 or above `size` is an error.
    """
    columns = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    named = parts.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    n = f"c{columns.index(length)}"
    table = stage(named.withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, -(-table.count() // group))
    todo = table.select(*named.columns, F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g"), F.lit(None).cast("bigint").alias("bin"), "row")
    schema = todo.drop("bin").schema.add("bin", "long").add("at", "long").add("done", "boolean")
    done, level, staged = [], 0, [table]
    while True:
        last = groups == 1
        out = stage(todo.groupBy("g").applyInArrow(_packer(n, size, level, 0 if last else carry, schema.names), schema))
        unstage(*staged)
        staged = [out] if not last else []
        done.append(out.where("done"))
        if last:
            break
        level, groups = level + 1, -(-groups // fan)
        todo = out.where("not done").select(*named.columns, F.expr(f"g div {fan}").alias("g"), "bin", "row")
        staged = []
    whole = done[0]
    for x in done[1:]:
        whole = whole.union(x)
    return whole.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


def _packer(n: str, size: int, level: int, carry: int, names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["row"].to_numpy(), kind="stable")))
        if table[n].null_count:
            raise ValueError("a length is null")
        lengths = table[n].to_numpy().astype(np.int64)
        if lengths.min() < 1 or lengths.max() > size:
            raise ValueError(f"a length is not from 1 to {size}")
        bins = best_fit(lengths, size)
        if level:
            held = np.unique(table["bin"].to_numpy(), return_inverse=True)[1]
            bins = held if held.max() <= bins.max() else bins
        bins = np.unique(Search(lengths, bins, size).run(), return_inverse=True)[1]
        free = size - np.bincount(bins, lengths).astype(np.int64)
        order = np.argsort(-free, kind="stable")
        on = order[:carry][free[order[:carry]] > 0]
        by = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[by])
        first = np.searchsorted(bins[by], np.arange(len(free)))
        at = np.empty(len(bins), np.int64)
        at[by] = ends - lengths[by] - (ends - lengths[by])[first][bins[by]]
        g = int(table["g"][0].as_py())
        made = {
            "bin": pa.array((level + 1 << 56) + (g << 16) + bins), "at": pa.array(at),
            "done": pa.array(~np.isin(bins, on)),
        }
        return pa.table([made[c] if c in made else table[c] for c in names], names=names)

    return run


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids): the token sequences themselves, from packed pieces that carry their ids. A group is one
    sequence, which the packing bounds."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("offset").alias("o"), F.col(f"`{ids}`").alias("i"))))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda r: r["i"])).alias("ids"))
