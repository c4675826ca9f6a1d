"""Secrets in texts: fixed forms, and strings whose characters are too evenly mixed to be words.

For each character class a window slides over the maximal runs of that class; its Shannon entropy changes only by the
counts of the character that enters and of the one that leaves. Runs with a window whose entropy passes the threshold
of the class are found, unless an allow-list pattern says what the run is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import let

# The base forms; the group that must be long enough, and its least length. A run of hexadecimal digits
# or of key characters that is too short holds no longer one, so their patterns ask for the length at once.
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
WIDTH = 20
# The alphabet of each class, and the least entropy (bits) of a window of WIDTH characters of it. A run
# needs a digit and a letter; one whose characters are all of the class before belongs to that class.
CLASSES = {
    "entropy_hex": ("[0-9a-fA-F]", 2.9),
    "entropy_alnum": ("[0-9A-Za-z]", 3.4),
    "entropy_base64": ("[0-9A-Za-z+/_-]", 3.8),
}
# Runs that are no secrets: placeholders, counters, UUIDs.
ALLOWED = [
    r"(?i)(example|sample|placeholder|changeme|dummy|xxxx|redacted)", r"(?i)0123456789|abcdefgh|12345678901234567890",
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
]
#: Matches of a text whose places are summed up in one array; places of such blocks are summed up in a second step.
_BLOCK = 256
#: Counts of a window's characters lie side by side in numbers of 12 fields of 5 bits (a count is at most WIDTH).
_FIELDS, _BITS, _FIRST, _LAST = 12, 5, ord("+"), ord("z")


def spans(text: Column, pattern: str) -> Column:
    """array<struct<at, end, m>> of the leftmost non-overlapping matches, in code points: gaps and matches alternate,
    so a match begins after all gaps and matches before it."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    one = "struct<at: int, end: int, m: string>"
    empty = lambda kind: F.expr(f"cast(array() as array<{kind}>)")

    def step(a, z):
        at = a["at"] + F.length(z["g"])
        end = at + F.length(z["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(at.alias("at"), end.alias("end"), z["m"].alias("m")))).alias("out"))

    def block(pairs):
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty(one).alias("out")), step)

    def add(a, b):
        return F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def place(blocks):
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), empty("int").alias("out")), add, lambda a: a["out"])
        moved = F.zip_with(blocks, starts, lambda b, s: F.transform(
            b["out"], lambda x: F.struct((x["at"] + s).alias("at"), (x["end"] + s).alias("end"), x["m"].alias("m"))))
        return F.flatten(moved)

    def pair(both):
        pairs = F.arrays_zip(both["m"].alias("m"), F.slice(both["g"], 1, F.size(both["m"])).alias("g"))
        cuts = F.sequence(F.lit(0), F.floor((F.size(both["m"]) - 1) / _BLOCK).cast("int"))
        blocks = let(pairs, lambda z: F.transform(cuts, lambda k: block(F.slice(z, k * _BLOCK + 1, F.lit(_BLOCK)))))
        return F.when(F.size(both["m"]) > 0, let(blocks, place)).otherwise(empty(one))

    return let(F.struct(found.alias("m"), gaps.alias("g")), pair)


def _gain(n: Column) -> Column:
    """(n + 1) log2 (n + 1) - n log2 n: what one more of a character adds, by its count before."""
    table = [(k + 1) * math.log2(k + 1) - (k * math.log2(k) if k else 0.0) for k in range(WIDTH + 1)]
    return F.get(F.array(*map(F.lit, table)), n)


def best_entropy(value: Column, width: int = WIDTH) -> Column:
    """Greatest Shannon entropy (bits a character) of any window of `width` characters from + to z; of shorter
    strings, -1.

    The window's counts are carried along: at each step the character that leaves takes one from its count and the one
    that enters adds one, and the sum changes by these two alone. The time is linear in the length.
    """
    fields = (_LAST - _FIRST) // _FIELDS + 1
    none = F.expr("struct(cast(-1 as int) as w, 0L as u, cast(0 as int) as s)")  # nothing leaves the first window

    def place(c):  # number, unit and shift of a character's field
        code = F.ascii(c) - _FIRST
        shift = F.expr("cast(0 as int)") + code % _FIELDS * _BITS
        return let(shift, lambda s: F.struct(F.floor(code / _FIELDS).cast("int").alias("w"), F.call_function("shiftleft", F.expr("1L"), s).alias("u"), s.alias("s")))

    def times(counts, c):
        return F.call_function("shiftright", F.get(counts, c["w"]), c["s"]).bitwiseAND(F.expr(f"{(1 << _BITS) - 1}L")).cast("int")

    def step(a, z):
        counts, out, in_ = a["counts"], z["leave"], z["enter"]
        same = (out["w"] == in_["w"]) & (out["s"] == in_["s"])
        less = F.when(out["w"] < 0, 0.0).otherwise(_gain(times(counts, out) - 1))
        more = _gain(times(counts, in_) - same.cast("int"))
        each = [F.get(counts, F.lit(k)) + F.when(in_["w"] == k, in_["u"]).otherwise(F.expr("0L"))
                - F.when(out["w"] == k, out["u"]).otherwise(F.expr("0L")) for k in range(fields)]
        return let(a["s"] - less + more, lambda s: F.struct(
            F.array(*each).alias("counts"), s.alias("s"), (a["i"] + 1).alias("i"),
            F.when(a["i"] + 1 >= width, F.least(a["least"], s)).otherwise(a["least"]).alias("least")))

    zero = F.struct(
        F.array(*[F.expr("0L")] * fields).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(1e300).alias("least"))
    chars = F.transform(F.filter(F.split(value, ""), lambda x: x != ""), place)
    late = F.array_repeat(none, width)
    both = lambda c: F.arrays_zip(c.alias("enter"), F.slice(F.concat(late, c), F.lit(1), F.size(c)).alias("leave"))
    done = lambda a: F.lit(math.log2(width)) - a["least"] / width
    return F.when(F.length(value) >= width, F.aggregate(let(chars, both), zero, step, done)).otherwise(F.lit(-1.0))


def allowed(value: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | value.rlike(pattern)
    return out


_SPAN = "array<struct<at: int, rank: int, kind: string, end: int>>"


def _base(text: Column, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    found = spans(text, pattern)
    if group:
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], pattern, group)) >= least)
    return F.transform(found, lambda x: _span(x, F.lit(kind), F.lit([*BASE].index(kind))))


def _entropy(text: Column, kind: str) -> Column:
    """Spans of the maximal runs of a class that hold a window as mixed as the class asks."""
    names = [*CLASSES]
    alphabet, bits = CLASSES[kind]
    narrower = CLASSES[names[names.index(kind) - 1]][0] if kind != names[0] else None

    def secret(x):
        m = x["m"]
        own = m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~allowed(m)
        if narrower:
            own = own & ~m.rlike(f"^{narrower}+$")
        return own & (F.round(best_entropy(m), 9) >= bits)

    found = F.filter(spans(text, f"{alphabet}{{{WIDTH},}}"), secret)
    return F.transform(found, lambda x: _span(x, F.lit(kind), F.lit(len(BASE) + names.index(kind))))


def _span(x: Column, kind: Column, rank: Column) -> Column:
    return F.struct(x["at"].alias("at"), rank.alias("rank"), kind.alias("kind"), x["end"].alias("end"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): array<struct<at, rank, kind, end>> of all spans of the whole text, by start and kind, ends
    exclusive, in code points.

    Kinds are the base forms (each leftmost and non-overlapping by itself) and the entropy classes. Every maximal run of
    a class is judged by itself, so a run of a narrower class is found inside one of a wider class and may lie in its
    span. Long texts and runs take time in proportion. A null or empty text has none. Rows are scanned each by itself, so repeated rows give equal results and an empty table an empty
    one; other columns are not read.
    """
    body = F.col("__t")
    # most texts hold none of it: cheap tests first
    hints = {
        "assign": body.rlike("[:=]") & body.rlike(BASE["assign"][0]), "access": body.contains("AKIA"),
        "hex": body.rlike(BASE["hex"][0]), **{k: body.rlike(f"{a}{{{WIDTH},}}") for k, (a, _) in CLASSES.items()},
    }
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    none = F.array().cast(_SPAN)
    parts = [F.when(hints[k], _base(body, k).cast(_SPAN)).otherwise(none) for k in BASE]
    parts += [F.when(hints[k], _entropy(body, k).cast(_SPAN)).otherwise(none) for k in CLASSES]
    return rows.select("doc_id", F.sort_array(F.concat(*parts)).alias("found"))


def said(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["at"], x["end"])), ",")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of find(): counts and hash of the base spans, all spans."""
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    return find(docs, doc_id, text).select(
        "doc_id", *map(count, BASE), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans")
    )
