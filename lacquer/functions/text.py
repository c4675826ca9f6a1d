"""Text expressions: durations, titles, names, credits, dates, identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed patterns of the accepted formats.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CLOCK = r"^(?:(\d+):)?(\d{1,2}):(\d{2})(?:\.(\d+))?$"
LEADING_NUMBER = r"^\s*(?:[A-Za-z]?\d+[.)-]?|\d+)\s+"
NUMBER_FIELD = r"^[A-Za-z]?\d+[.)-]?$"
SIDE_CODE = r"^\s*([A-Za-z]{1,2})\s*[-.]?\s*0*(\d+)\s*$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PARTIAL_DATE = r"^\d{4}(-\d{2}(-\d{2})?)?$"


def duration(text: Column) -> Column:
    """struct(valid, seconds): seconds or M:SS or H:MM:SS(.f). Zero and negative numbers are valid but null.

    The clock pattern is matched once; it fixes where the parts lie, so they are cut out without it. Only text that
    looks like a number is cast: a failed cast to double costs an exception for each row.
    """
    t = F.trim(text)
    num = t.rlike(NUMBER)
    n = F.when(num, t).try_cast("double")
    parts = F.split(t, ":")
    last, long = F.element_at(parts, -1), F.size(parts) == 3
    b_, s_ = F.get(parts, F.size(parts) - 2).try_cast("double"), F.substring(last, 1, 2).try_cast("double")
    hours = F.when(long, F.get(parts, F.lit(0)).try_cast("double")).otherwise(F.lit(0.0))
    clock = t.rlike(CLOCK) & (s_ < 60) & (~long | (b_ < 60))
    part = F.concat(F.lit("0."), F.regexp_extract(last, r"\.(\d+)", 1))
    frac = F.when(F.contains(last, F.lit(".")), part.try_cast("double")).otherwise(F.lit(0.0))
    finite = num & n.isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(1e300))
    seconds = F.when(finite, F.when(n > 0, n)).when(clock, hours * 3600 + b_ * 60 + s_ + frac)
    return F.struct(F.coalesce(finite | clock, F.lit(False)).alias("valid"), seconds.alias("seconds"))


def bare_title(text: Column) -> Column:
    """Title without its leading number or side code."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, LEADING_NUMBER, ""), r"^[| ]+", ""))


def title_or_number(title: Column, position: Column) -> Column:
    """The title; a numbered stand-in when nothing is left of it."""
    return F.when(title != "", title).otherwise(F.concat(F.lit("Track "), F.lpad(position.cast("string"), 2, "0")))


def clean_title(text: Column, position: Column) -> Column:
    return title_or_number(bare_title(text), position)


@F.pandas_udf(StringType())
def _nfc_fold(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFC", s).split()).casefold())


@F.pandas_udf(StringType())
def _nfc_key(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).casefold())


ASCII = r"^[\x00-\x7F]*$"


def identity_text(text: Column) -> Column:
    """NFC, single spaces, case folded. (Exact for every script; the vector UDF does the folding.)"""
    return _nfc_fold(text)


def identity_text_ascii(text: Column) -> Column:
    """The same without leaving the JVM, for text already known to be ASCII; null for any other."""
    flat = F.lower(F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f]+", " ")))
    return F.when(text.rlike(ASCII), flat)


def name_key(name: Column) -> Column:
    """Key under which two file names collide on any file system: NFC and case folded."""
    return _nfc_key(name)


def safe_name(name: Column, fallback: str = "Track") -> Column:
    """File-name text without forbidden characters, trailing dots or spaces, or reserved device names."""
    t = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', " ")
    t = F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r"[. ]+$", ""))
    t = F.when(t == "", F.lit(fallback)).otherwise(t)
    return F.when(F.upper(t).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), t)).otherwise(t)


def first_nonblank(*fields: Column) -> Column:
    """First field that is not blank, spaces collapsed; the empty string when all are."""
    flat = [F.trim(F.regexp_replace(f, r"\s+", " ")) for f in fields]
    return F.coalesce(*[F.when(x != "", x) for x in flat], F.lit(""))


def joined_credit(artists: Column) -> Column:
    """Names with their join phrases; ', ' between entries that give none. artists: array<struct<name, joinphrase>>."""
    last = F.size(artists) - 1
    name = lambda a: F.trim(F.coalesce(a["name"], F.lit("")))
    piece = F.transform(artists, lambda a, i: F.when(name(a) == "", F.lit("")).otherwise(F.concat(
        name(a), F.coalesce(a["joinphrase"], F.when(i < last, F.lit(", ")).otherwise(F.lit(""))))))
    return F.coalesce(F.trim(F.array_join(piece, "")), F.lit(""))


def plain_credit(artists: Column) -> Column:
    """Catalogue form: names and the phrases that are given, nothing in between otherwise."""
    piece = F.transform(artists, lambda a: F.concat(
        F.trim(F.coalesce(a["name"], F.lit(""))), F.coalesce(a["joinphrase"], F.lit(""))))
    return F.coalesce(F.trim(F.array_join(piece, "")), F.lit(""))


def cue_quoted(text: Column) -> Column:
    """One printable line in double quotes; inner double quotes become two single ones."""
    flat = F.trim(F.regexp_replace(text, r"[\x00\s]+", " "))
    return F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit("''")), F.lit('"'))


def side_code(number: Column) -> tuple[Column, Column]:
    """('A', 3) from 'A3', 'a-03' or 'A.3'; empty side and null position otherwise."""
    side = F.upper(F.regexp_extract(number, SIDE_CODE, 1))
    return side, F.when(side != "", F.regexp_extract(number, SIDE_CODE, 2).try_cast("int"))


def partial_date(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD when it is a real date; null otherwise."""
    whole = F.concat(text, F.when(F.length(text) == 4, F.lit("-01-01")).when(F.length(text) == 7, F.lit("-01")).otherwise(F.lit("")))
    real = F.try_to_date(whole, "yyyy-MM-dd").isNotNull() & (F.substring(text, 1, 4) != "0000")
    return F.when(text.rlike(PARTIAL_DATE) & real, text)


def uuid_or_null(text: Column) -> Column:
    return F.when(text.rlike(UUID), text)


def aliased_duration(seconds: Column, expected: Column, millis: Column) -> tuple[Column, Column]:
    """(value, conflict): the first of three given durations, and whether another differs by over 1 ms."""
    ms = millis / 1000.0
    first = F.coalesce(seconds, expected, ms)
    far = lambda x: F.coalesce(F.abs(x - first) > 0.001000001, F.lit(False))
    return first, far(seconds) | far(expected) | far(ms)


def aliased_uuid(short: Column, long: Column) -> tuple[Column, Column]:
    a, b = uuid_or_null(short), uuid_or_null(long)
    return F.coalesce(a, b, F.lit("")), F.coalesce(a != b, F.lit(False))


def stable_15(x: Column) -> Column:
    """15 significant digits."""

    @F.pandas_udf("double")
    def digits(v: pd.Series) -> pd.Series:
        return v.map(lambda n: float(f"{n:.15g}"))

    return digits(x)


def stable_9(x: Column) -> Column:
    """9 decimals, halves to even, without a negative zero."""
    r = F.bround(x, 9)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)
