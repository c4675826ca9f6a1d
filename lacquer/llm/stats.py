"""Statistics of whole texts as JVM expressions, for quality rules and the quality classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a window whose repetition counts.
REPEAT = 8
#: What rules and scores may look at; all are computed from the text alone.
SHARES = ["symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share", "digit_share", "word_length", "line_words", "distinct_share"]


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is never inlined into the lambdas inside."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of REPEAT words that are found twice or more. Windows are compared by hash; only texts
    with a repeated one sort them."""

    def covered(win):
        marked = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s):
            n = F.size(s)
            twin = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-REPEAT).alias("last"))
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(REPEAT), x - a["last"])).alias("n"), x.alias("last"))
        return let(marked, lambda s: F.aggregate(starts(s), zero, step, lambda a: a["n"]))

    def joined(h, k):
        return F.transform(F.slice(h, 1, F.size(h) - k), lambda x, i: F.xxhash64(x, F.get(h, i + k)))

    none = F.lit(0).cast("long")
    all_new = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    # runs of 2, 4 and 8 words; without a repeated run of 4 there is none of 8
    by_four = lambda h: F.when(all_new(h), none).otherwise(let(joined(h, 4), lambda w: F.when(all_new(w), none).otherwise(covered(w))))
    by_two = lambda h: let(joined(h, 2), by_four)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < REPEAT, none).otherwise(let(hashes, lambda h: let(joined(h, 1), by_two)))


def with_stats(docs: DataFrame, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """Columns `keep` of each row and the statistics of its whole text; a null text counts as empty, and shares of
    nothing are 0.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words are counts (long); the SHARES are doubles.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = docs.select(
        *(F.col(f"`{c}`") for c in keep), body.alias("__t"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("__w"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
    )
    count = lambda pattern: F.regexp_count("__t", F.lit(pattern)).cast("long")
    counted = split.select(
        *(F.col(f"`{c}`") for c in keep), F.size("__w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__t", BLANK, "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__w")).alias("n_repeat_words"), F.size("__l").cast("long").alias("__lines"),
        count(r"\p{Lu}").alias("__upper"), count(r"[!?]").alias("__marks"), count(r"[0-9]").alias("__digits"),
        F.size(F.array_distinct("__w")).cast("long").alias("__distinct"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.select(
        *(F.col(f"`{c}`") for c in keep), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "__lines").alias("dup_line_share"), share("__upper", "word_chars").alias("upper_share"),
        share("__marks", "word_chars").alias("mark_share"), share("__digits", "word_chars").alias("digit_share"),
        share("word_chars", "n_words").alias("word_length"), share("n_words", "__lines").alias("line_words"),
        share("__distinct", "n_words").alias("distinct_share"),
    )


def labelled_sample(labels: DataFrame, rows: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, quality) of about `rows` labelled rows at most, chosen by a hash of the id; rows whose crc32 of the id
    leaves 0 by 5 are held out. Some MB at most, so it may be broadcast."""
    own = labels.where("quality is not null").where(f"{doc_id} is not null").where(F.crc32(F.col(doc_id).cast("string")) % 5 != 0)
    n = own.count()
    part = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, rows / max(1, n))))
    return own.where(part).groupBy(doc_id).agg(F.min("quality").alias("quality"))
