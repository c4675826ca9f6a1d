"""Identities: hashes over text we format ourselves, and the hash split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT_SCHEMA = "source-group-split/1"


def fixed_text(x: Column, places: int) -> Column:
    """Half-even rounded decimal text without exponents, so the same number always hashes the same."""
    r = F.bround(x, places)
    return F.when(r == 0, F.lit(0.0)).otherwise(r).cast(f"decimal(38,{places})").cast("string")


def hash_bucket(text: Column) -> Column:
    """First 8 bytes of sha256 as an unsigned number, modulo 10000."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(10000).cast("decimal(20,0)")).cast("int")


def source_split(source: Column, salt: str, basis_points: int) -> Column:
    text = F.concat(F.lit(SPLIT_SCHEMA + "\0" + salt + "\0"), source)
    return F.when(hash_bucket(text) < basis_points, "evaluation").otherwise("development")


LANES = 4


def _sums(digest: Column) -> list[Column]:
    """Sums of four 60-bit parts of a hash over a group; partial sums are made before the shuffle."""
    part = lambda i: F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    return [F.sum(part(i)).alias(f"_s{i}") for i in range(LANES)]


def _folded() -> Column:
    return F.sha2(F.concat_ws(",", F.col("_n").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(LANES)]), 256)


def set_hash(df: DataFrame, keys: Sequence[str], item: str, name: str) -> DataFrame:
    """Order-free hash of a key's distinct items: their hashes are added up, so no set is ever gathered."""
    keys = list(keys)
    one = df.select(*keys, F.sha2(F.col(item).cast("string"), 256).alias("_h")).distinct()
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *_sums(F.col("_h"))).select(*keys, _folded().alias(name))


def ordered_hash(df: DataFrame, keys: Sequence[str], ix: str, text: Column, name: str) -> DataFrame:
    """Hash of a key's texts in the order of `ix`.

    The position is hashed with each text and the hashes are added up: one shuffle of partial sums, whatever
    the length. The digest is our own definition.
    """
    keys = list(keys)
    rows = df.select(*keys, F.sha2(F.concat(F.col(ix).cast("string"), F.lit("\n"), text), 256).alias("_h"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *_sums(F.col("_h"))).select(*keys, _folded().alias(name))
