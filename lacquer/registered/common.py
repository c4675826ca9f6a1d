"""What the registered queries share: a registry that holds each query next to its SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register fn(spark, sf_dir) under `name`, with the SQL that must give the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def digest_sql(h: str) -> str:
    """SQL aggregate of the additive digest over the hash expression `h`."""
    parts = " || ',' || ".join(f"sum(('0x' || substr({h}, {15 * i + 1}, 15))::ubigint)::varchar" for i in range(4))
    return f"sha256(count(*)::varchar || ',' || {parts})"
