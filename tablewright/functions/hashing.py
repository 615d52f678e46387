"""Seeded choices as column expressions.

Every random choice in the package is derived from md5 of a seed or tag and the
row's key. The result is the same for any partitioning, survives task retries,
and can be recomputed by any other engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def order_key(*keys: str | Column, seed: int | str = SEED) -> Column:
    """Hex digest whose order is a seeded permutation of the rows.

    A single key is written as it is after the seed. Several are each written with
    their length before them, so different keys give different texts; a null is
    written without length.
    """
    parts = [_column(k).cast("string") for k in keys]
    if len(parts) == 1:
        # a null key has the seed alone, without the colon
        text = F.concat(F.lit(f"{seed}"), F.coalesce(F.concat(F.lit(":"), parts[0]), F.lit("")))
        return F.md5(text)
    written = [
        F.coalesce(F.concat(F.lit(":"), F.length(p).cast("string"), F.lit(":"), p), F.lit(":")) for p in parts
    ]
    return F.md5(F.concat(F.lit(f"{seed}"), *written))


def draw(tag: str, key: str | Column, n: int | Column) -> Column:
    """Integer in [0, n) from 32 bits of the digest of ``tag:key``."""
    digest = F.md5(F.concat(F.lit(f"{tag}:"), _column(key).cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return number % (F.lit(n) if isinstance(n, int) else n)


def _column(key: str | Column) -> Column:
    return F.col(key) if isinstance(key, str) else key
