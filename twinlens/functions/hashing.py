"""Deterministic pseudo-randomness keyed on row identity.

``rand()`` is re-evaluated by every action and depends on the partitioning; a
digest of the row key gives the same draw however the data is laid out and
survives task retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex_to_long(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def hash_bucket(key: Column, seed: int = 42, buckets: int = 1000) -> Column:
    """Bucket 0..buckets-1 of ``key`` under ``seed``."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.pmod(_hex_to_long(digest, 8), F.lit(buckets).cast("bigint"))


def hash_draw(key: Column, salt: str, seed: int, n: Column) -> Column:
    """Uniform integer in 0..n-1 for (row, salt, seed); 60 random bits."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{salt}:{seed}")))
    return F.pmod(_hex_to_long(digest, 15), n.cast("bigint"))


def hash_uniform(key: Column, salt: str, seed: int) -> Column:
    """Uniform double in the open interval (0, 1), in steps of 2^-52."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{salt}:{seed}")))
    return (_hex_to_long(digest, 13).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def row_key(*columns: str) -> Column:
    """Text key of a row from the given columns (NULL is spelled out)."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
