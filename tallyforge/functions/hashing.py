"""Repeatable pseudo-random numbers derived from a row key.

``rand(seed)`` depends on how rows are partitioned, so a split made with it changes when a
task is retried on a different layout. A hash of the key does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _word(key: Column, seed: int | str) -> Column:
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: str | Column, seed: int | str, buckets: int) -> Column:
    """Bucket 0..buckets-1 of a key; a different seed gives an unrelated assignment."""
    key = F.col(key) if isinstance(key, str) else key
    return _word(key, seed) % F.lit(buckets)


def hash_unit(key: str | Column, seed: int | str) -> Column:
    """Number in [0, 1) of a key."""
    key = F.col(key) if isinstance(key, str) else key
    return _word(key, seed).cast("double") / F.lit(4294967296.0)
