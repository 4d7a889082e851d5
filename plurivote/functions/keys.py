"""Repeatable pseudo-random keys: the same for any engine and any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex digits of the order key that name a bucket: 16**4 = 65,536 equal slices.
BUCKET_DIGITS = 4
MAX_BUCKETS = 16**BUCKET_DIGITS


def order_key(seed, *parts) -> Column:
    """Hex digest of ``seed:part:part…``; sorting by it is a random order."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def hash32(seed, *parts) -> Column:
    """First 32 bits of the order key as a number."""
    return F.conv(F.substring(order_key(seed, *parts), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Number in [0, 1) drawn from the order key."""
    return hash32(seed, *parts) / F.lit(4294967296.0)


def bucket_of(key: Column) -> Column:
    """Slice of an order key. The digits sort like the numbers they stand for."""
    return F.substring(key, 1, BUCKET_DIGITS)
