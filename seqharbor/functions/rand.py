"""Seeded hash randomness: the same draw for a key under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_32 = float(2**32)


def hash_int32(*parts: Column | str | int) -> Column:
    """First 32 bits of the MD5 of the ``|``-joined parts, as a long in [0, 2^32)."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """Uniform draw in [0, 1)."""
    return hash_int32(*parts) / F.lit(TWO_32)


def uniform_int(low: Column | int, high: Column | int, *parts: Column | str | int) -> Column:
    """Uniform integer draw in [low, high], both ends included."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    span = (high - low + F.lit(1)).cast("double")
    return (low + F.floor(uniform(*parts) * span)).cast("int")
