"""Hash-based randomness: the same value on any partitioning, in any engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(text: Column) -> Column:
    """First 32 bits of MD5 as a BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def seeded_uniform(seed: int | str, *parts: Column) -> Column:
    """Uniform number in [0, 1) from the row's key parts and a seed."""
    return hash32(F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed)))) / F.lit(float(1 << 32))
