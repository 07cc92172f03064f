"""Keyed uniforms: random choices that depend on a seed and a key only, not on partitions.

u(seed, key) is the first 8 hex digits of MD5("seed:key") over 2**32, so any SQL engine with
MD5 draws the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*key: Column | str | int) -> Column:
    return F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key])


def shuffle_key(seed: int | str, *key: Column | str | int) -> Column:
    """A string to order by for a random order."""
    return F.md5(_text(seed, *key))


def uniform(seed: int | str, *key: Column | str | int) -> Column:
    return F.conv(F.substring(shuffle_key(seed, *key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick_index(seed: int | str, n: Column | int, *key: Column | str | int) -> Column:
    """A uniform integer from 0 to n - 1."""
    return F.floor(uniform(seed, *key) * n).cast("int")


def base(seed: int | str, *key: Column | str | int) -> Column:
    """One of A, C, G, T."""
    return F.substring(F.lit("ACGT"), F.lit(1) + pick_index(seed, 4, *key), F.lit(1))
