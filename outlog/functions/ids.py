"""Deterministic identifiers.

Random ids are recomputed when a task is retried, so a replayed batch would get new ids.
Every id here is a hash of the values that define the row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _c, ColumnOrName


def stable_id(*parts: ColumnOrName) -> Column:
    """``sha2(p1:p2:..., 256)`` as a lowercase hex string."""
    return F.sha2(F.concat_ws(":", *[_c(p).cast("string") for p in parts]), 256)


def seeded_unit(seed: int, *parts: ColumnOrName) -> Column:
    """Deterministic uniform number in [0, 1) per (seed, parts) from 32 bits of md5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[_c(p).cast("string") for p in parts])
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(8)), 16, 10).cast("bigint") / F.lit(4294967296.0)


def seeded_int(seed: int, low: int, high: int, *parts: ColumnOrName) -> Column:
    """Deterministic integer in ``[low, high]`` (both ends inclusive, like ``randint``)."""
    return (F.lit(low) + F.floor(seeded_unit(seed, *parts) * F.lit(high - low + 1))).cast("int")
