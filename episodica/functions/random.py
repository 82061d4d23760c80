"""Reproducible random numbers: a hash of the row's key, the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column | str, seed: int, purpose: Column | str | None = None) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of key, seed and purpose.

    Draws that must not depend on each other name different purposes; a column may tell them apart by row.
    """
    col = F.col(key) if isinstance(key, str) else key
    parts = [col.cast("string"), F.lit(str(seed))]
    if purpose is not None:
        parts.append(F.lit(purpose) if isinstance(purpose, str) else purpose)
    digest = F.md5(F.concat_ws("#", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def fold(key: Column | str, folds: int, seed: int) -> Column:
    return F.floor(uniform(key, seed, "fold") * folds).cast("int")
