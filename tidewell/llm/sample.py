"""Bounded samples that models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 62


def hash_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows: those whose hashed unique key lies below size / rows of the hash range; all rows of a smaller table.

    A narrow filter (the count comes from file footers), so nothing is sorted or gathered; the same rows at every run.
    """
    rows = df.count()
    if rows <= size:
        return df
    return df.where(F.xxhash64(key).bitwiseAND(_RANGE - 1) < int(size / rows * _RANGE))
