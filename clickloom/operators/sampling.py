"""Seeded orders and head samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def shuffled(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Rows in a pseudo-random order that depends on their keys and the seed alone (another seed for each epoch)."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows in a stated order, for smoke runs."""
    return df.orderBy(*order).limit(n)
