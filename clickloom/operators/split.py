"""Chronological splits by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.operators.position import with_position

# Columns that valid and test rows must not carry.
LEAKING = ("reviewText", "user_hist_id", "user_hist_title")


def split_points(n: Column) -> tuple[Column, Column]:
    """(rows of train, rows of train and valid) of n rows, rounded half to even."""
    test = F.bround(n.cast("double") * 0.9, 0).cast("long")
    return F.bround(test.cast("double") * (8 / 9), 0).cast("long"), test


def chronological_split(df: DataFrame, time: Column, tie: Sequence[Column], by: Sequence[str] = (), cell: Column | None = None) -> DataFrame:
    """Add ``split`` (train, valid, test: 80/10/10 by time); rows without a time are dropped.

    A group too small for three non-empty splits has split NULL throughout; see
    ``split_sizes`` and ``require_splits``.
    """
    timed = df.withColumn("_time", time).where("_time is not null")
    placed = with_position(timed, cell if cell is not None else F.to_date("_time"), [F.col("_time"), *tie], by, "_rank", "_rows")
    train, valid = split_points(F.col("_rows"))
    whole = (train > 0) & (valid > train) & (F.col("_rows") > valid)
    name = F.when(whole, F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= valid, "valid").otherwise("test"))
    return placed.withColumn("split", name).drop("_time", "_rank", "_rows")


def require_splits(df: DataFrame) -> DataFrame:
    """Fail the job at the first row whose group was too small to be split."""
    return df.where(F.when(F.col("split").isNull(), F.raise_error(F.lit("a split would be empty: too few rows"))).otherwise(True))


def split_columns(df: DataFrame, split: str) -> DataFrame:
    """The rows of one split; valid and test lose the columns that leak."""
    part = df.where(F.col("split") == split).drop("split")
    return part if split == "train" else part.drop(*LEAKING)
