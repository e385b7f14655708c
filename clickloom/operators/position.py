"""Dense positions in a total order, without a window over everything.

A cell is a coarse, order-keeping key (a date, a prefix). Rows are numbered within
their cell and the counts of lower cells are added, so the largest task holds one
cell, not one partition of the order; the table of cells is what is left to sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_position(df: DataFrame, cell: Column, order: Sequence[Column], by: Sequence[str] = (), out: str = "position", total: str | None = None) -> DataFrame:
    """Add the position (from 1) of each row in ``order`` within ``by``; ``total`` names the count of rows."""
    named = df.withColumn("_cell", cell)
    keys = list(by)
    counts = named.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    counts = counts.select(
        *keys,
        F.col("_cell").alias("_cell_r"),
        (F.sum("_n").over(group.orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_below"),
        F.sum("_n").over(group).alias("_total"),
    )
    counts = counts.toDF(*[f"_by_{k}" for k in keys], "_cell_r", "_below", "_total")
    numbered = named.withColumn("_in_cell", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order)))
    match = F.col("_cell").eqNullSafe(F.col("_cell_r"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    joined = numbered.join(counts, match).withColumn(out, (F.col("_below") + F.col("_in_cell")).cast("long"))
    if total:
        joined = joined.withColumn(total, F.col("_total").cast("long"))
    return joined.select(*df.columns, out, *([total] if total else []))
