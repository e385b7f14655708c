"""Profiles and data-quality reports, each in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.text import UNKNOWN, attribute_format_ok, list_format_ok


def unknown_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: rows, unknown rows, and their percentage (2 decimals)."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col(c).isNull() | (F.col(c) == UNKNOWN), 1).otherwise(0)).alias(c) for c in columns])
    each = counts.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("unknown")) for c in columns])).alias("s"))
    return each.select("s.column", F.col("n").alias("n_rows"), F.col("s.unknown").alias("n_unknown"), F.when(F.col("n") > 0, F.bround(F.col("s.unknown") / F.col("n") * 100, 2)).otherwise(0.0).alias("pct_unknown"))


def format_issues(df: DataFrame, lists: Sequence[str] = (), attributes: Sequence[str] = (), sample: int = 5, most: int = 3) -> DataFrame:
    """Bad values among the ``sample`` least distinct values of each column, ``most`` of them a column."""
    out = None
    for names, ok in ((lists, list_format_ok), (attributes, attribute_format_ok)):
        for c in names:
            few = df.select(F.col(c).alias("value")).where("value is not null").distinct().orderBy("value").limit(sample)
            bad = few.where(~ok(F.col("value"))).orderBy("value").limit(most).select(F.lit(c).alias("column"), F.substring("value", 1, 50).alias("issue"))
            out = bad if out is None else out.unionByName(bad)
    return out


def positive_ratio(df: DataFrame, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of positives in percent, 2 decimals."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.bround(F.avg(label.cast("double")) * 100, 2).alias("positive_pct"))


def class_weights(df: DataFrame, label: str, low: float = 0.1, high: float = 20.0) -> DataFrame:
    """Balanced weights n / (k n_c) of the classes, within [low, high]; one class alone weighs 1."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.agg(F.sum("n_rows").alias("_n"), F.count(F.lit(1)).alias("_k"))  # one row
    weight = F.greatest(F.least(F.col("_n") / (F.col("_k") * F.col("n_rows")), F.lit(high)), F.lit(low))
    return counts.join(F.broadcast(totals)).select(label, "n_rows", F.when(F.col("_k") == 1, 1.0).otherwise(weight).alias("weight"))


def positional_join(frames: Sequence[DataFrame], key: str = "sample_id") -> DataFrame:
    """Inner join on the sample id; a sample that any frame lacks fails the job."""
    tagged = None
    for k, df in enumerate(frames):
        marked = df.withColumn(f"_has{k}", F.lit(True))
        tagged = marked if tagged is None else tagged.join(marked, key, "full_outer")
    every = F.lit(True)
    for k in range(len(frames)):
        every = every & F.col(f"_has{k}").isNotNull()
    checked = tagged.where(F.when(every, True).otherwise(F.raise_error(F.concat(F.lit("sample without a counterpart: "), F.col(key).cast("string")))))
    return checked.drop(*[f"_has{k}" for k in range(len(frames))])


def stray_samples(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """Ids that only one side has, and which side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
