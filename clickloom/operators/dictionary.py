"""Dense integer dictionaries and their lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.operators.position import with_position


def build_dictionary(values: Sequence[DataFrame], unknown: str, cell_chars: int = 3) -> DataFrame:
    """(value, idx) of the distinct values of all one-column inputs and ``unknown``, by code point order from 0."""
    spark = values[0].sparkSession
    every = spark.createDataFrame([(unknown,)], "value string")
    for df in values:
        every = every.unionByName(df.select(F.col(df.columns[0]).cast("string").alias("value")))
    distinct = every.where("value is not null").distinct()
    placed = with_position(distinct, F.substring("value", 1, cell_chars), [F.col("value")], out="idx")
    return placed.select("value", (F.col("idx") - 1).alias("idx"))


def encode(df: DataFrame, dictionary: DataFrame, col: Column, unknown: str, out: str) -> DataFrame:
    """Add the index of ``col``; values that the dictionary lacks get the index of ``unknown``."""
    lookup = dictionary.select(F.col("value").alias("_value"), F.col("idx").alias("_idx"))
    fallback = dictionary.where(F.col("value") == unknown).agg(F.max("idx").alias("_unknown"))  # one row
    joined = df.join(lookup, col.cast("string") == F.col("_value"), "left").join(F.broadcast(fallback))
    return joined.withColumn(out, F.coalesce("_idx", "_unknown")).drop("_value", "_idx", "_unknown")


def encode_list(df: DataFrame, dictionary: DataFrame, key: str, items: Column, unknown: str, out: str, limit: int | None = None) -> DataFrame:
    """``product_<idx>`` of each item of a list, joined by ' and ', in order; empty lists give the unknown product.

    ``key`` identifies rows; ``limit`` keeps the first items (top-k).
    """
    chosen = F.slice(items, 1, limit) if limit else items
    each = df.select(F.col(key).alias("_key"), F.posexplode(chosen).alias("_pos", "_item"))
    lookup = dictionary.select(F.col("value").alias("_value"), F.col("idx").alias("_idx"))
    fallback = dictionary.where(F.col("value") == unknown).agg(F.max("idx").alias("_unknown"))  # one row
    found = each.join(lookup, F.col("_item") == F.col("_value"), "left").join(F.broadcast(fallback))
    found = found.select("_key", F.struct("_pos", F.concat(F.lit("product_"), F.coalesce("_idx", "_unknown").cast("string")).alias("p")).alias("_s"))
    lists = found.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["p"]), " and ").alias("_text"))
    joined = df.join(lists, F.col(key) == F.col("_key"), "left").join(F.broadcast(fallback))
    return joined.withColumn(out, F.coalesce("_text", F.concat(F.lit("product_"), F.col("_unknown").cast("string")))).drop("_key", "_text", "_unknown")
