"""Lines of text files with their place in the source, the same under any split size.

Spark cuts files into splits and reads them in any order. An index over the splits
(where each begins, and how many lines begin in it) gives by prefix sums how many
lines precede a split, in the order of files and bytes; the line's place within its
split is added. The first n lines, and the first row of a key, are then the same
rows on every cluster, and no line is shuffled or sorted to number it.

The index has a row a split, so a corpus of 100 TB in splits of 128 MB makes some
800,000; it is computed once, broadcast, and can be kept as a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

_BAD = "_bad_line"


def _splits(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, begin, id, line): ids rise within a partition, so they rise within a split."""
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    return lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_begin"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))


def line_index(spark: SparkSession, path: str | Sequence[str], keep: str | None = None) -> DataFrame:
    """A row for each split with lines: ``file``, ``begin``, ``first_id``, ``lines`` and ``lines_before``.

    Files are in the order of their paths. ``keep`` names a folder where the index is
    written; it holds for the split size that it was made under.
    """
    counts = _splits(spark, path).groupBy("_file", "_begin").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("lines"))
    before = Window.orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    index = counts.select(F.col("_file").alias("file"), F.col("_begin").alias("begin"), "first_id", "lines")
    index = index.withColumn("lines_before", F.coalesce(F.sum("lines").over(before), F.lit(0)).cast("long"))
    if not keep:
        return index
    index.write.mode("overwrite").parquet(keep)
    return spark.read.parquet(keep)


def numbered_lines(spark: SparkSession, path: str | Sequence[str], limit: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """(file, place, line): ``place`` counts all lines of all files from 0, in the order of paths and bytes.

    ``limit`` keeps the first lines; splits beyond them give no rows. No files, or
    empty ones, give no rows; a line's end belongs to no line; the last line needs none.
    """
    index = index if index is not None else line_index(spark, path)
    if limit is not None:
        index = index.where(F.col("lines_before") < limit)
    known = F.broadcast(index.select(F.col("file").alias("_file"), F.col("begin").alias("_begin"), "first_id", "lines_before"))
    placed = _splits(spark, path).join(known, ["_file", "_begin"])
    placed = placed.select(F.col("_file").alias("file"), (F.col("lines_before") + F.col("_id") - F.col("first_id")).alias("place"), "line")
    return placed.where(F.col("place") < limit) if limit is not None else placed


def numbered_json(spark: SparkSession, path: str | Sequence[str], schema: str, limit: int | None = None, place: str = "place", index: DataFrame | None = None) -> DataFrame:
    """Rows of JSON lines with the place of their line; blank lines and those that don't parse are skipped, but count.

    ``limit`` takes the rows of the first lines, bad ones counted.
    """
    fields = T._parse_datatype_string(schema)
    whole = T.StructType([*fields.fields, T.StructField(_BAD, T.StringType())])
    parsed = numbered_lines(spark, path, limit, index).select("place", F.from_json("line", whole, {"columnNameOfCorruptRecord": _BAD}).alias("_row"))
    good = parsed.where(F.col("_row").isNotNull() & F.col(f"_row.{_BAD}").isNull())
    return good.select(F.col("place").alias(place), *[F.col(f"_row.`{f.name}`").alias(f.name) for f in fields])
