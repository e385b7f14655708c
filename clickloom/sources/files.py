"""Files at the edges: JSON lines, CSV, text, matrices, result logs, and checks of what was written."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickloom.sources import lines

# The schemas of raw reviews and raw item metadata.
REVIEW_SCHEMA = "reviewerID string, asin string, reviewerName string, reviewText string, summary string, overall double, unixReviewTime bigint, reviewTime string, style map<string,string>, verified boolean, vote string, image array<string>"
META_SCHEMA = "asin string, title string, brand string, price string, rank string, category array<string>, description array<string>, feature array<string>, details map<string,array<string>>, also_buy array<string>, also_view array<string>, similar_item string, date string, main_cat string, fit string, tech1 string, tech2 string"
#: Encodings tried in turn for text files.
ENCODINGS = ("utf-8", "latin-1", "utf-16")


def read_json_lines(spark: SparkSession, path: str | Sequence[str], schema: str, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """JSON lines; lines that don't parse are skipped. ``limit`` keeps the first rows in ``order``, or those of the first lines.

    ``lines.numbered_json`` gives the place of each line as well.
    """
    if limit is not None and not order:
        return lines.numbered_json(spark, path, schema, limit).drop("place")
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path if isinstance(path, str) else list(path))
    return rows.orderBy(*order).limit(limit) if limit is not None else rows


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a byte order mark is skipped, quotes are doubled, cells may hold line breaks."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", bom: bool = True) -> None:
    """CSV with a header; with ``bom`` the first column's name carries the byte order mark."""
    named = df.toDF(*["﻿" + df.columns[0], *df.columns[1:]]) if bom else df
    named.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_text_columns(df: DataFrame, column: str = "text", fallback: str = "reviewText") -> DataFrame:
    """The text column, or the fallback where the text is NULL; an error if there is neither."""
    there = [c for c in (column, fallback) if c in df.columns]
    if not there:
        raise ValueError(f"missing column: {column} or {fallback}")
    return df.withColumn(column, F.coalesce(*[F.col(c) for c in there]))


def split_lines(value: Column) -> Column:
    """Non-blank lines; the whole text if there is none."""
    lines = F.filter(F.split(value, "\r?\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(value))


def read_text(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """(path, line_number, line) of text files, each decoded by the first encoding that fits."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for data in b.column(1).to_pylist():
                for name in encodings:
                    try:
                        texts.append(data.decode(name))
                        break
                    except UnicodeError:
                        continue
                else:
                    raise ValueError(f"none of {', '.join(encodings)} decodes a file")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["path", "value"])

    whole = files.mapInArrow(decode, "path string, value string")
    return whole.select("path", F.posexplode(split_lines(F.col("value"))).alias("line_number", "line"))


def write_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """One line a row."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_matrix(df: DataFrame, path: str, key: str = "sample_id", vector: str = "vec", mode: str = "errorifexists") -> None:
    """Vectors by key, as float arrays."""
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.mode(mode).parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any Hadoop path is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Write Parquet unless the output is there already, then read it back; empty output is an error."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return verify_written(spark.read.parquet(path))


def verify_written(df: DataFrame) -> DataFrame:
    """The table itself, if it has a row."""
    if df.isEmpty():
        raise RuntimeError("the output is empty")
    return df


def write_version(df: DataFrame, base: str) -> str:
    """Write beside earlier versions, never over the input that is being read."""
    path = f"{base.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def append_results(df: DataFrame, path: str) -> None:
    """Append result rows to a log table."""
    df.write.mode("append").parquet(path)


def path_report(spark: SparkSession, templates: dict[str, str], domains: Sequence[str], splits: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """(domain, kind, split, path, exists) of all paths that the templates give."""
    rows = [(d, kind, s, p, exists(spark, p)) for d in domains for kind, t in templates.items() for s in splits for p in [t.format(domain=d, split=s)]]
    return spark.createDataFrame(rows, "domain string, kind string, split string, path string, exists boolean")
