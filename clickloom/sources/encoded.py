"""Lines of text files in UTF-8, Latin-1 or UTF-16, read by byte ranges.

A file of any size is many tasks. A first pass looks at every range (byte order mark,
zero bytes at even and odd places, whether its lines are UTF-8), an aggregate gives each
file one encoding, and a second pass decodes. A line belongs to the range that holds
its first byte, so lines are the same under any range size.

Defined results: a mark decides and belongs to no line; without one, a file with zeros
in at least `ZEROS_ONE_SIDE` of the bytes of one parity and at most `ZEROS_OTHER_SIDE`
of the other is UTF-16; else it is UTF-8 if all of it is, and Latin-1 if not. Lines end
at ``\\n`` or ``\\r\\n``, the last one needs no end, blank lines give no rows; a unit cut off at
the end of a UTF-16 file, or half a pair in it, gives a replacement character; empty
files and folders give no rows.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of a range (even, so a unit of two bytes is never cut) and of one read.
RANGE_BYTES, READ_BYTES = 32 << 20, 1 << 20
#: Zero bytes a byte of one parity and of the other that tell UTF-16 without a mark.
ZEROS_ONE_SIDE, ZEROS_OTHER_SIDE = 0.3, 0.05

# Byte order marks and their encodings.
MARKS = {codecs.BOM_UTF8: "utf-8", codecs.BOM_UTF16_LE: "utf-16-le", codecs.BOM_UTF16_BE: "utf-16-be"}


def open_file(path: str) -> pa.NativeFile:
    """A file of any file system that Arrow knows, for reading at places."""
    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))
    return system.open_input_file(name)


def _next_end(data: bytes, start: int, end: bytes) -> int:
    """Where the first line end at a whole unit from ``start`` on begins, or -1; ``data`` and ``start`` lie at whole units."""
    at = data.find(end, start)
    while at >= 0 and at % len(end):
        at = data.find(end, at + 1)
    return at


def lines_of_range(file: pa.NativeFile, begin: int, size: int, end: bytes) -> Iterator[tuple[int, bytes]]:
    """(first byte, bytes without the end) of the lines that begin in the range."""
    unit, stop, length = len(end), begin + size, file.size()
    at = begin
    if begin:  # a line begins here only if the unit before ends one
        at = begin - unit
    file.seek(at)
    held, place, skip = b"", at, begin > 0
    while True:
        read = file.read(READ_BYTES)
        held, cut = held + read, 0
        while (found := _next_end(held, cut, end)) >= 0:
            if not skip:
                if place + cut >= stop:
                    return
                yield place + cut, held[cut:found]
            skip, cut = False, found + unit
        if skip and len(held) > cut + 2 * unit:  # nothing of the line before the range is needed
            cut = (len(held) - unit) // unit * unit
        held, place = held[cut:], place + cut
        if not skip and place >= stop:
            return
        if not read:
            if held and not skip and place < min(stop, length):
                yield place, held
            return


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """path, begin, size: listed by Spark, no content read, spread over the cluster."""
    if range_bytes % 2:
        raise ValueError("ranges hold an even number of bytes")
    files = spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") > 0)
    begins = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("begin"))
    return begins.select("path", "begin", F.least(F.lit(range_bytes).cast("long"), F.col("length") - F.col("begin")).alias("size")).repartition("path", "begin")


def file_encodings(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, encoding, mark_bytes: one row a file that isn't empty."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as file:
                    mark, zeros = b"", [0, 0]
                    if row["begin"] == 0:
                        head = file.read(3)
                        mark = next((m for m in MARKS if head.startswith(m)), b"")
                    file.seek(row["begin"])
                    left = row["size"]
                    while left and (data := file.read(min(left, READ_BYTES))):
                        for side in (0, 1):
                            zeros[side] += data[side::2].count(0)
                        left -= len(data)
                    plain = True
                    for _, line in lines_of_range(file, row["begin"], row["size"], b"\n"):
                        try:
                            line.decode("utf-8")
                        except UnicodeDecodeError:
                            plain = False
                            break
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "mark": MARKS.get(mark), "mark_bytes": len(mark), "even": zeros[0], "odd": zeros[1], "bytes": row["size"], "plain": plain}], schema)

    schema = pa.schema([("path", pa.string()), ("mark", pa.string()), ("mark_bytes", pa.int32()), ("even", pa.int64()), ("odd", pa.int64()), ("bytes", pa.int64()), ("plain", pa.bool_())])
    seen = _ranges(spark, path, range_bytes).mapInArrow(look, "path string, mark string, mark_bytes int, even long, odd long, bytes long, plain boolean")
    files = seen.groupBy("path").agg(F.max("mark").alias("mark"), F.max("mark_bytes").alias("mark_bytes"), F.sum("even").alias("even"), F.sum("odd").alias("odd"), F.sum("bytes").alias("bytes"), F.bool_and("plain").alias("plain"))
    half = F.col("bytes") / 2
    wide = lambda one, other: (F.col(one) >= ZEROS_ONE_SIDE * half) & (F.col(other) <= ZEROS_OTHER_SIDE * half)
    found = F.when(F.col("mark").isNotNull(), F.col("mark")).when(wide("odd", "even"), "utf-16-le").when(wide("even", "odd"), "utf-16-be").when(F.col("plain"), "utf-8").otherwise("latin-1")
    return files.select("path", found.alias("encoding"), "mark_bytes")


def read_encoded(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, encodings: DataFrame | None = None) -> DataFrame:
    """path, begin, encoding, line: ``begin`` is the line's first byte, which orders the lines of a file."""
    known = encodings if encodings is not None else file_encodings(spark, path, range_bytes)
    schema = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("encoding", pa.string()), ("line", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name, mark = row["encoding"], row["mark_bytes"]
                end, out, held = "\n".encode(name), [], 0
                with open_file(row["path"]) as file:
                    for begin, line in lines_of_range(file, row["begin"], row["size"], end):
                        text = (line[mark:] if begin == 0 else line).decode(name, "replace").removesuffix("\r")
                        if text.strip():
                            out.append((row["path"], begin, name, text))
                            held += len(line)
                        if held >= READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ranges = _ranges(spark, path, range_bytes).join(known, "path")
    return ranges.select("path", "begin", "size", "encoding", "mark_bytes").mapInArrow(decode, "path string, begin long, encoding string, line string")
