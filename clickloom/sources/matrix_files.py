"""Dense matrices as ``.npy`` files: a data source with a partition for each range of rows.

``write_npy`` makes a folder of parts of bounded size, each a whole ``.npy`` file, and a
manifest that names them in order. Tasks write parts under names of their own; the
manifest, written last under another name and renamed, is what makes them the matrix. So a
task that runs twice, a job that fails, or a reader beside a writer never shows rows
twice or in part. An overwrite drops the parts of the manifest that it replaces.

``read_npy`` takes such a folder, a folder of other ``.npy`` files (in the order of
names), or one file. Only headers are read to plan, and a task reads the bytes of its rows.

Defined results: ``row`` counts from 0 over all parts; axes beyond the second are laid flat;
a vector of numbers has rows of one component. Column-major files, objects and
scalars are refused, as are null vectors, null components and rows of other lengths when
writing. A matrix without rows is a manifest without parts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT, MANIFEST = "npy_rows", "_manifest.json"
#: Bytes of a part that a task gathers before it writes, and of a range that a task reads.
PART_BYTES, RANGE_BYTES = 16 << 20, 16 << 20


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))


@dataclass
class Rows(InputPartition):
    """Rows of one file: where they lie, and the place of the first in the matrix."""

    file: str
    offset: int
    rows: int
    width: int
    dtype: str
    place: int


def header(system: fs.FileSystem, name: str) -> tuple[int, int, str, int]:
    """(rows, width, dtype, offset of the data) of a file."""
    with system.open_input_file(name) as f:
        version = np.lib.format.read_magic(f)
        shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if not shape or dtype.hasobject or (by_columns and len(shape) > 1):
            raise ValueError(f"{name} is a scalar, holds objects, or is laid out by columns")
        return int(shape[0]), int(np.prod(shape[1:], dtype=np.int64)), dtype.str, f.tell()


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Rows]:
        system, top = _system(self.path)
        if system.get_file_info(top).type == fs.FileType.File:
            files = [top]
        elif system.get_file_info(f"{top}/{MANIFEST}").type == fs.FileType.File:
            files = [f"{top}/{p}" for p in _manifest(system, top)]
        else:
            files = sorted(i.path for i in system.get_file_info(fs.FileSelector(top)) if i.path.endswith(".npy"))
        out, place = [], 0
        for name in files:
            n, width, dtype, offset = header(system, name)
            bytes_a_row = max(1, width * np.dtype(dtype).itemsize)
            step = max(1, self.range_bytes // bytes_a_row)
            out += [Rows(name, offset + a * bytes_a_row, min(step, n - a), width, dtype, place + a) for a in range(0, n, step)]
            place += n
        return out or [Rows("", 0, 0, 0, "<f4", 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        system, _ = _system(self.path)
        bytes_a_row = partition.width * np.dtype(partition.dtype).itemsize
        step = max(1, (1 << 20) // max(1, bytes_a_row))
        with system.open_input_file(partition.file) as f:
            for a in range(0, partition.rows, step):
                n = min(step, partition.rows - a)
                data = f.read_at(n * bytes_a_row, partition.offset + a * bytes_a_row)
                x = np.frombuffer(data, partition.dtype).astype(np.float64)
                ends = pa.array(np.arange(n + 1) * partition.width, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + partition.place + a), pa.ListArray.from_arrays(ends, pa.array(x))], names=["row", "vec"])


def _manifest(system: fs.FileSystem, top: str) -> list[str]:
    with system.open_input_stream(f"{top}/{MANIFEST}") as f:
        return json.loads(f.read())["parts"]


@dataclass
class Written(WriterCommitMessage):
    partition: int
    parts: list[str]
    width: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, dtype: str, part_bytes: int, overwrite: bool):
        self.path, self.dtype, self.part_bytes, self.overwrite, self.run = path, dtype, part_bytes, overwrite, uuid.uuid4().hex
        system, top = _system(path)
        if not overwrite and system.get_file_info(f"{top}/{MANIFEST}").type == fs.FileType.File:
            raise ValueError(f"there is a matrix at {path}")
        system.create_dir(top, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = _system(self.path)
        task = TaskContext.get()
        parts, held, size, width = [], [], 0, 0

        def put() -> None:
            nonlocal held, size
            name = f"part-{self.run}-{task.partitionId():06d}-{task.taskAttemptId()}-{len(parts):06d}.npy"
            with system.open_output_stream(f"{top}/{name}") as f:
                np.lib.format.write_array(f, np.concatenate(held), allow_pickle=False)
            parts.append(name)
            held, size = [], 0

        for batch in iterator:
            column = batch.column(batch.schema.get_field_index("vec"))
            if not len(column):
                continue
            flat, lengths = column.flatten(), column.value_lengths()
            if column.null_count or flat.null_count:
                raise ValueError("a matrix holds no null vectors or components")
            width = width or lengths[0].as_py()
            if len(flat) != width * len(column) or (lengths.to_numpy(zero_copy_only=False) != width).any():
                raise ValueError("vectors of a matrix have one length")
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(self.dtype)
            step = max(1, self.part_bytes // max(1, x.itemsize * width))
            for a in range(0, len(x), step):
                held.append(x[a : a + step])
                size += held[-1].nbytes
                if size >= self.part_bytes:
                    put()
        if held:
            put()
        return Written(task.partitionId(), parts, width)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = _system(self.path)
        done = sorted((m for m in messages if m and m.parts), key=lambda m: m.partition)
        if len({m.width for m in done}) > 1:
            self.abort(messages)
            raise ValueError("vectors of a matrix have one length")
        before = _manifest(system, top) if system.get_file_info(f"{top}/{MANIFEST}").type == fs.FileType.File else []
        fresh = f"{top}/_{self.run}.json"
        with system.open_output_stream(fresh) as f:
            f.write(json.dumps({"parts": [p for m in done for p in m.parts]}).encode())
        system.move(fresh, f"{top}/{MANIFEST}")
        for name in before:
            system.delete_file(f"{top}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, top = _system(self.path)
        for m in messages:
            for name in m.parts if m else ():
                system.delete_file(f"{top}/{name}")


class NpyRows(DataSource):
    """``row long, vec array<double>``; options ``path``, ``dtype``, ``part_bytes``, ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "row long, vec array<double>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("dtype", "<f4"), int(self.options.get("part_bytes", PART_BYTES)), overwrite)


def read_npy(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """row, vec (doubles) of a matrix."""
    spark.dataSource.register(NpyRows)
    return spark.read.format(FORMAT).option("range_bytes", range_bytes).load(path)


def write_npy(df: DataFrame, path: str, key: str = "sample_id", vector: str = "vec", dtype: str = "<f4", overwrite: bool = False, part_bytes: int = PART_BYTES) -> None:
    """Vectors in the order of ``key``; a row's place is its key's rank."""
    df.sparkSession.dataSource.register(NpyRows)
    ordered = df.select(key, F.col(vector).cast("array<double>").alias("vec")).repartitionByRange(key).sortWithinPartitions(key)
    ordered.select("vec").write.format(FORMAT).mode("overwrite" if overwrite else "append").option("dtype", dtype).option("part_bytes", part_bytes).save(path)
