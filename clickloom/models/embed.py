"""Embedding providers: texts to vectors in Arrow batches, order kept by sample id.

A provider is any callable from texts to a float matrix. ``hashed_provider`` is the
offline stand-in for pretrained encoders: hashed word features under a fixed
random projection, of unit length, the same on every machine.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

Provider = Callable[[Sequence[str]], np.ndarray]
# Widths of the known text encoders.
ENCODER_WIDTHS = (768, 1024, 768, 2560, 2048, 3072)


def tokens(text: str, limit: int | None = None) -> list[str]:
    """Words and marks, cut at ``limit`` if there is one."""
    return re.findall(r"\w+|[^\w\s]", text.lower())[:limit]


def hashed_provider(width: int = 64, buckets: int = 4096, limit: int | None = None, seed: int = 42) -> Callable[[], Provider]:
    def make() -> Provider:
        projection = np.random.default_rng(seed).normal(size=(buckets, width)) / np.sqrt(width)

        def embed(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for k, t in enumerate(texts):
                places = [zlib.crc32(w.encode()) % buckets for w in tokens(t or "", limit)]
                if places:
                    out[k] = projection[places].mean(axis=0)
            return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-8)

        return embed

    return make


def embed_texts(df: DataFrame, make_provider: Callable[[], Provider], key: str = "sample_id", text: str = "text", batch: int = 16, model: str = "hashed") -> DataFrame:
    """(key, model, vec) of every text; one provider a partition, ``batch`` texts a call."""
    schema = T.StructType([df.schema[key], T.StructField("model", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make_provider()
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                vectors = provider(part.column(1).to_pylist()).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model] * part.num_rows), pa.array(list(vectors), pa.list_(pa.float32()))], names=schema.names)

    return df.select(key, F.col(text)).mapInArrow(run, schema)


def sweep(df: DataFrame, providers: dict[str, Callable[[], Provider]], key: str = "sample_id", text: str = "text") -> DataFrame:
    """The vectors of several models, one below the other."""
    out = None
    for name, make in providers.items():
        part = embed_texts(df, make, key, text, model=name)
        out = part if out is None else out.unionByName(part)
    return out


def project(df: DataFrame, width: int, new_width: int = 32, vector: str = "vec", seed: int = 42) -> DataFrame:
    """Vectors under a fixed random projection, of unit length."""
    matrix = np.random.default_rng(seed).normal(size=(width, new_width)) / np.sqrt(width)
    at = df.columns.index(vector)
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.FloatType())) if f.name == vector else f for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, width) @ matrix
            x = (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())) if k == at else c for k, c in enumerate(b.columns)], names=schema.names)

    return df.mapInArrow(run, schema)
