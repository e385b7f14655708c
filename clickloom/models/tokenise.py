"""Subword ids and masks of fixed width for text encoders.

Words are cut greedily into the longest pieces that a vocabulary has, from their left
end, as encoders of the word-piece kind do: pieces that end a word carry the
vocabulary's mark of word ends where it has one. A word with a part that no piece covers
is one unknown token. The first ``width`` tokens of a text stay, the rest is filled
up with the padding id, and the mask tells them apart, so that pooling over masked
positions reads what it should.

The vocabulary is one broadcast file; a word that a task has seen isn't cut again,
within a cache of bounded size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Words whose pieces a task remembers, and characters of a word beyond which it isn't remembered.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
WORD = re.compile(r"\w+|[^\w\s]")


def read_vocabulary(path: str) -> dict[str, int]:
    """Pieces and ids of a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)["model"]["vocab"]


class Cutter:
    """Longest matches against one vocabulary."""

    def __init__(self, vocabulary: Mapping[str, int], unknown: int, ending: str = "</w>"):
        self.inside = {p: i for p, i in vocabulary.items() if not (ending and p.endswith(ending))}
        self.last = {p.removesuffix(ending): i for p, i in vocabulary.items() if not ending or p.endswith(ending)}
        self.longest = max(map(len, [*self.inside, *self.last]), default=1)
        self.unknown, self.cache = unknown, {}

    def word(self, word: str) -> list[int]:
        known = self.cache.get(word)
        if known is not None:
            return known
        out, at, n = [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                piece = word[at:end]
                found = self.last.get(piece) if end == n else self.inside.get(piece)
                if found is not None:
                    break
            else:
                out = [self.unknown]
                break
            out.append(found)
            at = end
        if n <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = out
        return out

    def text(self, text: str, width: int) -> tuple[list[int], int]:
        """The first ``width`` ids, and how many the whole text has."""
        ids, n = [], 0
        for m in WORD.finditer(text.lower()):
            pieces = self.word(m[0])
            n += len(pieces)
            if len(ids) < width:
                ids += pieces
        return ids[:width], n


def tokenise(df: DataFrame, vocabulary: Mapping[str, int], width: int = 256, padding: int = 0, unknown: int = 0, ending: str = "</w>", key: str = "sample_id", text: str = "text") -> DataFrame:
    """(key, ``ids``, ``mask``, ``n_tokens``): arrays of ``width``, and the whole text's count of tokens.

    A NULL text counts as an empty one: padding only, and no token.
    """
    sent = df.sparkSession.sparkContext.broadcast(dict(vocabulary))  # a vocabulary, whatever the corpus
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(sent.value, unknown, ending)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids, mask = np.full((part.num_rows, width), padding, dtype=np.int32), np.zeros((part.num_rows, width), dtype=np.int32)
                counts = []
                for row, t in enumerate(part.column(1).to_pylist()):
                    found, n = cutter.text(t or "", width)
                    ids[row, : len(found)], mask[row, : len(found)] = found, 1
                    counts.append(n)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(ids.ravel())), pa.ListArray.from_arrays(ends, pa.array(mask.ravel())), pa.array(counts, pa.int64())], names=schema.names)

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, schema)
