"""Epochs over a table in a new order each, without a sort.

The table is dealt once into chunks of equal rows by a seeded order, written by chunk. An
epoch's order of chunks is a keyed permutation of their numbers (a Feistel network that
walks until it is in range), so the chunks of any batch are computed, not looked up,
and read by partition pruning; within a chunk rows are put in the epoch's order where
they lie. No epoch and no batch shuffles anything, and the order is the same on every
cluster. Rows of one chunk stay together; the first deal mixes them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickloom.operators.position import with_position

#: Rounds of the network; four are enough for a permutation that looks random.
ROUNDS = 4
#: Hex digits of the seeded key that name a cell of the first deal.
CELL_DIGITS = 3


def permuted(x: int, n: int, key: str) -> int:
    """The image of ``x`` under a permutation of range(n) that depends on the key alone."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            f = int(hashlib.md5(f"{key}|{r}|{right}".encode()).hexdigest()[:8], 16)
            left, right = right, left ^ (f & mask)
        x = left << half | right
        if x < n:
            return x


def _order(keys: Sequence[str], label: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(label), *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys]).cast("binary"))


def write_chunks(df: DataFrame, keys: Sequence[str], path: str, chunk_rows: int = 1 << 16, seed: int = 42) -> int:
    """Deal the rows into chunks of ``chunk_rows`` (the last may be smaller), by a seeded order of their keys; returns the chunks' number.

    Rows of equal keys are interchangeable. An empty table has no chunks.
    """
    dealt = with_position(df.withColumn("_order", _order(keys, str(seed))), F.substring("_order", 1, CELL_DIGITS), [F.col("_order"), *[F.col(k) for k in keys]], out="_place")
    dealt = dealt.withColumn("chunk", F.floor((F.col("_place") - 1) / chunk_rows).cast("int")).drop("_order", "_place")
    # chunks are dealt to tasks by range, so a task writes whole chunks, one file each
    dealt.repartitionByRange("chunk").sortWithinPartitions("chunk").write.partitionBy("chunk").mode("overwrite").parquet(path)
    return -(-df.count() // chunk_rows)


def chunks_of(epoch: int, first: int, last: int, n_chunks: int, seed: int = 42) -> list[int]:
    """The chunks at the places ``first`` to ``last`` (exclusive) of an epoch."""
    return [permuted(k, n_chunks, f"{seed}|{epoch}") for k in range(first, min(last, n_chunks))]


def epoch_plan(spark: SparkSession, epoch: int, n_chunks: int, chunks_a_batch: int = 1, seed: int = 42) -> DataFrame:
    """(chunk, place, batch) of a whole epoch, a row a chunk."""
    rows = [(c, k, k // chunks_a_batch) for k, c in enumerate(chunks_of(epoch, 0, n_chunks, n_chunks, seed))]
    return spark.createDataFrame(rows, "chunk int, place int, batch int")


def batch(spark: SparkSession, path: str, keys: Sequence[str], epoch: int, number: int, n_chunks: int, chunks_a_batch: int = 1, seed: int = 42) -> DataFrame:
    """The rows of one batch of an epoch, with ``chunk``: its chunks are read and no others, rows in the epoch's order in each."""
    chosen = chunks_of(epoch, number * chunks_a_batch, (number + 1) * chunks_a_batch, n_chunks, seed)
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("chunk").isin(*chosen)) if chosen else rows.limit(0)
    return rows.withColumn("_order", _order(keys, f"{seed}|{epoch}")).sortWithinPartitions("chunk", "_order", *keys).drop("_order")
