"""Language-model scores from a subword lattice.

The vocabulary is an existing one and stays as it is; its ranks give the prior
piece scores, ``p(r)`` in proportion to ``1 / (r + 1)``. One expectation step over the
training words, whatever segmentation they may have, turns those into piece
probabilities of the corpus. A word with the space before it is a lattice of all
its segmentations; the forward recursion in log space sums over them, and since no
piece reaches over a space, a text's probability is the product of its words'
marginals and the end's. The end is a piece with a share of its own, so all texts'
probabilities add up to one over piece sequences. All words of a length go through
the recursion together.

Counts are exact and distributed. Each scan task encodes its documents as word
numbers of a block and writes the block with its word list once. Word lists are
summed by word in place, weighed, and brought back to their blocks, so what moves
is one row for each word of a block, never the tokens, and no table of words is
ever collected or broadcast. A word that every text holds has one row a block; words of
very many blocks are counted by partial sums, so no task gets all their rows.

Defined results: null and empty texts are the end alone; rows with null ids count
as the empty text in the fold; repeated rows train and are scored each; without
training rows all counts are 0 and the prior scores the texts; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.llm._shared import id_crc, in_batches, materialize
from clickloom.llm._text import LOWER, buffers, mix, power_table

#: Bytes of text in a block of documents, about.
BLOCK_BYTES = 16 << 20
#: Longest word (bytes with its space) that goes through the joint recursion; longer ones go alone.
JOINT_BYTES = 48
#: Words that stand in so many of the sampled blocks (one of so many) are counted apart, at most so many words. Counts are the same either way.
COMMON_IN_SAMPLE, SAMPLED_BLOCKS, COMMON_WORDS = 200, 16, 100_000
#: Smoothing of piece probabilities, in expected occurrences.
SMOOTHING = 0.1
_LOW = bytes(LOWER)


_VALUE = np.dtype([("at", "<i4"), ("c", "<i8"), ("lattice", "<f8")])


class Lattice:
    """Pieces of a byte vocabulary with log probabilities, and sums over segmentations."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.pieces = pieces
        self.log_p = np.asarray(log_p, dtype=np.float64)
        lengths = np.array([len(p) for p in pieces])
        self.longest = int(lengths.max())
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(lengths):
            which = np.flatnonzero(lengths == n)
            block = np.frombuffer(b"".join(pieces[k] for k in which), dtype=np.uint8).reshape(len(which), int(n))
            keys = self._prefix_sums(block)[:, -1]
            order = np.argsort(keys)
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.by_length[int(n)] = keys[order], which[order], maybe

    @staticmethod
    def _prefix_sums(words: np.ndarray) -> np.ndarray:
        """Polynomial sums of each row's prefixes; a difference, shifted to the front, is a substring's key."""
        up, _ = power_table(words.shape[1] + 1)
        out = np.zeros((words.shape[0], words.shape[1] + 1), dtype=np.uint64)
        np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * up[: words.shape[1]], axis=1, out=out[:, 1:])
        return out

    def edges(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all pieces in words of one length, a row of bytes each."""
        n = words.shape[1]
        sums, (_, down) = np.ascontiguousarray(self._prefix_sums(words).T), power_table(n + 1)
        out = []
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                known = self.by_length.get(end - start)
                if known is None:
                    continue
                keys = (sums[end] - sums[start]) * down[start]
                rows = np.flatnonzero(known[2][(keys >> np.uint64(48)).astype(np.int64)])
                if not len(rows):
                    continue
                keys = keys[rows]
                at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
                hit = known[0][at] == keys
                if hit.any():
                    out.append((start, end, rows[hit], known[1][at[hit]]))
        return out

    def forward(self, n_rows: int, n: int, edges) -> np.ndarray:
        """Log sums over the segmentations of each prefix: rows by prefix length."""
        alpha = np.full((n + 1, n_rows), -np.inf)
        alpha[0] = 0
        for start, end, rows, pieces in edges:  # by rising end
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.log_p[pieces])
        return alpha

    def backward(self, n_rows: int, n: int, edges) -> np.ndarray:
        beta = np.full((n + 1, n_rows), -np.inf)
        beta[n] = 0
        for start, end, rows, pieces in sorted(edges, key=lambda e: -e[0]):
            beta[start, rows] = np.logaddexp(beta[start, rows], beta[end, rows] + self.log_p[pieces])
        return beta

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(w) for w in words])
        for n in np.unique(sizes):
            which = np.flatnonzero(sizes == n)
            step = max(1, min(20_000, (1 << 22) // int(n)))
            for k in range(0, len(which), step):
                part = which[k : k + step]
                yield part, np.frombuffer(b"".join(words[i] for i in part), dtype=np.uint8).reshape(len(part), int(n))

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for part, block in self._groups([w[:JOINT_BYTES] if len(w) > JOINT_BYTES else w for w in words]):
            n = block.shape[1]
            out[part] = self.forward(len(part), n, self.edges(block))[n]
        for i in (i for i, w in enumerate(words) if len(w) > JOINT_BYTES):
            out[i] = self._long(words[i])
        return out

    def _long(self, word: bytes) -> float:
        """One long word, end by end; memory grows with the word."""
        table = self.table
        alpha = np.full(len(word) + 1, -np.inf)
        alpha[0] = 0
        for end in range(1, len(word) + 1):
            terms = [alpha[s] + self.log_p[k] for s in range(max(0, end - self.longest), end) if (k := table.get(word[s:end])) is not None]
            alpha[end] = np.logaddexp.reduce(terms) if terms else -np.inf
        return float(alpha[-1])

    @property
    def table(self) -> dict[bytes, int]:
        if "_table" not in self.__dict__:
            self._table = {p: k for k, p in enumerate(self.pieces)}
        return self._table

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected occurrences of each piece, over all segmentations of the counted words."""
        total = np.zeros(len(self.pieces))
        short = [i for i, w in enumerate(words) if len(w) <= JOINT_BYTES]
        counts = np.asarray(counts, dtype=np.float64)
        chosen, weight = [words[i] for i in short], counts[short]
        for part, block in self._groups(chosen):
            rows, n = block.shape
            edges = self.edges(block)
            alpha, beta = self.forward(rows, n, edges), self.backward(rows, n, edges)
            for start, end, at, pieces in edges:
                share = np.exp(alpha[start, at] + self.log_p[pieces] + beta[end, at] - alpha[n, at])
                total += np.bincount(pieces, weights=share * weight[part][at], minlength=len(total))
        for i in (i for i, w in enumerate(words) if len(w) > JOINT_BYTES):
            self._add_long(words[i], counts[i], total)
        return total

    def _add_long(self, word: bytes, count: float, total: np.ndarray) -> None:
        """Add one long word's expected pieces, forward and backward over all of it; memory grows with the word."""
        n, known = len(word), self.table
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0
        ending = []
        for end in range(1, n + 1):
            found = [(s, k) for s in range(max(0, end - self.longest), end) if (k := known.get(word[s:end])) is not None]
            starts, pieces = np.array(found, dtype=np.int64).reshape(-1, 2).T
            ending.append((starts, pieces))
            alpha[end] = np.logaddexp.reduce(alpha[starts] + self.log_p[pieces], initial=-np.inf)
        for end in range(n, 0, -1):  # beta[end] is whole: all pieces that start there end later
            starts, pieces = ending[end - 1]
            through = self.log_p[pieces] + beta[end]
            np.add.at(total, pieces, count * np.exp(alpha[starts] + through - alpha[n]))
            beta[starts] = np.logaddexp(beta[starts], through)


def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a rank file and their prior log probabilities."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    prior = -np.log(np.arange(len(ranked)) + 1.0)
    return [p for _, p in ranked], prior - np.logaddexp.reduce(prior)


@dataclass(frozen=True)
class Counts:
    """The table of words by block (written) and its totals."""

    places: DataFrame
    tokens: int
    distinct: int
    ends: int


def held_out(id_col: str) -> Column:
    """The rows that no model learns from: crc32 of the id as text is 2 modulo 7."""
    return (id_crc(id_col) % 7) == 2


def encode_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Write documents in blocks: ids, fold, offsets and word numbers of the block's own word list."""
    base = docs.select(F.col(id_col).cast("long").alias("_id"), held_out(id_col).alias("_out"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        ids, outs, lengths, numbers, words, train = [], [], [], [], {}, []

        def close():
            nonlocal serial, ids, outs, lengths, numbers, words, train
            serial += 1
            every = np.concatenate([np.zeros(0, np.int32), *numbers])
            trained = np.concatenate([np.zeros(0, bool), *train])
            count = np.bincount(every[trained], minlength=len(words))
            batch = pa.RecordBatch.from_arrays(
                [pa.array([(task << 24) + serial], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([outs], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int64())), pa.array([every.astype("<i4").tobytes()], pa.binary()), pa.array([list(words)], pa.list_(pa.binary())), pa.array([count], pa.list_(pa.int64()))],
                names=["block", "ids", "outs", "lengths", "numbers", "words", "train"],
            )
            ids, outs, lengths, numbers, words, train = [], [], [], [], {}, []
            return batch

        size = 0
        for b in batches:
            data, at = buffers(b.column(2))
            for doc_id, out, start, end in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                parts = data[start:end].tobytes().translate(_LOW).split()
                for w in parts:
                    if w not in words:
                        words[w] = len(words)
                found = np.fromiter(map(words.__getitem__, parts), dtype=np.int32, count=len(parts))
                ids.append(doc_id)
                outs.append(out)
                lengths.append(len(parts))
                numbers.append(found)
                train.append(np.full(len(parts), not out))
                size += end - start
                if size >= BLOCK_BYTES:
                    yield close()
                    size = 0
        if ids:
            yield close()

    return materialize(base.transform(in_batches, run, "block long, ids array<long>, outs array<boolean>, lengths array<long>, numbers binary, words array<binary>, train array<long>"), "blocks")


def place_words(blocks: DataFrame) -> Counts:
    """Write a row for each word of each block: its place there and its training count in all blocks.

    Rows of one word lie together; its ``first`` row stands for it. Held-out words
    have count 0, and each training text's end counts as a token.
    """
    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("at", "w")).select(F.col("w.words").alias("word"), "block", "at", F.col("w.train").alias("t"))
    order = Window.partitionBy("word").orderBy("block")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def counted(rows: DataFrame) -> DataFrame:
        return rows.select("word", "block", "at", F.sum("t").over(whole).alias("c"), (F.row_number().over(order) == 1).alias("first"))

    # a few words stand in nearly all blocks: they are counted by partial sums, and the counts are broadcast
    some = each.where(F.pmod(F.xxhash64("block"), F.lit(SAMPLED_BLOCKS)) == 0)
    common = materialize(some.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_IN_SAMPLE).orderBy(F.desc("n"), "word").limit(COMMON_WORDS).select("word"), "common")
    if common.limit(1).count():
        sums = each.join(F.broadcast(common), "word").groupBy("word").agg(F.sum("t").alias("c"), F.min("block").alias("_least"))
        sums = materialize(sums, "sums")
        known = each.join(F.broadcast(sums), "word").select("word", "block", "at", "c", (F.col("block") == F.col("_least")).alias("first"))  # COMMON_WORDS rows at most
        places = materialize(counted(each.join(F.broadcast(common), "word", "left_anti")).unionByName(known), "places")
    else:
        places = materialize(counted(each), "places")
    ends = blocks.agg(F.sum(F.size(F.filter("outs", lambda o: ~o)))).first()[0] or 0
    total = places.where("first").agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    return Counts(places, int(total["n"] or 0) + int(ends), int(total["v"]) + (1 if ends else 0), int(ends))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Batches of about so many rows: the recursion takes the same steps for many words as for few."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def fit_pieces(places: DataFrame, ends: int, pieces: list[bytes], prior: np.ndarray) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of a text's end after one expectation step over the training words."""
    sent = places.sparkSession.sparkContext.broadcast(Lattice(pieces, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in _gathered(batches):
            got = sent.value.expected([b" " + w for w in b.column(0).to_pylist()], b.column(1).to_numpy(zero_copy_only=False))
            total = got if total is None else total + got
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "e"])

    found = places.where("first and c > 0").select("word", "c").transform(in_batches, run, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).toPandas()  # a row a piece at most
    total = np.exp(prior) * SMOOTHING * len(pieces)
    np.add.at(total, found["piece"].to_numpy(int), found["e"].to_numpy(float))
    end = ends + SMOOTHING
    return np.log(total) - np.log(total.sum() + end), float(np.log(end) - np.log(total.sum() + end))


def score_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    blocks = encode_blocks(docs, id_col, text_col)
    counts = place_words(blocks)
    pieces, prior = read_vocabulary(vocabulary_path)
    log_p, log_end = fit_pieces(counts.places, counts.ends, pieces, prior)
    sent = spark.sparkContext.broadcast(Lattice(pieces, log_p))
    n, v, end_count, log_end = counts.tokens, counts.distinct, counts.ends, log_end / np.log(10)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            words = b.column(0).dictionary_encode()  # rows of one word lie together
            marginal = sent.value.log_probability([b" " + w for w in words.dictionary.to_pylist()]) / np.log(10)
            values = np.zeros(b.num_rows, dtype=_VALUE)
            values["at"], values["c"] = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            values["lattice"] = marginal[words.indices.to_numpy(zero_copy_only=False)]
            block = b.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) != 0, [True])))
            parts = [values[order[i:j]].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block[order[edges[:-1]]]), pa.array(parts, pa.binary())], names=["block", "data"])

    # a block's values, packed, then the block itself: a task reads them as a stream
    packed = counts.places.select("word", "block", F.col("at").cast("long").alias("at"), "c").transform(in_batches, weigh, "block long, data binary")
    payload = ("ids", "outs", "lengths", "numbers")
    last = blocks.select("block", F.lit(None).cast("binary").alias("data"), *payload)
    for name in payload:
        packed = packed.withColumn(name, F.lit(None).cast(blocks.schema[name].dataType))
    stream = packed.unionByName(last).repartition("block").sortWithinPartitions("block", F.col("data").isNull())
    base_of = np.log10(n + v + 1.0)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for k in range(b.num_rows):
                if b.column(1)[k].is_valid:
                    held.append(b.column(1)[k].as_py())
                    continue
                values, held = np.frombuffer(b"".join(held), dtype=_VALUE), []
                c_of, weight_of = np.zeros(len(values), np.int64), np.zeros(len(values))
                c_of[values["at"]], weight_of[values["at"]] = values["c"], values["lattice"]
                ids, outs, lengths, numbers = (b.column(j)[k] for j in range(2, 6))
                lengths = np.asarray(lengths.values)
                which = np.frombuffer(numbers.as_buffer(), dtype="<i4")
                doc = np.repeat(np.arange(len(lengths)), lengths)
                known = np.bincount(doc, weights=(c_of > 0)[which], minlength=len(lengths)).astype(np.int64)
                base = np.bincount(doc, weights=np.log10(c_of + 1.0)[which], minlength=len(lengths))
                marginal = np.bincount(doc, weights=weight_of[which], minlength=len(lengths))
                tokens = lengths + 1
                yield pa.RecordBatch.from_arrays(
                    [ids.values, outs.values, pa.array(tokens), pa.array(known + int(end_count > 0)), pa.array(np.full(len(lengths), n)), pa.array(base + np.log10(end_count + 1.0) - tokens * base_of), pa.array(marginal + log_end)],
                    names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return stream.transform(in_batches, add_up, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
