"""Quality scores by Bradley-Terry pairwise ranking.

A document is described by its text alone: rates (characters, words, lines,
repetition), each cut at the training sample's quantiles, so the linear score can
bend, and the shares of its words in hashed buckets. Every accepted document of the
sample is preferred over every rejected one; the weights minimise the logistic loss
of all those pairs' feature differences. What the pairs of a document pull on its
score is read off a grid of scores on which its opponents are counted, so all pairs
take part at the price of a convolution. The decision threshold is the score
quantile at the share of rejected rows in the training sample; scores are logistic
around it, so 0.5 is the threshold.

Training takes the labelled rows of least hash, at most ``max_train`` of them (a
fixed bound, so what reaches the driver doesn't grow), and scoring is one pass
over all whole texts without a shuffle.

Defined results: null and empty texts have all rates 0 and get a score like any
other; rows without a usable label (null, not 0 or 1, contradicting) don't train;
without rows of both labels every score is 0.5 and nothing is rejected; a null id
counts as the empty text in the fold; repeated rows are scored alike; an empty
table gives no rows; other columns are kept or ignored as the caller says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clickloom.llm._shared import id_crc, in_batches, refuse_clashes
from clickloom.llm._text import SPACE_WORDS, buffers, hash_spans, mix, slices, word_table, words_of

FEATURES = (
    "log_bytes", "upper", "digit", "space", "newline", "stop", "comma", "quote", "shout", "symbol", "bracket", "markup", "control", "beyond_ascii", "entropy",
    "log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "distinct_pairs", "same_as_before", "symbol_ends", "stop_ends", "capital_starts",
    "words_a_line", "distinct_lines", "sentence_words",
)
#: Quantile bins of a feature.
BINS = 24
#: Buckets of words.
LEXICAL = 512
#: Labelled rows that training takes at most; all their pairs count.
MAX_TRAIN = 20_000
#: Cells of the grid on which the pairs' pulls are added up.
GRID = 4096
#: Documents in a slice of work at most.
SLICE_DOCS = 2048

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t", "newline": b"\n\r\x0b\x0c", "stop": b".?", "comma": b",;:", "quote": b"\"'`",
    "shout": b"!", "symbol": b"#$%&*+=@^~", "bracket": b"()[]{}<>", "markup": b"|\\/_-", "control": bytes([*range(9), *range(14, 32), 127]), "beyond_ascii": bytes(range(0xC0, 256)),
}
_ONE_OF = np.zeros((256, len(_CLASSES)), dtype=np.float64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _ONE_OF[list(_bytes), _k] = 1
_LINES = word_table(b"\n\r")
_SYMBOL_END, _STOP_END = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL_END[list(b"#$%&*+=@^~!|")] = True
_STOP_END[list(b".?")] = True


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: number of distinct keys and the count of the most frequent one."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(keys):
        both = mix(keys ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(both)
        both, doc = both[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        count = np.diff(np.append(first, len(both)))
        distinct = np.bincount(doc[first], minlength=n).astype(float)
        np.maximum.at(top, doc[first], count)
    return distinct, top


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rates, then word shares (square roots, by bucket) of the documents ``data[at[k]:at[k + 1]]``, a row each."""
    n, size = len(at) - 1, np.diff(at).astype(float)
    raw = data[int(at[0]) : int(at[-1])]
    doc_of = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(doc_of * 256 + raw, minlength=n * 256).reshape(n, 256).astype(float)
    share = counts / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    kinds = dict(zip(_CLASSES, (counts @ _ONE_OF).T, strict=True))
    letters = np.maximum(kinds["upper"] + kinds["lower"], 1)

    low, starts, ends, first = words_of(data, at, SPACE_WORDS)
    words = np.diff(first).astype(float)
    per_word = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), np.diff(first))
    hashes, length = hash_spans(low, starts, ends), ends - starts

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=n) / per_word if len(doc) else np.zeros(n)

    distinct, top = _distinct(hashes, doc, n)
    inside = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    pairs = (hashes[:-1] * np.uint64(3) + hashes[1:])[inside] if len(doc) else np.zeros(0, np.uint64)
    pair_doc = doc[1:][inside] if len(doc) else doc
    distinct_pairs, _ = _distinct(pairs, pair_doc, n)
    n_pairs = np.maximum(words - 1, 1)
    repeats = np.bincount(pair_doc, weights=(hashes[1:] == hashes[:-1])[inside], minlength=n) if len(pair_doc) else np.zeros(n)
    last = low[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    start = raw[starts] if len(starts) else np.zeros(0, np.uint8)
    stops = mean(_STOP_END[last].astype(float)) * words

    line_low, line_starts, line_ends, line_first = words_of(data, at, _LINES)
    lines = np.diff(line_first).astype(float)
    line_distinct, _ = _distinct(hash_spans(line_low, line_starts, line_ends), np.repeat(np.arange(n), np.diff(line_first)), n)
    rate = {k: kinds[k] / np.maximum(size, 1) for k in ("digit", "space", "newline", "stop", "comma", "quote", "shout", "symbol", "bracket", "markup", "control", "beyond_ascii")}
    columns = {
        "log_bytes": np.log1p(size), "upper": kinds["upper"] / letters, **rate, "entropy": entropy, "log_words": np.log1p(words), "word_length": mean(length.astype(float)), "long_words": mean((length > 16).astype(float)), "short_words": mean((length <= 3).astype(float)),
        "distinct_words": distinct / per_word, "top_word": top / per_word, "distinct_pairs": distinct_pairs / n_pairs, "same_as_before": repeats / n_pairs, "symbol_ends": mean(_SYMBOL_END[last].astype(float)), "stop_ends": stops / per_word, "capital_starts": mean(((start >= 65) & (start <= 90)).astype(float)),
        "words_a_line": words / np.maximum(lines, 1), "distinct_lines": line_distinct / np.maximum(lines, 1), "sentence_words": words / np.maximum(stops, 1),
    }
    buckets = np.bincount(doc * LEXICAL + (hashes >> np.uint64(40)).astype(np.int64) % LEXICAL, minlength=n * LEXICAL).reshape(n, LEXICAL)
    return np.column_stack([*(columns[f] for f in FEATURES), np.sqrt(buckets / per_word[:, None])]).astype(np.float32).astype(float)  # as the sample travels


def _each_slice(column: pa.Array, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``of`` makes of the features, a row each, slice by slice."""
    data, at = buffers(column)
    parts = [of(np.zeros((0, len(FEATURES) + LEXICAL)))]
    for i, j in slices(at):
        for k in range(i, j, SLICE_DOCS):
            parts.append(of(features(data, at[k : min(k + SLICE_DOCS, j) + 1])))
    return np.concatenate(parts)


@dataclass(frozen=True)
class PairwiseModel:
    """Bin edges and weights of each rate, weights of the word buckets, and the threshold."""

    edges: np.ndarray
    weights: np.ndarray
    lexical: np.ndarray
    threshold: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edges, x[:, k], side="right") for k, edges in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(len(self.edges)), self.bins(x)].sum(axis=1) + x[:, len(self.edges) :] @ self.lexical if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -60, 60)))


def pair_pulls(good: np.ndarray, bad: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """For each score what the loss of its pairs still pulls, as a mean over all pairs of a good and a bad score.

    A good score g is pulled up by the sum of 1 / (1 + exp(g - b)) over the bad ones, a
    bad score down likewise. Opponents are counted on a grid, each shared by the two
    cells beside it, and the sums are read between cells; the error falls with the
    square of the cells' width.
    """
    low = min(good.min(), bad.min())
    width = max(max(good.max(), bad.max()) - low, 1e-9) / (grid - 1)

    def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(((x - low) / width).astype(np.int64), grid - 2)
        return at, (x - low) / width - at

    def count(at: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=1 - part, minlength=grid) + np.bincount(at + 1, weights=part, minlength=grid)

    away = np.arange(-(grid - 1), grid) * width
    kernel = np.fft.rfft(1 / (1 + np.exp(np.clip(away, -60, 60))), 4 * grid)  # what a good score pulls from a bad one so far below it
    (g, g_part), (b, b_part) = place(good), place(bad)

    def read(counts: np.ndarray, factor: np.ndarray, at: np.ndarray, part: np.ndarray) -> np.ndarray:
        sums = np.fft.irfft(np.fft.rfft(counts, 4 * grid) * factor, 4 * grid)[grid - 1 : 2 * grid - 1]
        return (sums[at] * (1 - part) + sums[at + 1] * part) / (len(good) * len(bad))

    mirrored = np.fft.rfft(1 / (1 + np.exp(np.clip(-away, -60, 60))), 4 * grid)
    return read(count(b, b_part), kernel, g, g_part), read(count(g, g_part), mirrored, b, b_part)


def fit(x: np.ndarray, accepted: np.ndarray, steps: int = 400, penalty: float = 1e-4, lexical_penalty: float = 1e-3, pulls=pair_pulls) -> PairwiseModel:
    """Learn from rows of features and labels, by the pairs of all accepted with all rejected rows."""
    n_features = len(FEATURES)
    good, bad = np.flatnonzero(accepted), np.flatnonzero(~accepted)
    if not len(good) or not len(bad):
        return PairwiseModel(np.zeros((n_features, 0)), np.zeros((n_features, 1)), np.zeros(LEXICAL), 0.0)
    edges = np.quantile(x[:, :n_features].astype(float), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    n_cells = n_features * BINS
    cells = PairwiseModel(edges, np.zeros((n_features, BINS)), np.zeros(LEXICAL), 0.0).bins(x) + np.arange(n_features) * BINS
    words = np.ascontiguousarray(x[:, n_features:], dtype=np.float32)
    decay = np.concatenate([np.full(n_cells, penalty), np.full(LEXICAL, lexical_penalty)])
    w, m, v = np.zeros((3, n_cells + LEXICAL))
    per_row = np.zeros(len(x))
    for step in range(1, steps + 1):
        s = w[cells].sum(axis=1) + words @ w[n_cells:].astype(np.float32)
        up, down = pulls(s[good], s[bad])
        per_row[good], per_row[bad] = up, -down
        gradient = decay * w - np.concatenate([np.bincount(cells.ravel(), weights=np.repeat(per_row, n_features), minlength=n_cells), per_row.astype(np.float32) @ words])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = PairwiseModel(edges, w[:n_cells].reshape(n_features, BINS), w[n_cells:], 0.0)
    s = np.sort(model.raw(x))
    k = len(bad)  # the quantile of the rejected share: halfway between the rows at either side
    return replace(model, threshold=float((s[k - 1] + s[k]) / 2))


def held_out(id_col: str) -> Column:
    """The rows that no model learns from: crc32 of the id as text is 1 modulo 3."""
    return (id_crc(id_col) % 3) == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> PairwiseModel:
    """Fit on at most ``max_train`` labelled rows outside the held-out fold."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
    usable = usable.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").select("_id", "_y")
    sample = usable.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")  # max_train rows at most
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_y", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _each_slice(b.column(2), lambda x: x.astype("<f4"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["_id", "_y", "x"])

    found = rows.select("_id", F.col("_y").cast("int").alias("_y"), "_text").transform(in_batches, run, schema)
    got = found.groupBy("_id").agg(F.first("_y").alias("y"), F.min("x").alias("x")).orderBy("_id").select("y", "x").toArrow()  # max_train rows at most
    rows = got.column("x").combine_chunks()
    x = np.concatenate([np.zeros((0, len(FEATURES) + LEXICAL), "<f4"), *(np.frombuffer(c, "<f4").reshape(-1, len(FEATURES) + LEXICAL) for c in _values(rows))])
    return fit(x, got.column("y").to_numpy() == 1)


def _values(column: pa.Array) -> list[memoryview]:
    """The bytes of a binary column without nulls, as they lie."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for c in chunks:
        raw, at = buffers(c)
        out.append(memoryview(raw[at[0] : at[-1]]) if len(c) else memoryview(b""))
    return out


def score_documents(docs: DataFrame, model: PairwiseModel, text_col: str = "text", keep: Sequence[str] = ("doc_id",), score_col: str = "score") -> DataFrame:
    """``keep`` and the score of every whole text; a kept column can't be called as the score."""
    refuse_clashes(keep, [score_col])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_scored_text"))
    schema = T.StructType([*docs.select(*[F.col(c) for c in keep]).schema.fields, T.StructField(score_col, T.DoubleType())])
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(_each_slice(b.column(at), sent.value.score))], names=schema.names)

    return base.transform(in_batches, run, schema)


def keep_accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that the model accepts (score of 0.5 or more); columns are unchanged."""
    model = train(docs, labels, text_col=text_col, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_each_slice(b.column(at), sent.value.score) >= 0.5))

    return docs.transform(in_batches, run, docs.schema)
