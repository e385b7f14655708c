"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A piece (one match of the pre-splitting pattern) is encoded in halves, down to
single bytes; two encoded neighbours are joined by encoding a window of tokens
around the seam anew. The window grows until it agrees with the tokens outside. That
test is exact: under rank-ordered merges whose tokens are all reachable, a token
sequence is the encoding of its bytes if and only if each pair of neighbours is
the encoding of the pair's bytes. Pairs inside an encoded side or inside the
window hold already, so only the two seams of the window are looked at, and once
both hold, nothing outside can change. Joining is associative with the empty
sequence as unit. Pieces never merge with each other, so above them the tree
concatenates, and so does decoding. That every token is reachable is checked on the
driver; another vocabulary is refused.

Each task works on the rows it scans: no shuffle, no state but bounded caches, which
a worker keeps from task to task.

Defined results: a null text is encoded as the empty text (no ids); repeated rows
and null ids give a row each; an empty table gives no rows. Other columns are
ignored unless named in ``keep``; a kept column whose name the operator needs itself
is refused.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from clickloom.llm._shared import in_batches, refuse_clashes

#: Tokens, and matches of the pattern, that a leaf of the upper tree holds.
LEAF_TOKENS, LEAF_MATCHES = 1 << 12, 1 << 16
#: Cached pieces a codec keeps, and the longest that it caches (characters); cached parts of pieces and pairs of tokens.
CACHE_PIECES, CACHE_CHARS, CACHE_PARTS, CACHE_PAIRS = 200_000, 48, 100_000, 100_000
#: Bytes of a part of a piece that is cached.
PART_BYTES = 5
#: Bytes of a window from which its merges go through a heap, and of a part from which its equals in the piece are found.
HEAP_BYTES, TWIN_BYTES = 96, 64


def fold(parts: list, join):
    """Reduce a non-empty list level by level: neighbours are joined, then their joins."""
    while len(parts) > 1:
        odd = parts[-1:] if len(parts) % 2 else []
        parts = [join(a, b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + odd
    return parts[0]


def unreachable(ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens that the merges of their own bytes don't end in; an encoder by joins needs that there is none."""
    codec = TreeCodec(ranks, "")
    return [t for t, rank in ranks.items() if codec.merge(t, whole=False) != [rank]]


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class TreeCodec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts: dict[bytes, list[int]] = {}
        self.joins = 0
        self.cache = _Pieces(self)

    def merge(self, data: bytes, whole: bool = True) -> list[int]:
        """The plain algorithm on a window's bytes: join the neighbours of least rank, leftmost first.

        With ``whole`` bytes that are a token are that token, as they are if it is reachable.
        """
        ranks = self.ranks
        if whole and data in ranks:
            return [ranks[data]]
        if len(data) >= HEAP_BYTES:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.tokens) + 1
        costs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while costs:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for long windows: pairs wait in a heap by rank and place, parts are a linked list of their ends."""
        get, n = self.ranks.get, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the next part begins, and the one before
        held = [get(data[i : i + 2], -1) for i in range(n - 1)] + [-1]  # rank of a part and the next, -1: none
        heap = [(r, i) for i, r in enumerate(held) if r >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if held[i] != rank:
                continue
            gone = after[i]
            held[gone] = -1
            end = after[i] = after[gone]
            if end < n:
                before[end] = i
                held[i] = get(data[i : after[end]], -1)
                if held[i] >= 0:
                    heapq.heappush(heap, (held[i], i))
            else:
                held[i] = -1
            j = before[i]
            if j >= 0:
                held[j] = get(data[j:end], -1)
                if held[j] >= 0:
                    heapq.heappush(heap, (held[j], j))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbours stay as they are when their bytes are encoded together."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes from the encodings of each."""
        if not left or not right:
            return left or right
        self.joins += 1
        if self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            middle = self.merge(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))
            left_holds = i == len(left) or self.stable(left[-i - 1], middle[0])
            right_holds = j == len(right) or self.stable(middle[-1], right[j])
            if left_holds and right_holds:
                return left[: len(left) - i] + middle + right[j:]
            i, j = i if left_holds else i * 2, j if right_holds else j * 2

    def encode_piece(self, data: bytes, twins: dict[int, tuple[bytes, list[int]]] | None = None) -> list[int]:
        """The halves' encodings, joined; a byte is a token by itself.

        The left half of a long part is the largest power of two, so halves of a repeating
        piece are equal; the last part of each length is remembered (twice the piece's
        size), and its equals aren't encoded again.
        """
        n = len(data)
        if n <= PART_BYTES:
            known = self.parts.get(data)
            if known is not None:
                return known
        if n < 2:
            return [self.ranks[data]] if data else []
        if n >= TWIN_BYTES:
            twins = {} if twins is None else twins
            if n in twins and twins[n][0] == data:
                return twins[n][1]
        half = 1 << (n - 1).bit_length() - 1 if n >= TWIN_BYTES else n // 2
        known = self.join(self.encode_piece(data[:half], twins), self.encode_piece(data[half:], twins))
        if n <= PART_BYTES:
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            self.parts[data] = known
        elif n >= TWIN_BYTES:
            twins[n] = data, known
        return known

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if len(text) <= LEAF_MATCHES:
            return b"".join(map(self.cache.__getitem__, self.pattern.findall(text)))
        matches, leaves = self.pattern.finditer(text), [b""]
        while block := [m[0] for m in islice(matches, LEAF_MATCHES)]:
            leaves.append(b"".join(map(self.cache.__getitem__, block)))
        return fold(leaves, bytes.__add__)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian ids: leaves are looked up and joined up the tree."""
        numbers, get = np.frombuffer(ids, dtype="<u4").tolist(), self.tokens.__getitem__
        return fold([b"".join(map(get, numbers[k : k + LEAF_TOKENS])) for k in range(0, max(len(numbers), 1), LEAF_TOKENS)], bytes.__add__)


class _Pieces(dict):
    """Encoded pieces; it starts over when full, so its memory is bounded."""

    def __init__(self, codec: TreeCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.codec.encode_piece(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


_codecs: dict[tuple[int, str], TreeCodec] = {}


def _codec(raw: bytes, pattern: str) -> TreeCodec:
    """The worker's codec: one at a time, kept for the next task, with caches of bounded size."""
    key = hash(raw), pattern
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = TreeCodec(read_ranks(raw), pattern)
    return _codecs[key]


def _vocabulary(docs: DataFrame, ranks_path: str):
    """The rank file's bytes for all tasks; a vocabulary file is small whatever the corpus."""
    with open(ranks_path, "rb") as f:
        raw = f.read()
    if hash(raw) not in _sound:
        if bad := unreachable(read_ranks(raw)):
            raise ValueError(f"{len(bad)} tokens can't be reached by merges, the first is {bad[0]!r}")
        _sound.add(hash(raw))
    return docs.sparkSession.sparkContext.broadcast(raw)


_sound: set[int] = set()


def _encoding(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, keep: Sequence[str], decode_as: str | None) -> DataFrame:
    own = ["n_tokens", "ids", *([decode_as] if decode_as else [])]
    refuse_clashes(keep, [id_col, *own])
    raw = _vocabulary(docs, ranks_path)
    kept = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(text_col).alias("_text"))
    schema = T.StructType([*[f for f in kept.schema if f.name != "_text"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *([T.StructField("_decoded", T.BinaryType())] if decode_as else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value, pattern)
        for batch in batches:
            at = batch.num_columns - 1
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = [codec.encode(t) if t else b"" for t in part.column(at).to_pylist()]
                columns = [*part.columns[:at], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode_as:
                    columns.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.transform(in_batches, run, schema).toDF(id_col, *keep, *own)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Encode whole texts: id, ``keep``, ``n_tokens`` and ``ids`` (little-endian u32, binary)."""
    return _encoding(docs, ranks_path, pattern, id_col, text_col, keep, None)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), out_col: str = "decoded") -> DataFrame:
    """Encode whole texts and decode the ids again, in one pass: the columns of ``encode_documents`` and the bytes."""
    return _encoding(docs, ranks_path, pattern, id_col, text_col, keep, out_col)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that ``ids_col`` stands for; all columns stay. Null ids give no bytes."""
    refuse_clashes(encoded.columns, [out_col])
    raw = _vocabulary(encoded, ranks_path)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                out = pa.array([codec.decode(x or b"") for x in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=schema.names)

    return encoded.transform(in_batches, run, schema)
