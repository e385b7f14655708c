"""Nearest neighbours by a block matrix join on int8 product tiles.

Unit vectors are quantised to int8 with a scale of their own. The product of a
tile of queries and a tile of candidates, exact in whole numbers, gives each
cosine up to an error bounded by the norms of what quantisation left over (by
Cauchy-Schwarz, ``e_q (1 + e_c) + e_c``). A pair survives if its upper bound
reaches the k-th best known lower bound of its query; survivors are recomputed in
double precision from the original vectors and kept in a heap of k for each
query. The result is exact, so recall is 1.

Queries and candidates are packed into tiles, a row each, and tiles meet by a join.
All queries are broadcast if they fit one block of a fixed size in bytes, and
candidates stay where they are. Else vectors are quantised once, and only codes,
scales and errors travel to every (block, salt): a task keeps the pairs whose upper
bound reaches the k-th lower bound of their query, a window over all tasks lowers them
to those that reach the k-th of all, and the doubles of these alone are fetched. Where
more than `CLOSE_PAIRS` candidates of a query can't be told apart by their bounds
(a third of all rows may be one vector), the tile's doubles go to the query's block
and are searched there, once. Nothing is collected, and no task sees all pairs as rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with null ids take no part; only vectors of a query's
length are its candidates; rows with the query's own id aren't candidates; other
repeated rows are candidates each; of repeated query ids the least vector asks;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.llm._shared import in_batches, materialize, refuse_clashes, sized

#: Bytes of query vectors (as doubles) in a block.
BLOCK_BYTES = 16 << 20
#: Rows of a tile on either side, and candidate tiles that meet a block of queries in one piece of work, about.
TILE, TILES_A_SALT = 2048, 32
#: Rows of keys (three numbers each) that are broadcast at most.
BROADCAST_ROWS = 1 << 20
#: Candidates of a query in a task whose bounds reach its k-th, beyond which their tiles are searched by doubles.
CLOSE_PAIRS = 64
#: Blocks of queries whose heaps a task holds.
HELD_BLOCKS = 4


def _vectors(column: pa.Array, ids: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as doubles) of the usable rows, by vector length."""
    lengths = np.array([len(v) if v is not None else 0 for v in column.to_pylist()]) if column.null_count else column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        rows = pa.array(np.flatnonzero(lengths == d))
        flat = column.take(rows).flatten()
        x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, int(d))
        chosen = ids.take(rows)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1) & ~np.asarray(chosen.is_null())
        if good.any():
            yield chosen.filter(pa.array(good)).to_numpy(zero_copy_only=False).astype(np.int64), x[good]


def ordered_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of row pairs, added up in the components' order."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


class Side:
    """Vectors, brought into range by powers of two (which keeps cosines as they are), with squared norms and int8 codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
        self.ids, self.x, self.square = ids, x, ordered_dot(x, x)
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        self.scale = np.abs(unit).max(axis=1) / 127
        self.code = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((unit - self.code * self.scale[:, None]) ** 2).sum(axis=1)) + 1e-12

    @classmethod
    def of_codes(cls, ids: np.ndarray, code: np.ndarray, scale: np.ndarray, error: np.ndarray) -> "Side":
        """Codes without their vectors: enough for bounds."""
        side = object.__new__(cls)
        side.ids, side.code, side.scale, side.error = ids, code, scale, error
        return side

    def part(self, rows: slice) -> "Side":
        side = object.__new__(Side)
        for name, values in vars(self).items():
            setattr(side, name, values[rows])
        return side


def cosine_bounds(q: Side, c: Side) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of a tile from the int8 product, and how far they may be off."""
    exact = np.float32 if q.code.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (q.code.astype(exact) @ c.code.astype(exact).T).astype(np.float64)
    return product * (q.scale[:, None] * c.scale[None, :]), q.error[:, None] * (1 + c.error[None, :]) + c.error[None, :] + 1e-12


def search_tile(q: Side, c: Side, heaps: list[list[tuple[float, int]]], k: int) -> None:
    """Bring each query's heap up to date with a tile of candidates."""
    near, off = cosine_bounds(q, c)
    own = q.ids[:, None] == c.ids[None, :]
    low = np.where(own, -np.inf, near - off)
    floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    if low.shape[1] >= k:
        floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
    qi, ci = np.nonzero((near + off >= floor[:, None]) & ~own)
    scores = ordered_dot(q.x[qi], c.x[ci]) / np.sqrt(q.square[qi] * c.square[ci])
    for i, score, key in zip(qi.tolist(), scores.tolist(), (-c.ids[ci]).tolist(), strict=True):
        heap = heaps[i]
        if len(heap) < k:
            heapq.heappush(heap, (score, key))
        elif (score, key) > heap[0]:
            heapq.heapreplace(heap, (score, key))


class CloseRows:
    """Of a block of queries: the k best lower bounds, and the pairs whose upper bound reaches the k-th.

    ``wide`` are the tiles with more such pairs of one query than `CLOSE_PAIRS`; those pairs
    are left to an exact search of the tile.
    """

    def __init__(self, q: Side, k: int):
        self.q, self.best, self.wide = q, np.full((len(q.ids), k), -np.inf), set()
        self.found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0), np.empty(0)]

    def meet(self, tile: int, c: Side) -> None:
        k = self.best.shape[1]
        parts = [self.found]
        for i in range(0, len(self.q.ids), TILE):
            q = self.q.part(slice(i, i + TILE))
            near, off = cosine_bounds(q, c)
            own = q.ids[:, None] == c.ids[None, :]
            low = np.where(own, -np.inf, near - off)
            top = np.partition(low, low.shape[1] - k, axis=1)[:, -k:] if low.shape[1] > k else low
            both = np.concatenate([self.best[i : i + TILE], top], axis=1)
            self.best[i : i + TILE] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            close = (near + off >= self.best[i : i + TILE].min(axis=1)[:, None]) & ~own
            if (many := close.sum(axis=1) > CLOSE_PAIRS).any():
                self.wide.add(tile)
                close[many] = False
            qi, ci = np.nonzero(close)
            parts.append([qi + i, np.full(len(qi), tile), ci.astype(np.int32), low[qi, ci], (near + off)[qi, ci]])
        self.found = [np.concatenate(p) for p in zip(*parts, strict=True)]
        if len(self.found[0]) > 2 * k * len(self.q.ids):
            self.prune()

    def prune(self) -> None:
        """Leave out what later tiles have outdone, and send the tiles of queries with too many pairs to the exact search."""
        keep = self.found[4] >= self.best.min(axis=1)[self.found[0]]
        many = np.bincount(self.found[0][keep], minlength=len(self.q.ids)) > CLOSE_PAIRS
        if many.any():
            self.wide.update(self.found[1][keep & many[self.found[0]]].tolist())
            keep &= ~many[self.found[0]]
        self.found = [f[keep] for f in self.found]


def exact_scores(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Cosines of rows of vectors, pairwise of one length, as `search_tile` computes them."""
    lengths, scores = x.value_lengths().to_numpy(zero_copy_only=False), np.empty(len(x))
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        a, b = (v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d)) for v in (x, y))
        a, b = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (a, b))
        scores[rows] = ordered_dot(a, b) / np.sqrt(ordered_dot(a, a) * ordered_dot(b, b))
    return scores


def _packed(rows: DataFrame, key: str, tile: int) -> DataFrame:
    """Tiles of up to ``tile`` usable vectors of one length and one ``key``: key, d, ids, x; rows of a key lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[tuple[int, int], list] = OrderedDict()

        def sent(at: tuple[int, int]) -> pa.RecordBatch:
            parts = held.pop(at)
            ids, x = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary())], names=["key", "d", "ids", "x"])

        for batch in batches:
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            for key_now in np.unique(keys):
                part = batch.filter(pa.array(keys == key_now))
                for ids, x in _vectors(part.column(1), part.column(0)):
                    for i in range(0, len(ids), tile):
                        at = int(key_now), x.shape[1]
                        held.setdefault(at, []).append((ids[i : i + tile], x[i : i + tile]))
                        if sum(len(p[0]) for p in held[at]) >= tile:
                            yield sent(at)
                        elif len(held) > HELD_BLOCKS:
                            yield sent(next(iter(held)))
        while held:
            yield sent(next(iter(held)))

    return rows.select("_id", "_v", F.col(key).cast("long")).transform(in_batches, run, "key long, d int, ids binary, x binary")


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, _id, score: the k nearest of each query in a task, from tiles of doubles (block, d, q_ids, q, c_ids, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[tuple, tuple[Side, list]] = OrderedDict()

        def sent(key) -> pa.RecordBatch:
            side, heaps = held.pop(key)
            out = [(i, -other, score) for i, h in zip(side.ids.tolist(), heaps, strict=True) for score, other in h]
            return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                block, d = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                q_ids, q_x, c_ids, c_x = (batch.column(j)[row].as_buffer() for j in range(2, 6))
                first = np.frombuffer(q_ids, "<i8", 1)[0]  # tells tiles of one block apart
                if (block, d, first) not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield sent(next(iter(held)))
                    ids = np.frombuffer(q_ids, "<i8").copy()
                    held[block, d, first] = Side(ids, np.frombuffer(q_x, "<f8").reshape(-1, d)), [[] for _ in ids]
                side, heaps = held[block, d, first]
                tile = Side(np.frombuffer(c_ids, "<i8"), np.frombuffer(c_x, "<f8").reshape(-1, d))
                for i in range(0, len(side.ids), TILE):
                    part = heaps[i : i + TILE]
                    search_tile(side.part(slice(i, i + TILE)), tile, part, k)
        while held:
            yield sent(next(iter(held)))

    return pairs.select("block", "d", "q_ids", "q", "c_ids", "c").transform(in_batches, run, "query_id long, _id long, score double")


def _coded(tiles: DataFrame, key: str, side: str) -> DataFrame:
    """Tiles (``key``, d, ids, x) with int8 codes, scales and errors in place of doubles, named after the side."""
    names = [f"{side}_{n}" for n in ("ids", "code", "scale", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                d = batch.column(1)[row].as_py()
                s = Side(*(np.frombuffer(batch.column(j)[row].as_buffer(), t).reshape(shape) for j, t, shape in ((2, "<i8", -1), (3, "<f8", (-1, d)))))
                cells = [s.ids.astype("<i8"), s.code, s.scale.astype("<f8"), s.error.astype("<f8")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=[key, "d", *names])

    return tiles.select(F.col(key).cast("long"), "d", "ids", "x").transform(in_batches, run, f"{key} long, d int, " + ", ".join(f"{n} binary" for n in names))


def close_pairs(queries: DataFrame, tiles: DataFrame, k: int, n_blocks: int, n_salts: int) -> DataFrame:
    """block, d, tile, and of each pair left: query_id, place in the tile, low, high; of tiles to search whole: nulls."""
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = _coded(queries, "block", "q").withColumn("salt", copies(n_salts))
    c = _coded(tiles, "tile", "c").withColumn("salt", F.pmod(F.xxhash64("tile"), F.lit(n_salts))).withColumn("block", copies(n_blocks))
    met = c.join(q.hint("shuffle_merge"), ["block", "salt", "d"])
    codes = [f"{side}_{n}" for side in "qc" for n in ("ids", "code", "scale", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[tuple, CloseRows] = OrderedDict()

        def sent(key: tuple) -> pa.RecordBatch:
            rows = held.pop(key)
            rows.prune()
            qi, tile, place, low, high = rows.found
            blank = len(rows.wide)
            columns = [
                pa.array(np.full(len(qi) + blank, key[0])),
                pa.array(np.full(len(qi) + blank, key[2], np.int32)),
                pa.array(np.concatenate([tile, np.array(sorted(rows.wide), np.int64)])),
                *[pa.concat_arrays([pa.array(v), pa.nulls(blank, pa.array(v).type)]) for v in (rows.q.ids[qi], place, low, high)],
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "d", "tile", "query_id", "place", "low", "high"])

        for batch in batches:
            for row in range(batch.num_rows):
                block, salt, d, tile = (batch.column(j)[row].as_py() for j in range(4))
                q, c = (Side.of_codes(*(np.frombuffer(batch.column(j + n)[row].as_buffer(), t).reshape(shape) for n, (t, shape) in enumerate((("<i8", -1), ("i1", (-1, d)), ("<f8", -1), ("<f8", -1))))) for j in (4, 8))
                key = block, salt, d, int(q.ids[0])
                if key not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield sent(next(iter(held)))
                    held[key] = CloseRows(Side.of_codes(*(v.copy() for v in (q.ids, q.code, q.scale, q.error))), k)
                held[key].meet(tile, c)
        while held:
            yield sent(next(iter(held)))

    return met.select("block", "salt", "d", "tile", *codes).transform(in_batches, run, "block long, d int, tile long, query_id long, place int, low double, high double")


def _search_by_codes(rows: DataFrame, asking: DataFrame, queries: DataFrame, k: int, n_blocks: int) -> DataFrame:
    """query_id, _id, score of pairs among which are the k nearest: bounds from codes, then doubles of what they leave."""
    tiles = _packed(rows.withColumn("_key", F.lit(0)), "_key", TILE)
    tiles = materialize(tiles.select(F.monotonically_increasing_id().alias("tile"), "d", "ids", "x"), "tiles")  # written, so a tile keeps its number
    queries = materialize(queries, "query_tiles")
    n_salts = max(1, -(-tiles.count() // TILES_A_SALT))
    close = materialize(close_pairs(queries, tiles, k, n_blocks, n_salts), "close_pairs")
    wide = sized(materialize(close.where(F.col("query_id").isNull()).select("block", "d", "tile").distinct(), "wide_tiles"), BROADCAST_ROWS)
    # a query's k-th lower bound over all tasks; pairs left to the search of a tile only make it lower
    of_query = Window.partitionBy("query_id")
    listed = close.where(F.col("query_id").isNotNull()).withColumn("_n", F.row_number().over(of_query.orderBy(F.desc("low"), "tile", "place")))
    listed = listed.withColumn("_floor", F.max(F.when(F.col("_n") == k, F.col("low"))).over(of_query)).where(F.col("_floor").isNull() | (F.col("high") >= F.col("_floor")))
    listed = materialize(listed.join(wide, ["block", "d", "tile"], "left_anti").select("query_id", "tile", "place"), "listed")
    needed = sized(materialize(listed.select("tile", "place").distinct(), "needed"), BROADCAST_ROWS)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tile, d = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                ids, x = (np.frombuffer(batch.column(j)[row].as_buffer(), t) for j, t in ((2, "<i8"), (3, "<f8")))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, d), pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), tile)), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids), vectors], names=["tile", "place", "_id", "_c"])

    fetched = tiles.transform(in_batches, unpacked, "tile long, place int, _id long, _c array<double>").join(needed, ["tile", "place"])
    met = listed.join(fetched, ["tile", "place"]).join(asking.select(F.col("_id").alias("query_id"), "_v"), "query_id")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exact_scores(batch.column(2), batch.column(3)))], names=["query_id", "_id", "score"])

    found = met.select("query_id", "_id", "_v", "_c").transform(in_batches, scored, "query_id long, _id long, score double")
    salt = F.pmod(F.xxhash64("tile"), F.lit(n_salts)).alias("salt")
    whole = tiles.join(wide, ["tile", "d"]).select("block", salt, "d", F.col("ids").alias("c_ids"), F.col("x").alias("c"))
    salts = sized(materialize(wide.select("block", salt, "d").distinct(), "salts"), BROADCAST_ROWS)
    return found.unionByName(_search(whole.join(_named(queries).join(salts, ["block", "d"]).hint("shuffle_merge"), ["block", "salt", "d"]), k))


def _named(queries: DataFrame) -> DataFrame:
    return queries.select("block", "d", F.col("ids").alias("q_ids"), F.col("x").alias("q"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k nearest rows of every query row: query_id, rank, id, score (cosine)."""
    refuse_clashes([id_col], ["query_id", "rank", "score"])
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), is_query.alias("_asks"))
    # unusable vectors go before the least is taken, as they could be it
    odd = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("_id").isNotNull() & (F.size("_v") > 0) & ~odd & F.exists("_v", lambda x: x != 0))
    asking = materialize(rows.where("_asks").groupBy("_id").agg(F.min("_v").alias("_v")), "queries")
    size = asking.agg(F.sum(8 * F.size("_v") + 64)).first()[0] or 0
    n_blocks = max(1, -(-int(size) // block_bytes))
    blocks = asking.withColumn("_key", F.pmod(F.xxhash64("_id"), F.lit(n_blocks)))
    blocks = blocks.repartition(n_blocks, "_key").sortWithinPartitions("_key")
    widest = block_bytes // 64  # rows: a block is one tile a length, or several
    queries = _packed(blocks, "_key", max(1, min(widest, 8 * TILE))).withColumnRenamed("key", "block")
    if n_blocks == 1:
        c = _packed(rows.withColumn("_key", F.lit(0)), "_key", TILE).select("d", F.col("ids").alias("c_ids"), F.col("x").alias("c"))
        found = _search(c.join(F.broadcast(_named(queries)), "d"), k)  # block_bytes, about
    else:
        found = _search_by_codes(rows, asking, queries, k, n_blocks)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("_id").alias(id_col), "score")


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), queries AS (SELECT vec_id, min(v) AS v FROM usable WHERE vec_id % 50 = 0 GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(c.v, c.v)) AS score
  FROM queries q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
