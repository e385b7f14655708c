"""Centroid clustering with Drake's adaptive bounds, on whole numbers.

Each vector keeps an upper bound of the distance to its centroid, lower bounds to
the next ``TRACKED`` nearest centroids, and one lower bound for all the rest. When
centroids move, the bounds give way by as much. A vector whose upper bound stays below
every lower bound keeps its centroid unseen; else its distance is taken exactly; if
that isn't enough, but is below the bound of the rest, only the tracked centroids are
put in order anew; and only if the order can't be certified so is the vector held
against all centroids. Bounds are strict and rounded outward, so ties always come to
an exact comparison of whole numbers.

Vectors are packed into blocks, a row each, in a bucketed table; the bounds are a
second table with the same buckets. A round joins the two by block without a shuffle,
writes the new bounds beside the old, and drops those. Tasks add their clusters'
vectors up, a row of sums a task; Spark adds those, and the driver gets one row for
each cluster and component. Every round ends with a written table, so a lost executor
costs tasks of the round at hand.

Distances and sums are exact at any size: components within ``PLAIN`` go through
machine integers, larger ones through Python's, in blocks of their own that are
compared exactly each round. Sums of those travel in limbs.

Defined results: vectors that are null, of another length, or hold null or non-finite
components take no part; a null id hashes as an empty one and is given back as null;
of equal hashes the smaller vector comes first; repeated rows are a vector each; fewer
vectors than clusters make fewer clusters; distances and inertias beyond a long are
its largest value; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickloom.llm._shared import discard, in_batches, materialize, refuse_clashes, shared_path

#: Components of a vector, lower bounds that each vector keeps, vectors of a block, vectors of a bucket at most (64 MB), about.
DIMENSIONS, TRACKED, BLOCK, BUCKET = 64, 3, 2048, 1 << 18
#: Components below it are exact in machine integers, and products of those below FAST in doubles.
PLAIN, FAST = 1 << 27, 1 << 20
LIMB, LONGEST = 40, (1 << 63) - 1
#: Bounds are widened by this share, which covers the rounding of every step.
SLACK = 1e-12


def whole_number(x: float, scale: int) -> int:
    """floor(scale * x), exactly; ``scale`` is a power of two."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors from all centroids."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
    elif max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < FAST:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        x = x.astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def squared_from(x: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector from one centroid of its own."""
    apart = (x.astype(object) if c.dtype == object else x.astype(np.int64) if x.dtype != object else x) - c[which]
    return (apart * apart).sum(axis=1)


def above(squares: np.ndarray) -> np.ndarray:
    """Doubles at or above the roots."""
    return np.sqrt(_floats(squares, math.inf)) * (1 + SLACK)


def below(squares: np.ndarray) -> np.ndarray:
    """Doubles at or below the roots."""
    return np.sqrt(_floats(squares, 1e300)) * (1 - SLACK)


def _floats(squares: np.ndarray, largest: float) -> np.ndarray:
    if squares.dtype != object:
        return squares.astype(np.float64)
    flat = [float(v) if v < 10**300 else largest for v in squares.ravel()]
    return np.array(flat, dtype=np.float64).reshape(squares.shape)


class Bounds:
    """Centroid numbers (own first, then the tracked ones) and the bounds of a block's vectors: upper, lower ones, rest."""

    def __init__(self, near: np.ndarray, bounds: np.ndarray):
        self.near, self.bounds = near, bounds

    @classmethod
    def scanned(cls, x: np.ndarray, c: np.ndarray) -> Bounds:
        """Exact order of all centroids; ties go to the smaller number."""
        squares = squared(x, c)
        order = np.argsort(squares, axis=1, kind="stable")
        held = min(TRACKED + 1, len(c))
        sorted_squares = np.take_along_axis(squares, order, axis=1)
        rest = below(sorted_squares[:, held]) if held < len(c) else np.full(len(x), np.inf)
        return cls(order[:, :held].astype(np.int32), np.column_stack([above(sorted_squares[:, 0]), below(sorted_squares[:, 1:held]), rest]))

    def drifted(self, drift: np.ndarray) -> None:
        """Bounds after each centroid has moved by at most ``drift``."""
        b, own = self.bounds, drift[self.near]
        b[:, 0] = (b[:, 0] + own[:, 0]) * (1 + SLACK)
        b[:, 1:-1] -= own[:, 1:] + SLACK * (np.abs(b[:, 1:-1]) + own[:, 1:])
        b[:, -1] -= drift.max() * (1 + SLACK) + SLACK * np.where(np.isfinite(b[:, -1]), np.abs(b[:, -1]), 0)

    def uncertain(self, rows: np.ndarray) -> np.ndarray:
        b = self.bounds[rows]
        return rows[~(b[:, 0] < b[:, 1:].min(axis=1))]

    def settle(self, x: np.ndarray, c: np.ndarray) -> tuple[int, int]:
        """Certify or renew each vector's order; returns how many took part of the centroids, and how many all."""
        rows = self.uncertain(np.arange(len(x)))
        if not len(rows):
            return 0, 0
        self.bounds[rows, 0] = above(squared_from(x[rows], c, self.near[rows, 0]))
        rows = self.uncertain(rows)
        tracked = rows[self.bounds[rows, 0] < self.bounds[rows, -1]]
        if len(tracked):
            ids = np.sort(self.near[tracked], axis=1)
            squares = np.stack([squared_from(x[tracked], c, ids[:, k]) for k in range(ids.shape[1])], axis=1)
            order = np.argsort(squares, axis=1, kind="stable")
            squares = np.take_along_axis(squares, order, axis=1)
            self.near[tracked] = np.take_along_axis(ids, order, axis=1)
            self.bounds[tracked, 0], self.bounds[tracked, 1:-1] = above(squares[:, 0]), below(squares[:, 1:])
        rest = np.setdiff1d(rows, tracked, assume_unique=True)
        if len(rest):
            new = Bounds.scanned(x[rest], c)
            self.near[rest], self.bounds[rest] = new.near, new.bounds
        return len(tracked), len(rest)


class Centroids:
    """The centroids of a round and how far each has moved since the last one."""

    def __init__(self, rows: list[list[int]], last: "Centroids | None" = None):
        self.rows = rows
        big = any(abs(v) >= PLAIN for row in rows for v in row)
        self.x = np.array(rows, dtype=object if big else np.int64).reshape(len(rows), DIMENSIONS)
        moves = [sum((a - b) ** 2 for a, b in zip(new, old, strict=True)) for new, old in zip(rows, last.rows if last else rows, strict=True)]
        self.drift = above(np.array(moves, dtype=object))


class _Sums:
    """Component sums and sizes of the clusters that a task has seen."""

    def __init__(self, k: int):
        self.plain, self.big = np.zeros((k, DIMENSIONS + 1), dtype=np.int64), {}

    def add(self, x: np.ndarray, own: np.ndarray) -> None:
        if x.dtype == object:
            for row, cluster in zip(x, own.tolist(), strict=True):
                self.big[cluster] = self.big.get(cluster, 0) + np.append(row, 1)
            return
        member = (own[:, None] == np.arange(len(self.plain))).astype(np.float64)
        self.plain[:, :-1] += (member.T @ x.astype(np.float64)).astype(np.int64)  # whole numbers below 2**53
        self.plain[:, -1] += member.sum(axis=0).astype(np.int64)

    def rows(self) -> list[dict]:
        """Clusters' sums by limb: limb k counts 2**(LIMB * k), the last one keeps the sign."""
        out = [{"cluster": c, "limb": 0, "sums": row.tolist()} for c, row in enumerate(self.plain) if row[-1]]
        for cluster, values in self.big.items():
            values, limb = [int(v) for v in values], 0
            while any(values):
                last = all(-(1 << LIMB) < v < 1 << LIMB for v in values)
                out.append({"cluster": cluster, "limb": limb, "sums": values if last else [v & ((1 << LIMB) - 1) for v in values]})
                values, limb = [0] if last else [v >> LIMB for v in values], limb + 1
        return out


_BLOCK = "block long, plain boolean, ids binary, unnamed binary, codes binary"
_SUMS = "array<struct<cluster:int,limb:int,sums:array<long>>>"


def _vectors(plain: bool, codes: pa.BinaryScalar) -> np.ndarray:
    """A block's vectors: machine integers, or Python's where they are large."""
    if plain:
        return np.frombuffer(codes.as_buffer(), "<i4").reshape(-1, DIMENSIONS)
    return np.array([int(v) for v in codes.as_py().split(b",")], dtype=object).reshape(-1, DIMENSIONS)


def _packed(vectors: DataFrame, scale: int) -> DataFrame:
    """Blocks of up to ``BLOCK`` vectors as whole numbers, those with large components apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33

        def sent(plain: bool, ids: pa.Array, codes: bytes) -> pa.RecordBatch:
            nonlocal block
            block += 1
            values = [block, plain, ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), np.asarray(ids.is_null()).astype(np.uint8).tobytes(), codes]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "plain", "ids", "unnamed", "codes"])

        held_ids, held = [], []
        for batch in batches:
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, DIMENSIONS)
            plain = np.abs(x).max(axis=1, initial=0) < PLAIN / scale - 1
            for k in np.flatnonzero(~plain).tolist():
                yield sent(False, batch.column(0).slice(k, 1), b",".join(b"%d" % whole_number(v, scale) for v in x[k].tolist()))
            held_ids.append(batch.column(0).filter(pa.array(plain)))
            held.append(np.floor(x[plain] * scale).astype("<i4"))
            while sum(map(len, held)) >= BLOCK:
                ids, codes = pa.concat_arrays(held_ids), np.concatenate(held)
                yield sent(True, ids[:BLOCK], codes[:BLOCK].tobytes())
                held_ids, held = [ids[BLOCK:]], [codes[BLOCK:]]
        if sum(map(len, held)):
            yield sent(True, pa.concat_arrays(held_ids), np.concatenate(held).tobytes())

    return vectors.select("_id", "_v").transform(in_batches, run, _BLOCK)


class _Bucketed:
    """Tables by block in so many buckets, written where driver and executors share files; a name each in the catalogue."""

    def __init__(self, buckets: int):
        self.buckets, self.names = buckets, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        spark, table = df.sparkSession, f"clickloom_{name}_{uuid.uuid4().hex}"
        path = shared_path(spark, name)
        df.write.bucketBy(self.buckets, "block").sortBy("block").format("parquet").option("path", path).saveAsTable(table)
        written = spark.table(table)
        written._written_to, written._name = path, table
        return written

    def drop(self, df: DataFrame) -> None:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._name}")
        discard(df)


def _settled(blocks: DataFrame, bounds: DataFrame | None, now: Centroids) -> DataFrame:
    """The bounds of all blocks after a round: block, near, bounds; the last row of a task has its sums."""
    names = ["block", "near", "bounds", "sums", "tracked", "scanned"]
    schema = f"block long, near binary, bounds binary, sums {_SUMS}, tracked long, scanned long"
    types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("cluster", pa.int32()), ("limb", pa.int32()), ("sums", pa.list_(pa.int64()))])), pa.int64(), pa.int64()]
    held, fresh = min(TRACKED + 1, len(now.rows)), bounds is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, waiting = _Sums(len(now.rows)), None

        def row(values: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                block, plain = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                x = _vectors(plain, batch.column(2)[k])
                if fresh:
                    state, seen = Bounds.scanned(x, now.x), (0, len(x))
                else:
                    near = np.frombuffer(batch.column(3)[k].as_buffer(), "<i4").reshape(-1, held).copy()
                    state = Bounds(near, np.frombuffer(batch.column(4)[k].as_buffer(), "<f8").reshape(-1, held + 1).copy())
                    state.drifted(now.drift)
                    seen = state.settle(x, now.x)
                sums.add(x, state.near[:, 0])
                if waiting:
                    yield row(waiting)
                waiting = [block, state.near.astype("<i4").tobytes(), state.bounds.astype("<f8").tobytes(), None, *seen]
        if waiting:
            waiting[3] = sums.rows()
            yield row(waiting)

    return _beside(blocks, bounds).transform(in_batches, run, schema)


def _beside(blocks: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """Blocks and their bounds: both lie in the same buckets, so a merge of sorted buckets needs no shuffle."""
    if bounds is None:
        return blocks.select("block", "plain", "codes")
    return blocks.select("block", "plain", "codes").join(bounds.select("block", "near", "bounds").hint("merge"), "block")


def _moved(bounds: DataFrame, last: Centroids) -> Centroids:
    """Floors of the clusters' means; an empty cluster's centroid stays."""
    each = bounds.where("sums is not null").select(F.explode("sums").alias("s")).select("s.cluster", "s.limb", F.posexplode("s.sums").alias("at", "value"))
    totals = [[0] * (DIMENSIONS + 1) for _ in last.rows]
    for r in each.groupBy("cluster", "limb", "at").agg(F.sum("value").alias("value")).collect():  # clusters x components
        totals[r["cluster"]][r["at"]] += r["value"] << (LIMB * r["limb"])
    return Centroids([[v // t[-1] for v in t[:-1]] if t[-1] else old for t, old in zip(totals, last.rows, strict=True)], last)


def _final_rows(blocks: DataFrame, bounds: DataFrame, now: Centroids) -> DataFrame:
    held = min(TRACKED + 1, len(now.rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = _vectors(batch.column(0)[k].as_py(), batch.column(1)[k])
                near = np.frombuffer(batch.column(4)[k].as_buffer(), "<i4").reshape(-1, held).copy()
                state = Bounds(near, np.frombuffer(batch.column(5)[k].as_buffer(), "<f8").reshape(-1, held + 1).copy())
                state.drifted(now.drift)
                state.settle(x, now.x)
                squares = squared_from(x, now.x, state.near[:, 0])
                ids = pa.array(np.frombuffer(batch.column(2)[k].as_buffer(), "<i8"), mask=np.frombuffer(batch.column(3)[k].as_buffer(), np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(state.near[:, 0], pa.int32()), pa.array([min(int(v), LONGEST) for v in squares], pa.int64())], names=["_id", "cluster", "distance"])

    joined = blocks.join(bounds.select("block", "near", "bounds").hint("merge"), "block").select("plain", "codes", "ids", "unnamed", "near", "bounds")
    return joined.transform(in_batches, run, "_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding", stats: list | None = None) -> DataFrame:
    """Lloyd's clusters of the vectors' whole numbers ``floor(scale * x)``; ``scale`` is a power of two.

    Returns the id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``
    and ``centroid_sha256``. ``stats`` gets for each round how many vectors were held
    against their tracked and against all centroids.
    """
    refuse_clashes([id_col], ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v"))
    odd = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where((F.size("_v") == DIMENSIONS) & ~odd)
    first = rows.withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)).orderBy("_hash", "_v").limit(k)
    start = [[whole_number(x, scale) for x in r["_v"]] for r in first.collect()]  # k rows
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    now = Centroids(start)
    n = rows.count()
    tables = _Bucketed(max(1, min(-(-n // BLOCK), max(spark.sparkContext.defaultParallelism, -(-n // BUCKET)))))
    blocks = tables.write(_packed(rows, scale).repartition(tables.buckets, "block"), "blocks")
    bounds = None
    for _ in range(rounds):
        new = tables.write(_settled(blocks, bounds, now), "bounds")
        if bounds is not None:
            tables.drop(bounds)
        bounds, last = new, now
        if stats is not None:
            stats.append(tuple(bounds.agg(F.sum("tracked"), F.sum("scanned")).first()))
        now = _moved(bounds, last)
        if now.rows == last.rows:  # every further round would give the same
            break
    if bounds is None:
        bounds = tables.write(_settled(blocks, None, now), "bounds")
    placed = materialize(_final_rows(blocks, bounds, now), "clusters")
    tables.drop(bounds)
    tables.drop(blocks)
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digests = [(c, min(sums.get(c, 0), LONGEST), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(now.rows)]
    known = spark.createDataFrame(digests, "cluster int, cluster_inertia long, centroid_sha256 string")
    joined = placed.join(F.broadcast(known), "cluster")  # k rows
    return joined.select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(min(sum(sums.values()), LONGEST)).cast("long").alias("inertia"), "centroid_sha256")


def _sql_rounds(rounds: int) -> str:
    apart = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(k.v, c.v)])"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT r, min([{apart}, c.c]) AS m FROM kept k, c{r} c GROUP BY r)")
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT m[2] AS c, i, sum(x) AS s, count(*) AS n FROM (SELECT m, unnest(v) AS x, unnest(range(64)) AS i FROM a{r} JOIN kept USING (r)) GROUP BY ALL) GROUP BY c) n ON n.c = c.c)"""
            )
    return ",\n".join(steps)


#: Every round against all centroids, without bounds.
ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT 8)
),
{_sql_rounds(10)}
SELECT vec_id, m[2]::INTEGER AS cluster, m[1]::BIGINT AS distance, (sum(m[1]) OVER (PARTITION BY m[2]))::BIGINT AS cluster_inertia,
  (sum(m[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a10 JOIN kept USING (r) JOIN c10 c ON c.c = m[2]
"""
