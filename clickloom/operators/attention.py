"""Graph attention by joins and aggregates, for graphs of any size.

A layer is a superstep: nodes are projected where they lie, every edge meets its source and
then its destination, and one aggregate by destination sums ``e`` and ``e * h`` of its edges,
whose ratio is the attention's result. So an edge moves twice, no share is joined back to edges,
sums are combined where the destination's edges have met, and no task holds a node's edges.
Edges aren't sorted where a task's nodes, which are unique and so evenly dealt, fit in memory.

Ends with very many edges are split: edges are dealt by salt, and the end's row is
repeated for each. An end is a hub beyond `HUB_EDGES` edges, or beyond the
`HUBS`-th part of all edges where that is more, so there are never more than `HUBS` of them.
Edges are counted by buckets of ends, and by ends only in buckets that could hold a hub.

Defined results: parallel edges count each, equal ones too.
Edges with a null weight or end, or an end that isn't a node, count for nothing; a node
without edges keeps its residual; a node without a vector has none after. Nodes must be
unique by key and name; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.text import bound
from clickloom.sources.shared import shared_folder

#: Edges of an end beyond which it is split, and the most ends that can be, which are broadcast.
HUB_EDGES, HUBS = 1 << 16, 1 << 18

#: Bytes of nodes in a shuffle partition, as estimated, up to which joins hash them; beyond, both sides are sorted.
HASHED_BYTES = 1 << 26


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)


def linear(x: Column, w: np.ndarray, bias: Sequence[float] | None = None) -> Column:
    """``x @ w + bias`` of array columns."""
    w = np.asarray(w, float)
    product = F.transform(F.array(*[_array(c) for c in w.T]), lambda c: _dot(x, c))
    product = product if bias is None else F.zip_with(product, _array(bias), lambda a, b: a + b)
    return F.when(x.isNotNull(), product)


def batch_norm(x: Column, gain, offset, mean, var, eps: float = 1e-5) -> Column:
    """Batch normalisation by kept statistics."""
    scale = np.asarray(gain, float) / np.sqrt(np.asarray(var, float) + eps)
    centred = F.zip_with(x, _array(mean), lambda a, m: a - m)
    return F.zip_with(F.zip_with(centred, _array(scale), lambda a, s: a * s), _array(offset), lambda a, o: a + o)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def unit(x: Column) -> Column:
    """Of unit length, up to a guard against zeros."""
    return bound(F.sqrt(_dot(x, x) + F.lit(1e-24)), lambda length: F.transform(x, lambda v: v / length))


def _hubs(edges: DataFrame, end: str, key: str, most: int, total: int) -> DataFrame:
    """key, end, _salts of ends with more than ``most`` of the ``total`` edges."""
    ends = edges.select(key, end, F.pmod(F.xxhash64(key, end), F.lit(4 * total // most + 1)).alias("_bucket"))
    full = ends.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_bucket")
    counts = ends.join(F.broadcast(full), "_bucket", "left_semi").groupBy(key, end).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    return counts.select(key, end, F.ceil(F.col("_n") / most).cast("int").alias("_salts"))


def _deal(edges: DataFrame, hubs: DataFrame, end: str, key: str) -> DataFrame:
    """Edges with a salt of their end. It goes by the row's place, so that equal edges are spread too; ``edges`` are to be read from files, whose order stays."""
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_salts"))
    dealt = edges.join(F.broadcast(hubs), [key, end], "left")
    return dealt.withColumn(f"_{end}_salt", F.when(F.col("_salts").isNull(), 0).otherwise(place).cast("int")).drop("_salts")


def _meet(edges: DataFrame, nodes: DataFrame, hubs: DataFrame | None, end: str, key: str, how: str) -> DataFrame:
    """Edges with their end's columns; a hub is repeated, a row for each salt. ``how`` is the join's hint."""
    on, ends = [end, key], nodes.withColumnRenamed("entity", end)
    if hubs is not None:
        on.append(f"_{end}_salt")
        ends = ends.join(F.broadcast(hubs), [key, end], "left")
        ends = ends.withColumn(on[-1], F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return edges.join(ends.hint(how), on).drop(*on[2:])


def attention_layer(nodes: DataFrame, edges: DataFrame, w, a, residual: tuple | None = None, key: str = "sample_id", entity: str = "entity", vector: str = "features", slope: float = 0.2, eps: float = 1e-8, hub_edges: int = HUB_EDGES) -> DataFrame:
    """key, entity, vector after a layer of several heads, from nodes (key, entity, vector) and edges (key, head, tail, weight).

    ``w`` is (inputs, heads * width), ``a`` (heads, 2 * width) with the source's part first,
    ``residual`` a pair (weights, bias) or None for the vector itself. Nodes are read more than
    once; the edges are written to the shared folder and read from there.
    """
    w, a = np.asarray(w, float), np.asarray(a, float)
    heads, width = a.shape[0], a.shape[1] // 2
    if w.shape[1] != heads * width or (residual is None and w.shape[0] != w.shape[1]):
        raise ValueError("shapes of the projection, the scores and the residual don't agree")
    spark, folder = nodes.sparkSession, f"{shared_folder(nodes.sparkSession)}/edges"
    whole = edges.where(F.col(key).isNotNull() & F.col("head").isNotNull() & F.col("tail").isNotNull() & F.col("weight").isNotNull())
    whole = whole.select(key, "head", "tail", F.col("weight").cast("double").alias("weight"))
    whole.write.parquet(folder)
    whole = spark.read.schema(whole.schema).parquet(folder)
    total = whole.count()
    most = max(hub_edges, total // HUBS)
    # no broadcast: files of nodes, by which Spark would choose one, can be far smaller than their rows
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    how = "shuffle_hash" if nodes.count() * 8 * (heads * (width + 1) + 16) <= HASHED_BYTES * partitions else "merge"
    hubs = {end: _hubs(whole, end, key, most, total) if total > most else None for end in ("head", "tail")}
    for end, found in hubs.items():
        whole = whole if found is None else _deal(whole, found, end, key)

    def scores(part: int) -> list[Column]:
        """The scores of a node as source (0) or destination (1), by head."""
        return [_dot(F.slice("_h", k * width + 1, width), _array(a[k, part * width : (part + 1) * width])) for k in range(heads)]

    projected = nodes.where(F.col(vector).isNotNull()).select(key, F.col(entity).alias("entity"), linear(F.col(vector), w).alias("_h"))
    met = _meet(whole, projected.select(key, "entity", F.concat(F.array(*scores(0)), "_h").alias("_from")), hubs["head"], "head", key, how).drop("head")
    met = _meet(met, projected.select(key, "entity", F.array(*scores(1)).alias("_to")), hubs["tail"], "tail", key, how)
    # places of arrays and columns for heads: all of it is generated code
    met = met.select(key, F.col("tail").alias("entity"), "weight", "_from", *[(F.col("_from")[k] + F.col("_to")[k]).alias(f"_r{k}") for k in range(heads)])
    e = [F.exp(F.when(F.col(f"_r{k}") >= 0, F.col(f"_r{k}")).otherwise(F.col(f"_r{k}") * slope) * F.col("weight")) for k in range(heads)]
    met = met.select(key, "entity", "_from", *[x.alias(f"_e{k}") for k, x in enumerate(e)])
    sums = [F.sum(f"_e{k}").alias(f"_s{k}") for k in range(heads)]
    sums += [F.sum(F.col(f"_e{j // width}") * F.col("_from")[heads + j]).alias(f"_m{j}") for j in range(heads * width)]
    added = met.groupBy(key, "entity").agg(*sums)
    added = added.select(key, "entity", F.array(*[F.col(f"_m{j}") / (F.col(f"_s{j // width}") + eps) for j in range(heads * width)]).alias("_added"))
    rest = F.col(vector) if residual is None else linear(F.col(vector), *residual)
    out = nodes.select(key, F.col(entity).alias("entity"), rest.alias("_rest")).join(added.hint(how), [key, "entity"], "left")
    result = F.zip_with("_rest", F.coalesce("_added", F.transform("_rest", lambda _: F.lit(0.0))), lambda x, y: x + y)
    return out.select(key, F.col("entity").alias(entity), result.alias(vector))


def core_vectors(nodes: DataFrame, edges: DataFrame, params: Mapping[str, np.ndarray], is_core: str = "is_core", key: str = "sample_id", entity: str = "entity", vector: str = "features", hub_edges: int = HUB_EDGES) -> DataFrame:
    """key, vector of unit length of the core nodes after two layers, by the parameters of `models.layers.gat_shapes`."""

    def normed(name: str) -> Column:
        return batch_norm(F.col(vector), *(params[f"{name}.{part}"] for part in ("g", "o", "mean", "var")))

    def layer(name: str, at: DataFrame) -> DataFrame:
        rest = (params[f"{name}.res.w"], params[f"{name}.res.b"]) if f"{name}.res.w" in params else None
        return attention_layer(at, edges, params[f"{name}.w"], params[f"{name}.a"], rest, key, entity, vector, hub_edges=hub_edges)

    first = layer("g1", nodes.withColumn(vector, normed("bn1")))
    folder = f"{shared_folder(nodes.sparkSession)}/layer"
    first.select(key, entity, relu(normed("bn2")).alias(vector)).write.parquet(folder)
    second = layer("g2", nodes.sparkSession.read.parquet(folder))
    core = nodes.where(F.col(is_core)).select(key, entity)
    return second.join(core, [key, entity], "left_semi").select(key, relu(F.col(vector)).alias(vector)).select(key, unit(F.col(vector)).alias(vector))
