"""Models over DataFrames: scoring in Arrow batches, and data-parallel training.

A training step is one pass over a hash share of the rows: every task adds up the
gradient of its rows, Spark sums the gradients by parameter place, and the driver
takes a step of the optimiser. What reaches the driver is as large as the model.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickloom.models.autodiff import Var, var
from clickloom.models.layers import Model, dropping, gat_core, gat_cores, gat_core_var, gat_head_shapes, gat_logit, gat_shapes
from clickloom.sources.files import exists


def _matrix(column: pa.Array) -> np.ndarray | None:
    if column.null_count == len(column):
        return None
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def score(df: DataFrame, model: Model, params: dict[str, np.ndarray], kg: str | None = "kg_vec", text: str | None = "text_vec", out: str = "logit") -> DataFrame:
    """Add the model's logit. Rows without a needed vector fail."""
    sent = df.sparkSession.sparkContext.broadcast(params)
    nothing = F.lit(None).cast("array<double>")
    base = df.withColumns({"_a": F.col(kg).cast("array<double>") if kg else nothing, "_b": F.col(text).cast("array<double>") if text else nothing})
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {k: Var(v) for k, v in sent.value.items()}
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                logits = model.forward(p, _matrix(part.column(part.num_columns - 2)), _matrix(part.column(part.num_columns - 1))).value
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(logits)], names=schema.names)

    return base.mapInArrow(run, schema)


def apply_model(df: DataFrame, model: Model, params: dict[str, np.ndarray], vector: str, out: str) -> DataFrame:
    """Add what a model of one input makes of a vector column, as an array."""
    sent = df.sparkSession.sparkContext.broadcast(params)
    base = df.withColumn("_x", F.col(vector).cast("array<double>"))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {k: Var(v) for k, v in sent.value.items()}
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                made = model.forward(p, var(_matrix(part.column(part.num_columns - 1)))).value
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(made), pa.list_(pa.float64()))], names=schema.names)

    return base.mapInArrow(run, schema)


def loss_of(name: str, logit: Var, label: np.ndarray, pos_weight: float = 1.0, alpha: float = 0.25, gamma: float = 2.0) -> Var:
    """Sum of a loss over rows: bce_with_logits, focal, mse or smooth_l1."""
    soft = (-logit).softplus()
    if name == "bce_with_logits":
        return (logit * (1 - label) + soft * (1 + (pos_weight - 1) * label)).sum()
    if name == "focal":
        bce = logit * (1 - label) + soft
        return ((1.0 - (-bce).exp()).power(gamma) * bce * alpha).sum()
    gap = logit - label
    if name == "mse":
        return (gap * gap).sum()
    if name == "smooth_l1":
        small = (np.abs(gap.value) < 1).astype(float)
        sign = np.sign(gap.value)
        return (gap * gap * (0.5 * small) + (gap * sign - 0.5) * (1 - small)).sum()
    raise ValueError(f"unknown loss {name}")


@dataclass
class Optimiser:
    """Adam, AdamW or SGD with momentum; parameters whose names begin with ``slow`` learn at a tenth."""

    kind: str = "adamw"
    rate: float = 1e-3
    decay: float = 1e-2
    slow: tuple[str, ...] = ()
    clip: float = 1.0
    state: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    steps: int = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.steps += 1
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink = min(1.0, self.clip / (norm + 1e-6))
        for name, g in grads.items():
            g = g * shrink
            rate = self.rate * scale * (0.1 if name.startswith(self.slow) and self.slow else 1.0)
            m, v = self.state.get(name, (np.zeros_like(g), np.zeros_like(g)))
            if self.kind == "sgd":
                m = 0.9 * m + g + self.decay * params[name]
                params[name] = params[name] - rate * m
            elif self.kind in ("adam", "adamw"):
                if self.kind == "adam":
                    g = g + self.decay * params[name]
                else:
                    params[name] = params[name] * (1 - rate * self.decay)
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                params[name] = params[name] - rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
            else:
                raise ValueError(f"unknown optimiser {self.kind}")
            self.state[name] = (m, v)


def schedule(kind: str, epoch: int, best_age: int = 0, period: int = 10, step: int = 10, factor: float = 0.5, patience: int = 3) -> float:
    """Scale of the learning rate: cosine with restarts, step, plateau (by epochs since the best), or none."""
    if kind == "cosine":
        return 0.5 * (1 + math.cos(math.pi * (epoch % period) / period))
    if kind == "step":
        return factor ** (epoch // step)
    if kind == "plateau":
        return factor ** (best_age // patience)
    if kind == "none":
        return 1.0
    raise ValueError(f"unknown schedule {kind}")


def gradient(df: DataFrame, model: Model, params: dict[str, np.ndarray], loss: str, kg: str | None, text: str | None, label: str, pos_weight: float = 1.0, dropout: float = 0.0, seed: int = 42) -> tuple[dict[str, np.ndarray], float, int]:
    """(mean gradient, mean loss, rows) over all rows of ``df``.

    Dropout is drawn from the seed, the partition and the place in it, so a task
    that is run again draws what it drew.
    """
    sent = df.sparkSession.sparkContext.broadcast(params)
    nothing = F.lit(None).cast("array<double>")
    base = df.select(F.col(kg).cast("array<double>").alias("a") if kg else nothing.alias("a"), F.col(text).cast("array<double>").alias("b") if text else nothing.alias("b"), F.col(label).cast("double").alias("y"))
    names = list(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lost, rows = None, 0.0, 0
        place = TaskContext.get().partitionId()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                p = {n: Var(v) for n, v in sent.value.items()}
                with dropping(dropout, (seed, place, rows)):
                    logit = model.forward(p, _matrix(part.column(0)), _matrix(part.column(1)))
                out = loss_of(loss, logit, part.column(2).to_numpy(zero_copy_only=False), pos_weight)
                out.backward()
                g = np.concatenate([(p[n].grad if p[n].grad is not None else np.zeros_like(p[n].value)).ravel() for n in names])
                total = g if total is None else total + g
                lost, rows = lost + float(out.value), rows + part.num_rows
        if rows:
            g = np.concatenate([total, [lost, rows]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(g))), pa.array(g)], names=["place", "g"])

    got = base.mapInArrow(run, "place long, g double").groupBy("place").agg(F.sum("g").alias("g")).orderBy("place").toPandas()  # as large as the model
    if not len(got):
        raise ValueError("no rows to learn from")
    flat = got["g"].to_numpy()
    n, at, grads = flat[-1], 0, {}
    for name in names:
        size = params[name].size
        grads[name] = flat[at : at + size].reshape(params[name].shape) / n
        at += size
    return grads, float(flat[-2] / n), int(n)


def train(df: DataFrame, model: Model, valid: DataFrame | None = None, epochs: int = 20, batches: int = 1, accumulate: int = 1, loss: str = "bce_with_logits", optimiser: Optimiser | None = None, scheduler: str = "none", patience: int = 25, tolerance: float = 1e-4, seed: int = 42, kg: str | None = "kg_vec", text: str | None = "text_vec", label: str = "label", key: str = "sample_id", params: dict[str, np.ndarray] | None = None, dropout: float = 0.0, checkpoint: str | None = None) -> tuple[dict[str, np.ndarray], list[dict]]:
    """Train with early stopping on the validation AUC; returns the best parameters and the epochs' log.

    Each of ``batches`` steps takes another hash share of the rows; ``accumulate``
    gradients are averaged for a step, the rest flushed at the epoch's end.
    ``checkpoint`` names a folder in which every epoch is saved whole (parameters, the
    best ones, the optimiser's state, the log); training goes on from the last of them.
    """
    from clickloom.operators.metrics import roc_auc

    params = {k: v.copy() for k, v in (params or model.shapes.draw(seed)).items()}
    optimiser = optimiser or Optimiser()
    counts = {r["y"]: r["n"] for r in df.groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, pos = sum(counts.values()), counts.get(1, 0)
    skewed = total and not 0.2 <= pos / total <= 0.8 and 0 < pos < total
    weights = [min(max(total / (2 * counts.get(c, 1)), 0.1), 20.0) for c in (0, 1)] if skewed else [1.0, 1.0]
    best, best_params, idle, log = -1.0, params, 0, []
    last = last_checkpoint(df.sparkSession, checkpoint) if checkpoint else None
    if last:
        params, best_params, log = last.params, last.best_params, last.log
        optimiser.state, optimiser.steps = last.state, last.steps
        best = max((x["auc"] for x in log if x["improved"]), default=best)
        idle = next((k for k, x in enumerate(reversed(log)) if x["improved"]), len(log))
    for epoch in range(len(log), epochs if idle < patience else 0):
        scale, lost, held, n_held = schedule(scheduler, epoch, idle), 0.0, None, 0
        for b in range(batches):
            share = df.where(F.pmod(F.xxhash64(key, F.lit(epoch)), F.lit(batches)) == b) if batches > 1 else df
            grads, value, _ = gradient(share, model, params, loss, kg, text, label, weights[1] / weights[0], dropout, seed + epoch * batches + b)
            lost += value / batches
            held = grads if held is None else {k: held[k] + g for k, g in grads.items()}
            n_held += 1
            if n_held == accumulate or b == batches - 1:
                optimiser.step(params, {k: g / n_held for k, g in held.items()}, scale)
                held, n_held = None, 0
        auc = roc_auc(score(valid if valid is not None else df, model, params, kg, text), "logit", label).first()["auc"]
        improved = auc > best + tolerance
        log.append({"epoch": epoch, "loss": lost, "auc": auc, "improved": improved})
        if improved:
            best, best_params, idle = auc, {k: v.copy() for k, v in params.items()}, 0
        else:
            idle += 1
        if checkpoint:
            save_checkpoint(df.sparkSession, Checkpoint(params, best_params, optimiser.state, optimiser.steps, log), checkpoint)
        if idle >= patience:
            break
    return best_params, log


@dataclass
class Checkpoint:
    """All that training needs to go on after an epoch."""

    params: dict[str, np.ndarray]
    best_params: dict[str, np.ndarray]
    state: dict[str, tuple[np.ndarray, np.ndarray]]
    steps: int
    log: list[dict]


def save_checkpoint(spark: SparkSession, at: Checkpoint, folder: str) -> str:
    """Write an epoch's table under ``folder`` and return its path; earlier epochs stay."""
    groups = {"params": at.params, "best": at.best_params, "m": {k: m for k, (m, _) in at.state.items()}, "v": {k: v for k, (_, v) in at.state.items()}}
    path = f"{folder}/epoch={len(at.log):06d}"
    rows = [(g, k, list(v.shape), v.ravel().tolist(), None) for g, values in groups.items() for k, v in values.items()]
    rows.append(("log", str(at.steps), [], [], json.dumps(at.log)))
    spark.createDataFrame(rows, "part string, name string, shape array<int>, data array<double>, log string").write.mode("overwrite").parquet(path)
    return path


def last_checkpoint(spark: SparkSession, folder: str) -> Checkpoint | None:
    """The last epoch that was written whole, or None."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in fs.listStatus(top)) if fs.exists(top) else []
    whole = [n for n in names if exists(spark, f"{n}/_SUCCESS")]
    if not whole:
        return None
    parts: dict[str, dict[str, np.ndarray]] = {"params": {}, "best": {}, "m": {}, "v": {}}
    steps, log = 0, []
    for r in spark.read.parquet(whole[-1]).collect():  # as large as the model
        if r["part"] == "log":
            steps, log = int(r["name"]), json.loads(r["log"])
        else:
            parts[r["part"]][r["name"]] = np.array(r["data"], dtype=float).reshape(r["shape"])
    return Checkpoint(parts["params"], parts["best"], {k: (m, parts["v"][k]) for k, m in parts["m"].items()}, steps, log)


def evaluate(df: DataFrame, model: Model, params: dict[str, np.ndarray], loss: str = "bce_with_logits", kg: str | None = "kg_vec", text: str | None = "text_vec", label: str = "label") -> dict[str, float]:
    """Mean loss and AUC of rows that training hasn't seen, in one pass of the model."""
    from clickloom.functions import vectors
    from clickloom.operators.metrics import roc_auc

    scored = score(df, model, params, kg, text).select("logit", F.col(label).cast("int").alias(label)).persist()
    each = {"bce_with_logits": vectors.bce_with_logits, "focal": vectors.focal_loss, "mse": vectors.squared_error, "smooth_l1": vectors.smooth_l1}[loss]
    mean = scored.agg(F.avg(each(F.col("logit"), F.col(label).cast("double")))).first()[0]
    auc = roc_auc(scored, "logit", label).first()["auc"]
    scored.unpersist()
    return {"loss": mean, "auc": auc}


def save(spark: SparkSession, params: dict[str, np.ndarray], path: str) -> None:
    """Parameters as a table: name, shape, values."""
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in params.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, model: Model | None = None) -> dict[str, np.ndarray]:
    """Parameters of a table; with a model, only those of its names and shapes, the rest drawn anew."""
    got = {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
    if model is None:
        return got
    fresh = model.shapes.draw(42)
    return {k: got[k] if k in got and got[k].shape == v.shape else v for k, v in fresh.items()}


def _graphs(node_rows: DataFrame, edge_rows: DataFrame, key: str) -> DataFrame:
    """(key, nodes, edges): each sample's graph, small, brought together whole."""
    n = node_rows.groupBy(key).agg(F.collect_list(F.struct("entity", "is_core", "features")).alias("nodes"))
    e = edge_rows.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("head", "tail", "weight")).alias("edges"))
    return n.join(e, F.col(key) == F.col("_k"), "left").select(key, "nodes", "edges")


def _arrays(nodes: list[dict], edges: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Features, edge ends, weights and the core's place, nodes by name."""
    nodes, edges = sorted(nodes, key=lambda x: x["entity"]), edges or []
    place = {x["entity"]: k for k, x in enumerate(nodes)}
    src, dst = (np.array([place[x[c]] for x in edges], dtype=int) for c in ("head", "tail"))
    core = next((k for k, x in enumerate(nodes) if x["is_core"]), 0)
    return np.array([x["features"] for x in nodes], dtype=float), src, dst, np.array([x["weight"] for x in edges], dtype=float), core


def train_graph_model(node_rows: DataFrame, edge_rows: DataFrame, labels: DataFrame, epochs: int = 10, optimiser: Optimiser | None = None, seed: int = 42, key: str = "sample_id") -> tuple[dict[str, np.ndarray], list[float]]:
    """Train the attention layers by cross entropy of one logit on the core vector; returns parameters and losses."""
    shapes = gat_shapes()
    gat_head_shapes(shapes)
    params, optimiser, losses = shapes.draw(seed), optimiser or Optimiser(rate=5e-3), []
    names = [n for n in params if not n.endswith((".mean", ".var"))]
    graphs = _graphs(node_rows, edge_rows, key).join(labels.select(key, F.col("label").cast("double").alias("y")), key).select("nodes", "edges", "y").persist()
    for _ in range(epochs):
        sent = node_rows.sparkSession.sparkContext.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, lost, rows = None, 0.0, 0
            for b in batches:
                for nodes, edges, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    p = {n: Var(v) for n, v in sent.value.items()}
                    logit = gat_logit(p, gat_core_var(p, *_arrays(nodes, edges)))
                    out = loss_of("bce_with_logits", logit.reshape(-1), np.array([y]))
                    out.backward()
                    g = np.concatenate([(p[n].grad if p[n].grad is not None else np.zeros_like(p[n].value)).ravel() for n in names])
                    total, lost, rows = (g if total is None else total + g), lost + float(out.value), rows + 1
            if rows:
                g = np.concatenate([total, [lost, rows]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(g))), pa.array(g)], names=["place", "g"])

        got = graphs.mapInArrow(run, "place long, g double").groupBy("place").agg(F.sum("g").alias("g")).orderBy("place").toPandas()["g"].to_numpy()  # as large as the model
        at, grads = 0, {}
        for name in names:
            grads[name] = got[at : at + params[name].size].reshape(params[name].shape) / got[-1]
            at += params[name].size
        losses.append(float(got[-2] / got[-1]))
        optimiser.step(params, grads)
    graphs.unpersist()
    return params, losses


def graph_vectors(node_rows: DataFrame, edge_rows: DataFrame, params: dict[str, np.ndarray] | None = None, key: str = "sample_id", double: bool = False) -> DataFrame:
    """(key, vec) of each sample's graph: two attention layers, the core node, unit length.

    ``node_rows`` has entity, is_core and features; a graph without edges is its
    placeholder node (``graph.node_features`` adds it).
    """
    sent = node_rows.sparkSession.sparkContext.broadcast(params or gat_shapes().draw(42))
    both = _graphs(node_rows, edge_rows, key)
    schema = T.StructType([node_rows.schema[key], T.StructField("vec", T.ArrayType(T.DoubleType() if double else T.FloatType()))])
    kind = (np.float64, pa.float64()) if double else (np.float32, pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {k: var(v) for k, v in sent.value.items()}
        for b in batches:
            out = []
            for nodes, edges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out.append(gat_core(p, *_arrays(nodes, edges)).astype(kind[0]).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(kind[1]))], names=schema.names)

    return both.mapInArrow(run, schema)


def _side_by_side(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, edge ends, weights and core places of whole graphs that lie one after another."""
    first = rows["edges"].is_valid().to_numpy()
    of_node, starts = np.cumsum(first) - 1, np.flatnonzero(first)
    lists = rows["edges"].drop_null().combine_chunks()
    edges, of_edge = lists.flatten(), np.repeat(np.arange(len(starts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    names = pa.chunked_array([*rows["entity"].chunks, edges.field("head"), edges.field("tail")]).combine_chunks().dictionary_encode()
    codes, n, m = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows.num_rows, len(edges)
    known = of_node * len(names.dictionary) + codes[:n]
    order = np.argsort(known)
    src, dst = (order[np.searchsorted(known, of_edge * len(names.dictionary) + c, sorter=order)] for c in (codes[n : n + m], codes[n + m :]))
    is_core = rows["is_core"].fill_null(False).to_numpy()
    cores = starts.copy()
    marked = np.flatnonzero(is_core)[::-1]
    cores[of_node[marked]] = marked
    x = rows["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
    return x, src, dst, edges.field("weight").to_numpy(zero_copy_only=False).astype(float), cores


def graph_vectors_in_rows(node_rows: DataFrame, params: dict[str, np.ndarray] | None = None, key: str = "sample_id", double: bool = False) -> DataFrame:
    """What ``graph_vectors`` gives, from ``graph.features_in_rows(..., with_edges=True)``: no row moves, and all graphs of a batch go through the layers at once."""
    params = params or gat_shapes().draw(42)
    sent, width = node_rows.sparkSession.sparkContext.broadcast(params), len(params["bn1.mean"])
    schema = T.StructType([node_rows.schema[key], T.StructField("vec", T.ArrayType(T.DoubleType() if double else T.FloatType()))])
    kind = pa.float64() if double else pa.float32()

    def vectors(rows: pa.Table) -> pa.RecordBatch:
        got = gat_cores(sent.value, *_side_by_side(rows, width))
        keys = rows[key].filter(rows["edges"].is_valid()).combine_chunks()
        values = pa.array(got.ravel().astype(kind.to_pandas_dtype()), kind)
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(np.arange(0, got.size + 1, got.shape[1], dtype=np.int32), values)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # a graph may go on in the next batch
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            begun = np.flatnonzero(rows["edges"].is_valid().to_numpy())
            if len(begun) and begun[-1]:
                yield vectors(rows.slice(0, begun[-1]))
                rows = rows.slice(begun[-1])
            rest = rows
        if rest is not None and rest.num_rows:
            yield vectors(rest)

    return node_rows.select(key, "entity", "is_core", "features", "edges").mapInArrow(run, schema)
