"""Graph attention by joins, against the formulas and the numpy network."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.models import layers
from clickloom.models.autodiff import Var
from clickloom.operators import attention

NODES = "extra int, sample_id long, entity string, features array<double>"
EDGES = "sample_id long, head string, tail string, weight double, entity string"


def brute(nodes, edges, w, a, residual, slope=0.2):
    heads, width = a.shape[0], a.shape[1] // 2
    x = {(s, e): np.array(v) for s, e, v in nodes if v is not None}
    out = {k: v @ residual[0] + residual[1] if residual else v.copy() for k, v in x.items()}
    sums = {}
    for s, h, t, wt in edges:
        if wt is None or (s, h) not in x or (s, t) not in x:
            continue
        a_h, a_t = ((x[s, n] @ w).reshape(heads, width) for n in (h, t))
        raw = (np.concatenate([a_h, a_t], axis=1) * a).sum(1)
        e = np.exp(np.where(raw >= 0, raw, raw * slope) * wt)
        total, message = sums.get((s, t), (0, 0))
        sums[s, t] = total + e, message + e[:, None] * a_h
    for k, (total, message) in sums.items():
        out[k] = out[k] + (message / (total[:, None] + 1e-8)).reshape(-1)
    return out


@pytest.mark.parametrize("hub_edges", [1 << 16, 1, 7])
@pytest.mark.parametrize("same_width", [False, True])
def test_layer_equals_brute_force(spark, hub_edges, same_width):
    r = random.Random(6)
    draw = np.random.default_rng(2)
    n_in = 6 if same_width else 4
    w, a = draw.normal(size=(n_in, 6)), draw.normal(size=(3, 4))
    residual = None if same_width else (draw.normal(size=(4, 6)), draw.normal(size=6))
    nodes = [(s, f"n{k}", draw.normal(size=n_in).tolist()) for s in range(3) for k in range(12)] + [(5, "alone", [1.0] * n_in), (5, "blank", None)]
    edges = [(r.randrange(3), f"n{r.randrange(12)}", r.choice(["n0", f"n{r.randrange(12)}"]), r.choice([0.5, 1.0])) for _ in range(300)]
    edges += [(0, "n1", "n2", None), (0, "n1", "gone", 1.0), (0, "gone", "n1", 1.0), (5, "alone", "alone", 1.0), (5, "blank", "alone", 1.0)] + [(1, "n3", "n4", 0.25)] * 50
    nd = spark.createDataFrame([(0, *n) for n in nodes], NODES)
    ed = spark.createDataFrame([(*e, "x") for e in edges] + [(None, "n1", "n2", 1.0, "x"), (0, None, "n2", 1.0, "x")], EDGES)
    got = {(x["sample_id"], x["entity"]): x["features"] for x in attention.attention_layer(nd, ed, w, a, residual, hub_edges=hub_edges).collect()}
    want = brute(nodes, edges, w, a, residual)
    assert got.pop((5, "blank")) is None and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12) for k in want)


def test_core_vectors_equal_the_network(spark):
    shapes = layers.gat_shapes(5, 3, 2, 4)
    params = shapes.draw(3)
    draw = np.random.default_rng(7)
    params = {k: draw.uniform(0.5, 1.5, v.shape) if k.endswith(".var") else v + draw.normal(size=v.shape) * 0.1 for k, v in params.items()}
    nodes, edges, want = [], [], {}
    for s in range(4):
        x = draw.normal(size=(6, 5))
        src, dst = draw.integers(0, 6, 3 * s), draw.integers(0, 6, 3 * s)
        weight = draw.choice([0.5, 1.0, 2.0], 3 * s)
        nodes += [(s, f"n{k}", k == 2, x[k].tolist()) for k in range(6)]
        edges += [(s, f"n{h}", f"n{t}", float(v)) for h, t, v in zip(src, dst, weight, strict=True)]
        want[s] = layers.gat_core({k: Var(v) for k, v in params.items()}, x, src, dst, weight, 2)
    nd = spark.createDataFrame(nodes, "sample_id long, entity string, is_core boolean, features array<double>")
    found = attention.core_vectors(nd, spark.createDataFrame(edges, "sample_id long, head string, tail string, weight double"), params)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("InArrow", "InPandas", "EvalPython"))
    got = {r["sample_id"]: r["features"] for r in found.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-8, atol=1e-10) for k in want)


def test_no_edges_and_no_nodes(spark):
    w, a = np.eye(2), np.ones((1, 4))
    nodes = spark.createDataFrame([(0, 1, "x", [1.0, 2.0])], NODES)
    none = spark.createDataFrame([], EDGES)
    assert attention.attention_layer(nodes, none, w, a).first()["features"] == [1.0, 2.0]
    assert attention.attention_layer(nodes.where("false"), none, w, a).count() == 0
    with pytest.raises(ValueError, match="shapes"):
        attention.attention_layer(nodes, none, np.ones((2, 3)), a)


def test_a_node_with_a_million_edges_is_many_tasks(spark):
    n = 1_000_000
    ids = spark.range(n)
    nodes = ids.select(F.lit(1).cast("long").alias("sample_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("entity"), F.array(F.col("id") % 5 / F.lit(5.0), F.lit(1.0)).alias("features"))
    edges = ids.select(F.lit(1).cast("long").alias("sample_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("head"), F.lit("n0").alias("tail"), F.lit(1.0).alias("weight"))
    w, a = np.array([[1.0, 0.5], [0.0, 1.0]]), np.array([[0.3, 0.1], [-0.2, 0.4]])
    layer = attention.attention_layer(nodes, edges, w, a, hub_edges=1 << 14).where("entity = 'n0'").first()["features"]
    few = [(1, f"n{k}", [k / 5, 1.0]) for k in range(5)]
    want = brute(few, [(1, f"n{k}", "n0", 1.0) for k in range(5)] * 10, w, a, None)[1, "n0"]
    assert np.allclose(layer, want, rtol=1e-8)


def test_edges_move_twice_and_nodes_are_not_broadcast(spark, monkeypatch):
    draw = np.random.default_rng(4)
    w, a, residual = draw.normal(size=(3, 4)), draw.normal(size=(2, 4)), (draw.normal(size=(3, 4)), draw.normal(size=4))
    nodes = [(1, f"n{k}", draw.normal(size=3).tolist()) for k in range(40)]
    edges = [(1, f"n{h}", f"n{t}", 0.5) for h, t in draw.integers(0, 40, (500, 2)).tolist()]
    want = brute(nodes, edges, w, a, residual)
    nd, ed = spark.createDataFrame([(0, *n) for n in nodes], NODES), spark.createDataFrame([(*e, "x") for e in edges], EDGES)
    for room in (1 << 26, 0):
        monkeypatch.setattr(attention, "HASHED_BYTES", room, raising=False)
        found = attention.attention_layer(nd, ed, w, a, residual)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 5  # edges twice, nodes at either end and last
        assert "Broadcast" not in plan and ("Sort [" in plan) == (room == 0)
        got = {(x["sample_id"], x["entity"]): x["features"] for x in found.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12) for k in want)


def test_hubs_are_exact_and_equal_edges_are_dealt(spark, tmp_path):
    r = random.Random(8)
    rows = [(s, "h", f"n{r.randrange(1 << r.randrange(1, 9))}", 1.0) for s in range(3) for _ in range(2000)]
    path = str(tmp_path / "edges")
    spark.createDataFrame(rows, "sample_id long, head string, tail string, weight double").coalesce(2).write.parquet(path)
    edges = spark.read.parquet(path)
    for most in (1, 30, 100, 2000, 5000):
        for end, place in (("head", 1), ("tail", 2)):
            counts = Counter((x[0], x[place]) for x in rows)
            found = attention._hubs(edges, end, "sample_id", most, len(rows))
            assert {tuple(x) for x in found.collect()} == {(*k, -(-n // most)) for k, n in counts.items() if n > most}
    dealt = attention._deal(edges, attention._hubs(edges, "head", "sample_id", 500, len(rows)), "head", "sample_id")
    assert {x["_head_salt"] for x in dealt.where("tail = 'n0'").select("_head_salt").distinct().collect()} == {0, 1, 2, 3}
    assert dealt.count() == len(rows) and max(x["count"] for x in dealt.groupBy("sample_id", "_head_salt").count().collect()) < 650
