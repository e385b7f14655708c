"""Connected components of an edge table by alternating large and small stars.

Each round is a minimum by key and a join, both distributed; labels shrink to the
least node of the component in a logarithmic number of rounds. Nothing is
collected but one checksum a round, and every round's edges are written to the
shared folder, so lineage stays short without local checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickloom.llm._shared import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _beside(edges: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """The least of every ``u``, and the edges with it.

    The least of many nodes is written, so that both sides of the join are shuffled
    for it alone and adaptive execution splits a centre with very many edges.
    """
    least = _least(edges) if small else materialize(_least(edges), "least")
    return least, edges.join(F.broadcast(least) if small else least, "u")


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    _, linked = _beside(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), small)
    return linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    least, linked = _beside(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), small)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, broadcast_keys: int = 1_000_000) -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    ``edges`` has columns ``a`` and ``b``; loops, repeats and either direction are
    fine, nulls are dropped, and no edges give no rows.
    """
    current = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null and u != v").distinct()
    current, before = materialize(current, "edges"), None
    for _ in range(max_rounds):
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        now = (state["n"], state["h"])
        if now == before or not now[0]:
            break
        before = now
        small = 2 * now[0] <= broadcast_keys  # rows of what is broadcast, at most
        half = _large_star(current, small)
        current, old = materialize(_small_star(half if small else materialize(half, "edges"), small), "edges"), current
        discard(old)
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
