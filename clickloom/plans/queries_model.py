"""Queries of vectors, losses, metrics and model forward passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import vectors
from clickloom.models import embed, layers, run
from clickloom.operators import metrics, quality
from clickloom.plans import sql_network
from clickloom.plans.stand_ins import SAMPLES, samples, table

WIDTH = 64


def vec_l2(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalise(F.col("embedding"))).alias("pos", "x"))
    return e.select("vec_id", "pos", F.round("x", 9).alias("x"))


L2 = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum([x * x for x in v])) AS n FROM e) SELECT vec_id, unnest(range(len(v)))::INTEGER AS pos, round(unnest([x / (n + 1e-8::DOUBLE) for x in v]), 9) AS x FROM n"


def vec_clamp(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.clamp(F.col("embedding"), -0.1, 0.1)).alias("pos", "x"))


def _sequences(spark, d):
    """Eight 'tokens' of eight numbers from each vector, with a mask from the label."""
    e = table(spark, d, "embeddings")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < F.col("label"), 1.0).otherwise(0.0))
    return e.select("vec_id", tokens.alias("tokens"), mask.alias("mask"))


def vec_mean_pool(spark, d):
    pooled = vectors.masked_mean(F.col("tokens"), F.col("mask"), 8)
    return _sequences(spark, d).select("vec_id", F.posexplode(pooled).alias("pos", "x")).select("vec_id", "pos", F.round("x", 9).alias("x"))


MEAN_POOL = "SELECT vec_id, i::INTEGER AS pos, round(coalesce(list_sum([embedding[(t * 8 + i + 1)::BIGINT]::DOUBLE for t in range(least(label, 8))]), 0) / greatest(least(label, 8), 1e-9::DOUBLE), 9) AS x FROM embeddings, range(8) r(i)"


def vec_last_pool(spark, d):
    return _sequences(spark, d).select("vec_id", F.posexplode(vectors.last_pool(F.col("tokens"), F.col("mask"))).alias("pos", "x")).select("vec_id", "pos", F.col("x").cast("double").alias("x"))


LAST_POOL = "SELECT vec_id, i::INTEGER AS pos, embedding[((CASE WHEN label > 0 THEN least(label, 8) ELSE 8 END - 1) * 8 + i + 1)::BIGINT]::DOUBLE AS x FROM embeddings, range(8) r(i)"


def vec_cosine(spark, d):
    """Of each vector's halves."""
    v, q = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.dot(v, q) / F.sqrt(vectors.dot(v, v) * vectors.dot(q, q)), 9).alias("cosine"))


COSINE = "WITH h AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS v, embedding[33:64]::DOUBLE[] AS q FROM embeddings) SELECT vec_id, round(list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q)), 9) AS cosine FROM h"


def _scored(spark, d):
    """Labels with a logit that leans towards them."""
    x = (F.col("doc_id") * 7919) % 1000 / F.lit(250.0) - 2 + F.col("quality") * 0.75
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), x.alias("logit"))


SCORED = "scored AS (SELECT doc_id, quality AS label, (doc_id * 7919) % 1000 / 250.0::DOUBLE - 2 + quality * 0.75::DOUBLE AS logit FROM labels)"


def class_weights(spark, d):
    return quality.class_weights(_scored(spark, d), "label")


def _losses(spark, d):
    z, y = F.col("logit"), F.col("label")
    return _scored(spark, d).select("doc_id", vectors.bce_with_logits(z, y, 2.0).alias("bce"), vectors.focal_loss(z, y).alias("focal"), vectors.squared_error(z, y).alias("mse"), vectors.smooth_l1(z, y).alias("smooth_l1"))


def bce_loss(spark, d):
    return _losses(spark, d).select("doc_id", F.round("bce", 9).alias("bce"))


def focal_loss(spark, d):
    return _losses(spark, d).select("doc_id", F.round("focal", 9).alias("focal"))


def mean_losses(spark, d):
    return _losses(spark, d).agg(F.round(F.avg("mse"), 9).alias("mse"), F.round(F.avg("smooth_l1"), 9).alias("smooth_l1"))


_SOFT = "(ln(1 + exp(-abs(logit))) + greatest(-logit, 0))"


def auc_exact(spark, d):
    return metrics.roc_auc(_scored(spark, d), "logit", "label").withColumn("auc", F.round("auc", 9))


AUC = f"""WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY logit) + (count(*) OVER (PARTITION BY logit) - 1) / 2.0::DOUBLE AS r FROM scored),
s AS (SELECT sum(label)::BIGINT AS n_pos, count(*) - sum(label)::BIGINT AS n_neg, sum(r) FILTER (label = 1) AS rs FROM r)
SELECT n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg), 9) AS auc FROM s"""


def threshold_confusion(spark, d):
    return metrics.confusion(_scored(spark, d), vectors.sigmoid(F.col("logit")), F.col("label"))


def early_stop_trace(spark, d):
    series = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("epoch")).agg(F.max("value").alias("metric"))
    return metrics.early_stopping(series, "epoch", "metric", ["event_type"]).withColumn("epoch", F.col("epoch").cast("string"))


EARLY = """WITH RECURSIVE s AS (SELECT event_type, ts::DATE AS epoch, max(value) AS metric FROM events GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY epoch) AS k FROM s),
f AS (SELECT event_type, epoch, metric, k, NULL::DOUBLE AS best_before, true AS improved, 0 AS idle, metric AS best FROM o WHERE k = 1
  UNION ALL SELECT o.event_type, o.epoch, o.metric, o.k, f.best, o.metric > f.best + 1e-4::DOUBLE, CASE WHEN o.metric > f.best + 1e-4::DOUBLE THEN 0 ELSE f.idle + 1 END, CASE WHEN o.metric > f.best + 1e-4::DOUBLE THEN o.metric ELSE f.best END FROM f JOIN o ON o.event_type = f.event_type AND o.k = f.k + 1)
SELECT event_type, epoch::VARCHAR AS epoch, metric, best_before, improved, idle::INTEGER AS idle_epochs FROM f"""

FACTORS = [[((i * 7 + f * 3) % 11 - 5) / 10 for f in range(3)] for i in range(WIDTH)]


def fm_second_order(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.fm_second_order(F.col("embedding"), FACTORS), 9).alias("fm"))


_FM_PARTS = " + ".join(f"(pow(list_sum([embedding[i]::DOUBLE * ((((i - 1) * 7 + {f * 3}) % 11 - 5) / 10.0::DOUBLE) for i in range(1, 65)]), 2) - list_sum([pow(embedding[i]::DOUBLE * ((((i - 1) * 7 + {f * 3}) % 11 - 5) / 10.0::DOUBLE), 2) for i in range(1, 65)]))" for f in range(3))


def _forward(fusion, head="mlp_final", mode="kg_text_fusion", hidden=32):
    """A query and its SQL: weights by formula, over each vector's halves."""
    options = {"hidden": hidden} | ({"heads": 4} if fusion != "concat" else {})
    model = layers.ctr_model(32, 32, mode, fusion, head, fusion_options=options)

    def query(spark, d):
        e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("kg_vec"), F.slice("embedding", 33, 32).alias("text_vec"))
        scored = run.score(e, model, sql_network.formula_parameters(model))
        return scored.select("vec_id", F.round("logit", 6).alias("logit"), F.round(vectors.sigmoid(F.col("logit")), 6).alias("probability"))

    return query, sql_network.forward_sql(model, fusion, head, mode, hidden, 4)


_GATE = layers.gate_model(WIDTH)


def feature_gate(spark, d):
    """x sigmoid(W2 swish(W1 x)) by the layer itself, weights by formula."""
    e = run.apply_model(table(spark, d, "embeddings").select("vec_id", "embedding"), _GATE, sql_network.formula_parameters(_GATE), "embedding", "gated")
    return e.select("vec_id", F.posexplode("gated").alias("pos", "x")).select("vec_id", "pos", F.round("x", 9).alias("x"))


def _gate_sql():
    net = sql_network.Network(_GATE, "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings")
    gated = sql_network.gate(net, "gate", "v", WIDTH)
    return net.sql(f"vec_id, unnest(range({WIDTH}))::INTEGER AS pos, round(unnest({gated}), 9) AS x")


def text_vectors(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "text")
    return embed.embed_texts(docs, embed.hashed_provider(32))


_GRAPH = layers.Model(layers.gat_shapes(hidden=4, heads=2, n_out=8), lambda: None)


def graph_vectors(spark, d):
    """Core vectors of a small graph model, weights by formula."""
    from clickloom.operators import graph
    from clickloom.plans.queries_graph import _triples

    found = _triples(spark, d)
    nodes = graph.features_in_rows(found, F.concat(F.lit("product_"), F.col("asin").cast("string")), F.array_repeat(F.lit(0.1), 32), with_edges=True)
    vec = run.graph_vectors_in_rows(nodes, sql_network.formula_parameters(_GRAPH), double=True)
    return vec.select("sample_id", F.posexplode("vec").alias("pos", "x")).select("sample_id", "pos", F.round("x", 6).alias("x"))


def _graph_sql():
    from clickloom.plans.queries_graph import DEGREE_CTE, WEIGHT_SQL

    bytes_of = "[('0x' || substr(sha256(regexp_extract(entity, '[^_]*$')), 2 * i + 1, 2))::BIGINT / 255.0::DOUBLE for i in range(32)]"
    ones = lambda test, n, value="1.0::DOUBLE": f"[CASE WHEN {test} THEN {value} ELSE 0.0::DOUBLE END for i in range({n})]"
    core = "entity = 'product_' || asin"
    features = f"""{DEGREE_CTE.replace("edges AS (", "triple_edges AS (").replace("FROM edges)", "FROM triple_edges)")},
und AS (SELECT DISTINCT sample_id, head AS x, tail AS y FROM triple_edges WHERE head <> tail UNION SELECT DISTINCT sample_id, tail, head FROM triple_edges WHERE head <> tail),
nd AS (SELECT sample_id, x AS entity, count(*) AS d FROM und GROUP BY ALL),
tri AS (SELECT p.sample_id, p.x AS entity, count(*) AS t2 FROM und p JOIN und q ON p.sample_id = q.sample_id AND p.y = q.x JOIN und z ON z.sample_id = p.sample_id AND z.x = q.y AND z.y = p.x GROUP BY ALL),
clus AS (SELECT sample_id, entity, CASE WHEN d > 1 THEN coalesce(t2, 0) / (d * (d - 1)) ELSE 0 END AS c FROM nd LEFT JOIN tri USING (sample_id, entity)),
n0 AS (SELECT g.sample_id, entity, {core} AS is_core, list_concat(list_concat(list_concat({ones("starts_with(entity, 'user_')", 16)}, {ones("starts_with(entity, 'product_')", 16)}), {bytes_of}), list_concat({ones(core, 32, "0.1::DOUBLE")}, [in_share, out_share, coalesce(c, 0), centrality])) AS x FROM deg g JOIN base USING (sample_id) LEFT JOIN clus USING (sample_id, entity)),
edges AS (SELECT sample_id, head, tail, {WEIGHT_SQL} AS w FROM triple_edges)"""
    return sql_network.graph_sql(_GRAPH, features)


def history_features(spark, d):
    """Per user: samples, positives and mean history length."""
    return samples(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_pos"), F.round(F.avg(F.size("history").cast("double")), 9).alias("mean_history"))


QUERIES = {
    "vec_l2": (vec_l2, L2),
    "vec_clamp": (vec_clamp, "SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos, unnest([greatest(least(x::DOUBLE, 0.1::DOUBLE), -0.1::DOUBLE) for x in embedding]) AS x FROM embeddings"),
    "vec_mean_pool": (vec_mean_pool, MEAN_POOL),
    "vec_last_pool": (vec_last_pool, LAST_POOL),
    "vec_cosine": (vec_cosine, COSINE),
    "class_weights": (class_weights, f"WITH {SCORED}, c AS (SELECT label, count(*) AS n_rows FROM scored WHERE label IS NOT NULL GROUP BY label), t AS (SELECT sum(n_rows) AS n, count(*) AS k FROM c) SELECT label, n_rows, CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE greatest(least(n / (k * n_rows), 20), 0.1) END::DOUBLE AS weight FROM c, t"),
    "bce_loss": (bce_loss, f"WITH {SCORED} SELECT doc_id, round((1 - label) * logit + (1 + label) * {_SOFT}, 9) AS bce FROM scored"),
    "focal_loss": (focal_loss, f"WITH {SCORED}, b AS (SELECT doc_id, (1 - label) * logit + {_SOFT} AS b FROM scored) SELECT doc_id, round(0.25::DOUBLE * pow(1 - exp(-b), 2) * b, 9) AS focal FROM b"),
    "mean_losses": (mean_losses, f"WITH {SCORED} SELECT round(avg(pow(logit - label, 2)), 9) AS mse, round(avg(CASE WHEN abs(logit - label) < 1 THEN pow(logit - label, 2) * 0.5::DOUBLE ELSE abs(logit - label) - 0.5::DOUBLE END), 9) AS smooth_l1 FROM scored"),
    "auc_exact": (auc_exact, AUC),
    "threshold_confusion": (threshold_confusion, f"WITH {SCORED} SELECT label, (1 / (1 + exp(-logit)) >= 0.5)::INTEGER AS predicted, count(*) AS n_rows FROM scored GROUP BY ALL"),
    "early_stop_trace": (early_stop_trace, EARLY),
    "fm_second_order": (fm_second_order, f"SELECT vec_id, round(0.5::DOUBLE * ({_FM_PARTS}), 9) AS fm FROM embeddings"),
    "feature_gate": (feature_gate, _gate_sql()),
    "fusion_concat_forward": _forward("concat"),
    "cross_attention_forward": _forward("cross_attention_gated"),
    "cross_modal_forward": _forward("cross_modal_interaction", "cross_modal_fm", hidden=64),
    "cross_fm_forward": _forward("concat", "dcnv3_fm"),
    "only_kg_forward": _forward("concat", "mlp_final", "only_kg"),
    "only_text_forward": _forward("concat", "dcnv3_fm", "only_text"),
    "text_vectors": (text_vectors, None),
    "graph_vectors": (graph_vectors, _graph_sql()),
    "history_features": (history_features, f"WITH {SAMPLES} SELECT user_id, count(*) AS n_rows, sum(label)::BIGINT AS n_pos, round(avg(len(history)::DOUBLE), 9) AS mean_history FROM samples GROUP BY user_id"),
}
