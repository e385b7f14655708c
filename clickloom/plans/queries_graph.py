"""Queries of the knowledge graph."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from clickloom.functions.entities import RELATION_WEIGHTS, entity_hash, entity_type
from clickloom.operators import attention, graph
from clickloom.plans.stand_ins import SAMPLES, samples, table
from clickloom.sources import chat_endpoint


def _triples(spark, d):
    """sample_id, domain, split, source text, and the triples that the rule extractor finds."""
    rows = samples(spark, d)
    split = F.when(F.col("sample_id") % 10 == 9, "test").when(F.col("sample_id") % 10 == 8, "valid").otherwise("train")
    domain = F.concat(F.lit("d"), (F.col("asin") % 3).cast("string"))
    found = rows.select("sample_id", "user_id", "asin", domain.alias("domain"), split.alias("split"), graph.rule_triples(rows, F.col("history")).alias("triples"))
    return found.withColumn("triples", F.filter("triples", lambda t: (F.col("split") != "test") | ~t["relation"].isin(*graph.TEST_FORBIDDEN)))


TRIPLES = f"""{SAMPLES}, base AS (SELECT sample_id, user_id, asin, 'd' || (asin % 3) AS domain, CASE sample_id % 10 WHEN 9 THEN 'test' WHEN 8 THEN 'valid' ELSE 'train' END AS split, title, brand, price, category, history FROM samples),
raw AS (
  SELECT sample_id, domain, split, 'product_' || asin AS head, 'has_title' AS relation, title AS tail, 1 AS pos FROM base UNION ALL
  SELECT sample_id, domain, split, 'product_' || asin, 'has_brand', brand, 2 FROM base UNION ALL
  SELECT sample_id, domain, split, 'product_' || asin, 'has_price', price::VARCHAR, 3 FROM base UNION ALL
  SELECT sample_id, domain, split, 'product_' || asin, 'belongs_to_category', category, 4 FROM base UNION ALL
  SELECT sample_id, domain, split, 'user_' || user_id, 'click_history_id', 'product_' || unnest(history), 4 + unnest(range(1, len(history) + 1)) FROM base WHERE split <> 'test'),
triples AS (SELECT * FROM raw WHERE tail IS NOT NULL AND lower(trim(tail)) NOT IN ('', 'nan', 'none', 'unknown'))"""


def kg_triples_rule(spark, d):
    return _triples(spark, d).select("sample_id", F.posexplode("triples").alias("pos", "t")).select("sample_id", "pos", "t.*")


RULE = f"WITH {TRIPLES} SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1)::INTEGER AS pos, head, relation, tail FROM triples"


def _even_source():
    """A source that names the user and only the even products of the history."""
    named = F.filter(F.transform("triples", lambda t: t["tail"]), lambda x: F.regexp_like(x, F.lit("^product_[0-9]*[02468]$")))
    return F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(" saw product_"), F.col("asin").cast("string"), F.lit(" and "), F.array_join(named, ", "))


def kg_validation_stats(spark, d):
    rows = _triples(spark, d)
    return graph.validation_stats(rows.withColumn("valid", graph.validate(F.col("triples"), _even_source())), "triples", "valid", ["split"])


def kg_validate(spark, d):
    rows = _triples(spark, d)
    each = rows.select("sample_id", F.explode(graph.verdicts(F.col("triples"), _even_source())).alias("v"))
    return each.groupBy("sample_id", "v.valid", "v.reason").agg(F.count(F.lit(1)).alias("n_triples"))


VALIDATE = f"""WITH {TRIPLES}, judged AS (SELECT t.sample_id, NOT (t.relation = 'click_history_id' AND regexp_matches(t.tail, '[13579]$') AND t.tail <> 'product_' || b.asin) AS valid FROM triples t JOIN base b USING (sample_id))
SELECT sample_id, valid, CASE WHEN valid THEN 'grounded' ELSE 'id not in text' END AS reason, count(*) AS n_triples FROM judged GROUP BY ALL"""


VALIDATION_STATS = f"""WITH {TRIPLES}, judged AS (SELECT t.split, NOT (t.relation = 'click_history_id' AND regexp_matches(t.tail, '[13579]$') AND t.tail <> 'product_' || b.asin) AS valid FROM triples t JOIN base b USING (sample_id))
SELECT split, count(*) AS n_candidates, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_invalid FROM judged GROUP BY split"""


def _answering():
    """A stand-in for a model: answers in fences, and every third time with something that isn't JSON."""

    def ask(prompt: str) -> str:
        number, brand, kind = prompt.split("|")
        told = [{"head": f"product_{number}", "relation": r, "tail": t} for r, t in (("has_brand", brand), ("has_category", kind), ("broken", None))]
        return "sorry" if int(number) % 3 == 0 else f"```json\n{json.dumps(told)}\n```"

    return ask


def triples_udtf(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.concat_ws("|", F.col("p_partkey").cast("string"), "p_brand", "p_type").alias("prompt"))
    part = part.repartition(4 * spark.sparkContext.defaultParallelism)  # the metadata is a file of few row groups, Python's work is by the row
    extract = chat_endpoint.triples_udtf(_answering)
    return part.lateralJoin(extract(F.col("prompt").outer())).drop("prompt")


def kg_scenario_complete(spark, d):
    done = _triples(spark, d).select("sample_id", F.explode(graph.complete_scenarios(F.col("triples"), F.col("domain"))).alias("t")).select("sample_id", "t.*")
    return done.where("relation = 'belongs_to_scenario'")


SCENARIO = f"WITH {TRIPLES} SELECT DISTINCT sample_id, head, 'belongs_to_scenario' AS relation, 'scenario_' || domain AS tail FROM triples WHERE starts_with(head, 'user_')"


def kg_title_complete(spark, d):
    source = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("product_"), i.cast("string"), F.lit(" title: T"), i.cast("string"), F.lit(" "))), " ")
    done = _triples(spark, d).select("sample_id", F.explode(graph.complete_titles(F.col("triples"), source)).alias("t")).select("sample_id", "t.*")
    return done.where("relation = 'has_title' and tail rlike '^T[0-9]+$'")


TITLES = f"WITH {TRIPLES} SELECT DISTINCT sample_id, tail AS head, 'has_title' AS relation, 'T' || substr(tail, 9) AS tail FROM triples t WHERE relation = 'click_history_id' AND NOT EXISTS (SELECT 1 FROM triples x WHERE x.sample_id = t.sample_id AND x.relation = 'has_title' AND x.head = t.tail)"


def kg_relation_hist(spark, d):
    return graph.relation_histogram(_triples(spark, d))


def kg_chunk_stats(spark, d):
    return graph.chunk_stats(_triples(spark, d), ["domain", "split"])


STATS = f"""WITH {TRIPLES}, per AS (SELECT b.sample_id, b.domain, b.split, count(t.head) AS n FROM base b LEFT JOIN triples t USING (sample_id) GROUP BY ALL)
SELECT domain, split, count(*) AS n_chunks, count(*) FILTER (n > 0) AS n_with, count(*) FILTER (n = 0) AS n_without, sum(n)::BIGINT AS n_triples FROM per GROUP BY ROLLUP (domain, split)"""


def kg_users(spark, d):
    return graph.distinct_users(_triples(spark, d))


def _edges(spark, d):
    return graph.edges(_triples(spark, d))


EDGES = f"{TRIPLES}, edges AS (SELECT sample_id, head, relation, tail FROM triples)"


def kg_edge_weight(spark, d):
    return _edges(spark, d).groupBy("relation", "weight").agg(F.count(F.lit(1)).alias("n_edges"))


WEIGHT_SQL = "CASE lower(relation) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in RELATION_WEIGHTS.items()) + " ELSE 0.5::DOUBLE END"


def kg_degree(spark, d):
    return graph.degrees(_edges(spark, d))


DEGREE_CTE = f"""{EDGES}, ends AS (SELECT sample_id, head AS entity, 0 AS i, 1 AS o FROM (SELECT DISTINCT sample_id, head, tail FROM edges) UNION ALL SELECT sample_id, tail, 1, 0 FROM (SELECT DISTINCT sample_id, head, tail FROM edges)),
per AS (SELECT sample_id, entity, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM ends GROUP BY ALL),
deg AS (SELECT sample_id, entity, n_in, n_out, n_in / max(n_in + n_out) OVER w AS in_share, n_out / max(n_in + n_out) OVER w AS out_share, CASE WHEN count(*) OVER w > 1 THEN (n_in + n_out) / (count(*) OVER w - 1) ELSE 1.0 END AS centrality FROM per WINDOW w AS (PARTITION BY sample_id))"""


def kg_clustering(spark, d):
    """Over the interaction graph of each user's day: items clicked one after another, and each day's first and last."""
    from pyspark.sql import Window

    from clickloom.plans.stand_ins import interactions

    rows = interactions(spark, d).withColumn("sample_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM")))
    w = Window.partitionBy("sample_id").orderBy("ts", "src_idx")
    item = lambda k: F.concat(F.lit("product_"), F.lag("item", k).over(w).cast("string"))
    near = rows.select("sample_id", F.concat(F.lit("product_"), F.col("item").cast("string")).alias("head"), item(1).alias("a"), item(2).alias("b"))
    two = near.select("sample_id", "head", F.explode(F.array("a", "b")).alias("tail")).where("tail is not null")
    return graph.clustering(two)


CLUSTERING = """WITH r AS (SELECT user_id || '-' || strftime(ts, '%Y-%m') AS sample_id, 'product_' || json_extract_string(props, '$.k') AS item, ts, event_id FROM events),
l AS (SELECT sample_id, item AS head, lag(item, 1) OVER w AS a, lag(item, 2) OVER w AS b FROM r WINDOW w AS (PARTITION BY sample_id ORDER BY ts, event_id)),
e AS (SELECT sample_id, head, a AS tail FROM l WHERE a IS NOT NULL UNION ALL SELECT sample_id, head, b FROM l WHERE b IS NOT NULL),
u AS (SELECT DISTINCT sample_id, head AS x, tail AS y FROM e WHERE head <> tail UNION SELECT DISTINCT sample_id, tail, head FROM e WHERE head <> tail),
deg AS (SELECT sample_id, x AS entity, count(*) AS d FROM u GROUP BY ALL),
tri AS (SELECT p.sample_id, p.x AS entity, count(*) AS t2 FROM u p JOIN u q ON p.sample_id = q.sample_id AND p.y = q.x JOIN u s ON s.sample_id = p.sample_id AND s.x = q.y AND s.y = p.x GROUP BY ALL),
every AS (SELECT sample_id, head AS entity FROM e UNION SELECT sample_id, tail FROM e)
SELECT sample_id, entity, CASE WHEN d > 1 THEN coalesce(t2, 0) / (d * (d - 1)) ELSE 0.0::DOUBLE END AS clustering FROM every LEFT JOIN deg USING (sample_id, entity) LEFT JOIN tri USING (sample_id, entity)"""


def kg_node_features(spark, d):
    """All but the text part of the features, as sums and shares."""
    found = _triples(spark, d)
    feats = graph.features_in_rows(found, F.concat(F.lit("product_"), F.col("asin").cast("string")), F.array_repeat(F.lit(1.0), 32))
    part = lambda a, n: F.aggregate(F.slice("features", a, n), F.lit(0.0), lambda acc, x: acc + x)
    return feats.select("sample_id", "entity", "is_core", part(1, 16).alias("user_flags"), part(17, 16).alias("product_flags"), F.element_at("features", 33).alias("hash_byte_0"), part(65, 32).alias("text_sum"), F.element_at("features", 97).alias("in_share"), F.element_at("features", 98).alias("out_share"), F.element_at("features", 100).alias("centrality"), F.size("features").alias("n_features"))


FEATURES = f"""WITH {DEGREE_CTE}
SELECT g.sample_id, entity, entity = 'product_' || asin AS is_core, CASE WHEN starts_with(entity, 'user_') THEN 16.0::DOUBLE ELSE 0 END AS user_flags, CASE WHEN starts_with(entity, 'product_') THEN 16.0::DOUBLE ELSE 0 END AS product_flags,
  ('0x' || left(sha256(regexp_extract(entity, '[^_]*$')), 2))::BIGINT / 255.0::DOUBLE AS hash_byte_0, CASE WHEN entity = 'product_' || asin THEN 32.0::DOUBLE ELSE 0 END AS text_sum, in_share, out_share, centrality, 100 AS n_features FROM deg g JOIN base USING (sample_id)"""


def kg_attention_softmax(spark, d):
    """By the rows of samples, each of which is a graph."""
    found = graph.attention_in_rows(F.col("triples"), lambda t: F.length(t["head"]) / F.lit(10.0) - F.lit(1.2), lambda t: F.lit(0.1))
    each = _triples(spark, d).select("sample_id", F.explode(found).alias("n"))
    alphas = F.transform("n.edges", lambda x: x["alpha"])
    return each.select("sample_id", "n.tail", F.size("n.edges").cast("long").alias("n_edges"), F.round(F.array_max(alphas), 9).alias("alpha_max"))


ATTENTION = f"""WITH {EDGES}, e AS (SELECT sample_id, tail, exp((CASE WHEN s >= 0 THEN s ELSE s * 0.2::DOUBLE END) * w) AS x FROM (SELECT sample_id, tail, length(head) / 10.0::DOUBLE - 1.2::DOUBLE + 0.1::DOUBLE AS s, {WEIGHT_SQL} AS w FROM edges)),
a AS (SELECT sample_id, tail, x / (sum(x) OVER (PARTITION BY sample_id, tail) + 1e-8::DOUBLE) AS alpha FROM e)
SELECT sample_id, tail, count(*) AS n_edges, round(max(alpha), 9) AS alpha_max FROM a GROUP BY ALL"""


#: Weights of the query's layer: two heads of two components over three features, by formula.
HEADS, WIDTH, INPUTS = 2, 2, 3
PROJECTION = [[((4 * i + j) * 7 % 11 - 5) / 10 for j in range(HEADS * WIDTH)] for i in range(INPUTS)]
SCORES = [[((4 * k + j) * 5 % 9 - 4) / 10 for j in range(2 * WIDTH)] for k in range(HEADS)]
RESIDUAL = [[((4 * i + j) * 3 % 7 - 3) / 10 for j in range(HEADS * WIDTH)] for i in range(INPUTS)]
BIAS = [0.1, -0.2, 0.3, -0.4]


def kg_attention_layer(spark, d):
    """A layer of two heads over one graph of all purchases, customers and items."""
    orders = table(spark, d, "orders").hint("shuffle_hash")  # a row an order, two numbers wide
    bought = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = bought.select(F.lit(0).alias("graph"), F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("head"), F.concat(F.lit("product_"), F.col("l_partkey").cast("string")).alias("tail"), (F.col("l_quantity").cast("double") / 100.0 + 0.5).alias("weight"))

    def of(name, key, prefix, user):
        return table(spark, d, name).select(F.lit(0).alias("graph"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("entity"), F.array(F.col(key) % 7 / F.lit(7.0), F.col(key) % 11 / F.lit(11.0), F.lit(user)).alias("features"))

    nodes = of("customer", "c_custkey", "user_", 1.0).unionByName(of("part", "p_partkey", "product_", 0.0))
    found = attention.attention_layer(nodes, edges, PROJECTION, SCORES, (RESIDUAL, BIAS), key="graph")
    return found.select("entity", *[F.round(F.col("features")[j], 8).alias(f"x{j}") for j in range(HEADS * WIDTH)])


def _layer_sql() -> str:
    def product(w, j, bias=0.0):
        return " + ".join([f"f{i} * {w[i][j]}::DOUBLE" for i in range(INPUTS)] + [f"{bias}::DOUBLE"])

    places, comma = range(HEADS * WIDTH), ", "
    part = lambda k, side: " + ".join(f"{'hg'[side]}.h{k * WIDTH + j} * {SCORES[k][side * WIDTH + j]}::DOUBLE" for j in range(WIDTH))
    raw = comma.join(f"{part(k, 0)} + {part(k, 1)} AS r{k}" for k in range(HEADS))
    e = comma.join(f"exp((CASE WHEN r{k} >= 0 THEN r{k} ELSE r{k} * 0.2::DOUBLE END) * w) AS e{k}" for k in range(HEADS))
    return f"""
WITH nodes AS (SELECT 'user_' || c_custkey AS entity, c_custkey % 7 / 7.0::DOUBLE AS f0, c_custkey % 11 / 11.0::DOUBLE AS f1, 1.0::DOUBLE AS f2 FROM customer
  UNION ALL SELECT 'product_' || p_partkey, p_partkey % 7 / 7.0::DOUBLE, p_partkey % 11 / 11.0::DOUBLE, 0.0::DOUBLE FROM part),
projected AS (SELECT entity, {comma.join(f"{product(PROJECTION, j)} AS h{j}" for j in places)}, {comma.join(f"{product(RESIDUAL, j, BIAS[j])} AS r{j}" for j in places)} FROM nodes),
raw AS (SELECT g.entity, {comma.join(f"h.h{j}" for j in places)}, l_quantity::DOUBLE / 100.0::DOUBLE + 0.5::DOUBLE AS w, {raw} FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN projected h ON h.entity = 'user_' || o_custkey JOIN projected g ON g.entity = 'product_' || l_partkey),
e AS (SELECT *, {e} FROM raw),
added AS (SELECT entity, {comma.join(f"sum(e{j // WIDTH} * h{j}) / (sum(e{j // WIDTH}) + 1e-8::DOUBLE) AS m{j}" for j in places)} FROM e GROUP BY entity)
SELECT entity, {comma.join(f"round(r{j} + coalesce(m{j}, 0), 8) AS x{j}" for j in places)} FROM projected LEFT JOIN added USING (entity)"""


def entity_hash_bytes(spark, d):
    users = samples(spark, d).select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity")).distinct()
    return users.select("entity", entity_type(F.col("entity")).alias("kind"), F.posexplode(entity_hash(F.col("entity"))).alias("pos", "share"))


HASHES = f"""WITH {SAMPLES}, u AS (SELECT DISTINCT 'user_' || user_id AS entity, sha256(user_id::VARCHAR) AS h FROM samples)
SELECT entity, 'user' AS kind, i::INTEGER AS pos, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT / 255.0::DOUBLE AS share FROM u, range(32) r(i)"""

QUERIES = {
    "kg_triples_rule": (kg_triples_rule, RULE),
    "kg_validate": (kg_validate, VALIDATE),
    "kg_scenario_complete": (kg_scenario_complete, SCENARIO),
    "kg_title_complete": (kg_title_complete, TITLES),
    "kg_relation_hist": (kg_relation_hist, f"WITH {TRIPLES} SELECT relation, count(*) AS n_triples FROM triples GROUP BY relation"),
    "kg_chunk_stats": (kg_chunk_stats, STATS),
    "kg_validation_stats": (kg_validation_stats, VALIDATION_STATS),
    "triples_udtf": (triples_udtf, "SELECT p_partkey, 'product_' || p_partkey AS head, 'has_brand' AS relation, p_brand AS tail FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'product_' || p_partkey, 'has_category', p_type FROM part WHERE p_partkey % 3 <> 0"),
    "kg_users": (kg_users, f"WITH {TRIPLES} SELECT count(DISTINCT head) AS n_users FROM triples WHERE starts_with(head, 'user_')"),
    "kg_edge_weight": (kg_edge_weight, f"WITH {EDGES} SELECT relation, {WEIGHT_SQL} AS weight, count(*) AS n_edges FROM edges GROUP BY ALL"),
    "kg_degree": (kg_degree, f"WITH {DEGREE_CTE} SELECT * FROM deg"),
    "kg_clustering": (kg_clustering, CLUSTERING),
    "kg_node_features": (kg_node_features, FEATURES),
    "kg_attention_softmax": (kg_attention_softmax, ATTENTION),
    "kg_attention_layer": (kg_attention_layer, _layer_sql()),
    "entity_hash_bytes": (entity_hash_bytes, HASHES),
}
