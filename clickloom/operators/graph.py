"""Knowledge graphs of samples: extraction from columns, validation, completion, features, attention."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.entities import RELATIONS, entity_hash, entity_type, relation_weight
from clickloom.functions.text import bound, is_blank

#: Relations that a test row must not show.
TEST_FORBIDDEN = ("click_history_id",)


def triple(head: Column, relation: str | Column, tail: Column) -> Column:
    return F.struct(head.cast("string").alias("head"), (F.lit(relation) if isinstance(relation, str) else relation).alias("relation"), tail.cast("string").alias("tail"))


def rule_triples(df: DataFrame, history: Column | None = None) -> Column:
    """Triples that a row's columns state, in a fixed order; blank attributes give none.

    ``history`` is an array of item ids that the user clicked before.
    """

    def has(name: str) -> bool:
        return name in df.columns

    user, product = F.concat(F.lit("user_"), F.col("user_id").cast("string")), F.concat(F.lit("product_"), F.col("asin").cast("string"))
    parts = []
    for column, relation, head in (
        ("user_name", "has_username", user), ("title", "has_title", product), ("brand", "has_brand", product), ("price", "has_price", product),
        ("category", "belongs_to_category", product), ("style", "has_style", product), ("rank", "has_rank", product),
    ):
        if has(column):
            value = F.col(column).cast("string")
            parts.append(F.when(~is_blank(value), F.array(triple(head, relation, value))).otherwise(F.expr("array()")))
    if history is not None:
        parts.append(F.transform(history, lambda x: triple(user, "click_history_id", F.concat(F.lit("product_"), x.cast("string")))))
    return F.filter(F.concat(*parts), lambda t: t["tail"].isNotNull())


def allowed(triples: Column, forbidden: Sequence[str] = ()) -> Column:
    """Triples without forbidden relations."""
    return F.filter(triples, lambda t: ~t["relation"].isin(*forbidden)) if forbidden else triples


def _judged(triples: Column, source: Column, of: Callable[[Column, Column, Column], Column]) -> Column:
    """``of(t, known, good)`` of each triple; the source is cut into words once a row."""

    def grounded(x: Column, text: Column, words: Column) -> Column:
        # an id of word characters is a word of the text or isn't there; others are looked for as they are written
        quoted = F.concat(F.lit(r"(^|[^A-Za-z0-9_])\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E($|[^A-Za-z0-9_])"))
        return (entity_type(x) == "other") | F.when(F.regexp_like(x, F.lit(r"^[A-Za-z0-9_]+\z")), F.array_contains(words, x)).otherwise(F.regexp_like(text, quoted))

    def judged(text: Column, words: Column) -> Column:
        known = lambda t: t["relation"].isin(*RELATIONS)
        return F.transform(triples, lambda t: bound(known(t) & grounded(t["head"], text, words) & grounded(t["tail"], text, words), lambda good: of(t, known(t), good)))

    return bound(source, lambda text: bound(F.split(text, "[^A-Za-z0-9_]+"), lambda words: judged(text, words)))


def validate(triples: Column, source: Column) -> Column:
    """Triples with a known relation whose user and product ids stand in the source text as words of their own."""
    marked = _judged(triples, source, lambda t, known, good: F.struct(t.alias("t"), good.alias("good")))
    return F.transform(F.filter(marked, lambda m: m["good"]), lambda m: m["t"])


def verdicts(triples: Column, source: Column) -> Column:
    """A verdict for each triple: valid, reason, confidence."""

    def verdict(t: Column, known: Column, good: Column) -> Column:
        reason = F.when(good, "grounded").when(~known, "unknown relation").otherwise("id not in text")
        return F.struct(F.coalesce(good, F.lit(False)).alias("valid"), reason.alias("reason"), F.lit(1.0).alias("confidence"))

    return _judged(triples, source, verdict)


def entities(triples: Column) -> Column:
    """Distinct heads and tails, sorted."""
    return F.array_sort(F.array_union(F.transform(triples, lambda t: t["head"]), F.transform(triples, lambda t: t["tail"])))


def complete_scenarios(triples: Column, domain: Column) -> Column:
    """One ``belongs_to_scenario`` edge for each user that has none."""
    users = F.filter(entities(triples), lambda e: F.startswith(e, F.lit("user_")))
    lacking = F.filter(users, lambda u: ~F.exists(triples, lambda t: (t["head"] == u) & (t["relation"] == "belongs_to_scenario")))
    return F.concat(triples, F.transform(lacking, lambda u: triple(u, "belongs_to_scenario", F.concat(F.lit("scenario_"), domain))))


def complete_titles(triples: Column, source: Column) -> Column:
    """A ``has_title`` edge for each clicked product that the source text names with ``title:``."""
    clicked = F.array_distinct(F.transform(F.filter(triples, lambda t: t["relation"] == "click_history_id"), lambda t: t["tail"]))
    titled = F.transform(F.filter(triples, lambda t: (t["relation"] == "has_title") & F.startswith(t["head"], F.lit("product_"))), lambda t: t["head"])
    pairs = F.transform(F.array_except(clicked, titled), lambda p: F.struct(p.alias("p"), F.trim(F.call_function("regexp_extract", source, F.concat(F.lit("(?i)"), p, F.lit(r"\s+title[:：]\s*(.+?)(\s|$)")), F.lit(1))).alias("t")))
    return F.concat(triples, F.transform(F.filter(pairs, lambda x: x["t"] != ""), lambda x: triple(x["p"], "has_title", x["t"])))


def edges(df: DataFrame, key: str = "sample_id", triples: str = "triples") -> DataFrame:
    """A row for each triple: key, head, relation, tail, weight."""
    each = df.select(key, F.explode(triples).alias("_t"))
    return each.select(key, "_t.head", "_t.relation", "_t.tail").withColumn("weight", relation_weight(F.col("relation")))


def chunk_stats(df: DataFrame, by: Sequence[str] = (), triples: str = "triples") -> DataFrame:
    """Chunks, chunks with and without triples, and triples, with distinct user heads; ``by`` groups with a total row, without users."""
    n = F.size(triples)
    grouped = df.rollup(*by) if by else df.groupBy()
    counts = grouped.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count(F.when(n > 0, 1)).alias("n_with"),
        F.count(F.when(n <= 0, 1)).alias("n_without"),
        F.coalesce(F.sum(n), F.lit(0)).alias("n_triples"),
    )
    return counts if by else counts.join(F.broadcast(distinct_users(df, triples)))  # one row each


def validation_stats(df: DataFrame, candidates: str = "candidates", triples: str = "triples", by: Sequence[str] = ()) -> DataFrame:
    """Candidate triples, how many of them passed validation and how many didn't, over all rows or by groups."""
    tried, good = F.sum(F.size(F.coalesce(candidates, F.array()))), F.sum(F.size(F.coalesce(triples, F.array())))
    sums = df.groupBy(*by).agg(F.coalesce(tried, F.lit(0)).alias("n_candidates"), F.coalesce(good, F.lit(0)).alias("n_valid"))
    return sums.withColumn("n_invalid", F.col("n_candidates") - F.col("n_valid"))


def relation_histogram(df: DataFrame, triples: str = "triples") -> DataFrame:
    return df.select(F.explode(triples).alias("t")).groupBy(F.coalesce("t.relation", F.lit("Unknown")).alias("relation")).agg(F.count(F.lit(1)).alias("n_triples"))


def distinct_users(df: DataFrame, triples: str = "triples") -> DataFrame:
    """How many users head a triple."""
    heads = df.select(F.explode(triples).alias("t")).select(F.col("t.head").alias("h")).where(F.startswith("h", F.lit("user_"))).distinct()
    return heads.agg(F.count(F.lit(1)).alias("n_users"))


def nodes(edge_rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """Distinct entities of each sample."""
    return edge_rows.select(key, F.col("head").alias("entity")).union(edge_rows.select(key, F.col("tail").alias("entity"))).distinct()


def degrees(edge_rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """In- and out-degree of each node over distinct directed edges, as shares of the sample's largest degree, and centrality."""
    d = edge_rows.select(key, "head", "tail").distinct()
    ends = d.select(key, F.col("head").alias("entity"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(d.select(key, F.col("tail").alias("entity"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    per = ends.groupBy(key, "entity").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    most = per.groupBy(key).agg(F.max(F.col("n_in") + F.col("n_out")).alias("_most"), F.count(F.lit(1)).alias("_n"))
    joined = per.join(most, key)
    return joined.select(
        key, "entity", "n_in", "n_out",
        (F.col("n_in") / F.col("_most")).alias("in_share"), (F.col("n_out") / F.col("_most")).alias("out_share"),
        F.when(F.col("_n") > 1, (F.col("n_in") + F.col("n_out")) / (F.col("_n") - 1)).otherwise(1.0).alias("centrality"),
    )


def clustering(edge_rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """Local clustering coefficient of each node in the undirected graph without loops.

    Edges lead from the end of lesser degree (then name) to the other, so each triangle
    is joined once, from its corner of least degree, and a hub is nobody's start.
    """
    u = edge_rows.where("head != tail").select(key, F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).distinct()
    neighbours = u.select(key, F.explode(F.array("a", "b")).alias("entity")).groupBy(key, "entity").agg(F.count(F.lit(1)).alias("_d"))
    led = u.join(neighbours.toDF(key, "a", "_da"), [key, "a"]).join(neighbours.toDF(key, "b", "_db"), [key, "b"])
    forward = F.struct(F.col("_da").alias("d"), F.col("a").alias("n")) < F.struct(F.col("_db").alias("d"), F.col("b").alias("n"))
    up = led.select(key, F.when(forward, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("b"))
    ab, bc, ac = up.toDF(key, "a", "b"), up.toDF(key, "b", "c"), up.toDF(key, "a", "c")
    triangles = ab.join(bc, [key, "b"]).join(ac, [key, "a", "c"], "left_semi")
    corners = triangles.select(key, F.explode(F.array("a", "b", "c")).alias("entity")).groupBy(key, "entity").agg(F.count(F.lit(1)).alias("_t"))
    joined = nodes(edge_rows, key).join(neighbours, [key, "entity"], "left").join(corners, [key, "entity"], "left")
    d, t = F.coalesce("_d", F.lit(0)), F.coalesce("_t", F.lit(0))
    return joined.select(key, "entity", F.when(d > 1, 2.0 * t / (d * (d - 1))).otherwise(0.0).alias("clustering"))


def core_entity(product: Column, found: Column) -> Column:
    """The sample's current product if the graph has it, else its least product, else its least entity."""
    products = F.filter(found, lambda e: F.startswith(e, F.lit("product_")))
    return F.when(F.array_contains(found, product), product).otherwise(F.coalesce(F.try_element_at(F.array_sort(products), F.lit(1)), F.try_element_at(F.array_sort(found), F.lit(1))))


#: The node of a graph without triples.
PLACEHOLDER = "placeholder"


def node_features(edge_rows: DataFrame, cores: DataFrame, key: str = "sample_id", text_dim: int = 32) -> DataFrame:
    """The 100 features of each node: type flags, id hash, text vector on the core node, four structural shares.

    ``cores`` has key, ``core`` and ``text_vector`` (array of ``text_dim``). A sample of
    ``cores`` without edges gets a placeholder node, which is its core.
    """
    zeros = [F.lit(0.0).alias(c) for c in ("in_share", "out_share", "centrality", "clustering")]
    empty = cores.join(edge_rows.select(key).distinct(), key, "left_anti").select(key, F.lit(PLACEHOLDER).alias("entity"), *zeros, F.lit(PLACEHOLDER).alias("core"), "text_vector")
    joined = degrees(edge_rows, key).join(clustering(edge_rows, key), [key, "entity"]).join(cores, key, "left")
    return _with_features(joined.select(*empty.columns).unionByName(empty), key, text_dim)


def features_in_rows(df: DataFrame, product: Column, text_vector: Column, key: str = "sample_id", triples: str = "triples", text_dim: int = 32, with_edges: bool = False) -> DataFrame:
    """What ``node_features`` gives with the core of ``core_entity``, from a sample's triples where they lie: no row moves.

    A sample's nodes come one after another. ``with_edges`` adds ``edges`` (head, tail, weight of
    all triples) to the first of them; the others have NULL. Its work in a row is the product of nodes and triples, which suits graphs of a
    sample; for graphs of many thousand triples take ``node_features``.
    """
    link = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def ends(t: Column) -> Column:
        return F.struct(F.array_distinct(F.transform(t, lambda x: link(x["head"], x["tail"]))).alias("e"), entities(t).alias("n"))

    def sides(g: Column) -> Column:
        plain = F.array_distinct(F.transform(F.filter(g["e"], lambda e: e["a"] != e["b"]), lambda e: link(F.least(e["a"], e["b"]), F.greatest(e["a"], e["b"]))))
        return F.struct(g["e"].alias("e"), plain.alias("u"), F.when(F.size(g["n"]) > 0, g["n"]).otherwise(F.array(F.lit(PLACEHOLDER))).alias("n"))

    def counted(g: Column, x: Column) -> Column:
        near = F.transform(F.filter(g["u"], lambda u: (u["a"] == x) | (u["b"] == x)), lambda u: F.when(u["a"] == x, u["b"]).otherwise(u["a"]))
        return F.struct(
            x.alias("entity"),
            F.size(F.filter(g["e"], lambda e: e["b"] == x)).alias("n_in"),
            F.size(F.filter(g["e"], lambda e: e["a"] == x)).alias("n_out"),
            bound(near, lambda y: F.struct(F.size(y).alias("d"), F.when(F.size(y) > 1, F.size(F.filter(g["u"], lambda u: F.array_contains(y, u["a"]) & F.array_contains(y, u["b"])))).otherwise(0).alias("t"))).alias("near"),
        )

    def shared(n: Column) -> Column:
        """The nodes, each with the largest degree and the number of nodes."""
        most = F.array_max(F.transform(n, lambda x: x["n_in"] + x["n_out"]))
        core = core_entity(product, F.transform(n, lambda x: x["entity"]))
        return bound(F.struct(most.alias("most"), core.alias("core")), lambda m: F.transform(n, lambda x: F.struct(m["core"].alias("core"), x["entity"].alias("entity"), x["n_in"].alias("n_in"), x["n_out"].alias("n_out"), x["near"]["d"].alias("d"), x["near"]["t"].alias("t"), m["most"].alias("most"), F.size(n).alias("nodes"))))

    # each step is bound: nothing that a step refers to again is computed again
    every = bound(bound(bound(bound(F.col(triples), ends), sides), lambda g: F.transform(g["n"], lambda x: counted(g, x))), shared)
    told = F.transform(triples, lambda t: F.struct(t["head"].alias("head"), t["tail"].alias("tail"), relation_weight(t["relation"]).alias("weight")))
    whole = df.select(key, text_vector.alias("text_vector"), *([F.coalesce(told, F.array()).alias("edges")] if with_edges else []), F.posexplode(every).alias("_p", "_n"))
    kept = [F.when(F.col("_p") == 0, F.col("edges")).alias("edges")] if with_edges else []
    rows = whole.select(key, "text_vector", "_n.*", *kept)
    share = lambda c: F.when(F.col("most") > 0, c / F.col("most")).otherwise(0.0)
    centrality = F.when(F.col("most") == 0, 0.0).when(F.col("nodes") > 1, (F.col("n_in") + F.col("n_out")) / (F.col("nodes") - 1)).otherwise(1.0)
    clustered = F.when(F.col("d") > 1, 2.0 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return _with_features(rows.select(key, "entity", "core", "text_vector", share(F.col("n_in")).alias("in_share"), share(F.col("n_out")).alias("out_share"), clustered.alias("clustering"), centrality.alias("centrality"), *(["edges"] if with_edges else [])), key, text_dim, ["edges"] if with_edges else [])


def _with_features(joined: DataFrame, key: str, text_dim: int, kept: Sequence[str] = ()) -> DataFrame:
    kind, zero = entity_type(F.col("entity")), F.array_repeat(F.lit(0.0), text_dim)
    flag = lambda k: F.array_repeat(F.when(kind == k, 1.0).otherwise(0.0), 16)
    text = F.when(F.col("entity") == F.col("core"), F.coalesce(F.col("text_vector").cast("array<double>"), zero)).otherwise(zero)
    tail = F.array("in_share", "out_share", "clustering", "centrality")
    return joined.select(key, "entity", (F.col("entity") == F.col("core")).alias("is_core"), F.concat(flag("user"), flag("product"), entity_hash(F.col("entity"), 32), text, tail).alias("features"), *kept)


def attention(edge_rows: DataFrame, source: Column, target: Column, key: str = "sample_id", slope: float = 0.2, eps: float = 1e-8) -> DataFrame:
    """Attention shares of one scalar head: exp(LeakyReLU(source + target) * weight) over all edges into a node.

    Parallel edges stay apart. ``source`` and ``target`` are scalars of an edge's ends.
    """
    raw = source + target
    e = edge_rows.withColumn("_e", F.exp(F.when(raw >= 0, raw).otherwise(raw * slope) * F.col("weight")))
    total = F.sum("_e").over(Window.partitionBy(key, "tail"))  # one shuffle, and the edges are built once
    return e.withColumn("alpha", F.col("_e") / (total + F.lit(eps))).drop("_e")


def attention_in_rows(triples: Column, source: Callable[[Column], Column], target: Callable[[Column], Column], slope: float = 0.2, eps: float = 1e-8) -> Column:
    """What ``attention`` gives for the graph of a row, from its triples where they lie: no row moves.

    An array with a struct for each node that edges lead to: tail, and its edges (head,
    relation, weight, alpha). ``source`` and ``target`` are scalars of a triple. The work in a row
    is the product of edges and nodes, which suits graphs of a sample.
    """

    def weighted(t: Column) -> Column:
        def edge(given: Column) -> Column:
            e = F.exp(F.when(given["r"] >= 0, given["r"]).otherwise(given["r"] * slope) * given["w"])
            return F.struct(t["head"].alias("head"), t["relation"].alias("relation"), t["tail"].alias("tail"), given["w"].alias("weight"), e.alias("e"))

        return bound(F.struct((source(t) + target(t)).alias("r"), relation_weight(t["relation"]).alias("w")), edge)

    def shared(same: Column) -> Column:
        total = F.aggregate(same, F.lit(0.0), lambda acc, x: acc + x["e"])
        return bound(total, lambda s: F.transform(same, lambda x: F.struct(x["head"].alias("head"), x["relation"].alias("relation"), x["weight"].alias("weight"), (x["e"] / (s + F.lit(eps))).alias("alpha"))))

    def into(edge: Column) -> Column:
        tails = F.array_distinct(F.transform(edge, lambda x: x["tail"]))
        return F.transform(tails, lambda n: F.struct(n.alias("tail"), bound(F.filter(edge, lambda x: x["tail"].eqNullSafe(n)), shared).alias("edges")))

    return bound(F.transform(triples, weighted), into)
