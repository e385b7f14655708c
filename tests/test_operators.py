"""Histories, splits, dictionaries, prompts, graphs: golden rows and properties."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from clickloom.operators import clean, dictionary, graph, history, metrics, position, prompt, quality, split


def brute_history(rows, k):
    out, seen = {}, {}
    for user, t, idx, item, label in sorted(rows):
        past = seen.setdefault(user, [])
        out[idx] = past[-k:]
        if label == 1:
            past.append(item)
    return out


@pytest.mark.parametrize("segment", [None, 1, 7, 1000])
@pytest.mark.parametrize("k", [1, 3])
def test_history_equals_brute_force(spark, segment, k):
    r = random.Random(k)
    rows = [(r.choice([1, 1, 1, 2, 3]), r.randrange(60), i, r.randrange(9), r.randrange(2)) for i in range(400)]
    df = spark.createDataFrame(rows, "user long, t long, idx long, item long, label int")
    seg = F.floor(F.col("t") / segment) if segment else None
    got = history.click_history(df, "user", ["t", "idx"], F.col("label") == 1, F.col("item"), k, seg).collect()
    want = brute_history(rows, k)
    assert len(got) == 400 and all(x["history"] == want[x["idx"]] for x in got)


def test_history_golden_rows(spark):
    rows = [(1, t, i, p) for t, i, p in [(1, "A", 1), (2, "B", 0), (3, "C", 1), (4, "D", 1), (5, "E", 1), (6, "F", 0)]]
    df = spark.createDataFrame(rows, "u long, t long, item string, p int")
    got = history.click_history(df, "u", ["t"], F.col("p") == 1, F.col("item")).orderBy("t")
    shown = got.select(history.render_ids(F.col("history")).alias("a"), history.render_titles(F.col("history")).alias("b")).collect()
    assert [x["a"] for x in shown] == ["unknown", "product_A", "product_A", "product_A and product_C", "product_A and product_C and product_D", "product_C and product_D and product_E"]
    assert shown[3]["b"] == "product 'A' and product 'C'"


@pytest.mark.parametrize(("n", "sizes"), [(10, (8, 1, 1)), (15, (12, 2, 1)), (25, (20, 2, 3))])
def test_split_sizes(spark, n, sizes):
    df = spark.range(n).select(F.col("id"), F.timestamp_seconds(F.col("id") * 50_000).alias("t"))
    got = split.chronological_split(df, F.col("t"), [F.col("id")]).collect()
    assert tuple(sum(r["split"] == s for r in got) for s in ("train", "valid", "test")) == sizes
    order = [r["split"] for r in sorted(got, key=lambda r: r["id"])]
    assert order == sorted(order, key=["train", "valid", "test"].index)


def test_split_of_few_rows_fails(spark):
    df = spark.range(5).select("id", F.timestamp_seconds("id").alias("t"))
    with pytest.raises(PySparkException, match="would be empty"):
        split.require_splits(split.chronological_split(df, F.col("t"), [F.col("id")])).collect()


def test_leaking_columns_go(spark):
    df = spark.createDataFrame([("test", "r", "h", 1)], "split string, reviewText string, user_hist_id string, label int")
    assert split.split_columns(df, "test").columns == ["label"]


def test_positions(spark):
    df = spark.createDataFrame([(g, v) for g in ("a", "b", None) for v in range(50)], "g string, v int").repartition(5)
    got = position.with_position(df, F.floor(F.col("v") / 7), [F.col("v")], ["g"], "p", "n").collect()
    assert len(got) == 150 and all(r["p"] == r["v"] + 1 and r["n"] == 50 for r in got)


def test_dictionary_is_a_bijection(spark):
    a = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "x string")
    b = spark.createDataFrame([(10,), (9,)], "y int")
    got = {r["value"]: r["idx"] for r in dictionary.build_dictionary([a, b], "unknown_asin").collect()}
    assert got == {v: i for i, v in enumerate(sorted(["a", "b", "10", "9", "unknown_asin"]))}
    rows = dictionary.encode(a, spark.createDataFrame(list(got.items()), "value string, idx long"), F.col("x"), "unknown_asin", "i").collect()
    assert sorted(r["i"] for r in rows) == sorted([got["b"], got["a"], got["unknown_asin"], got["b"]])


def test_dedup_and_fill(spark):
    df = spark.createDataFrame([("k", 2, None, 2.0), ("k", 1, "first", None), (None, 3, "n", 4.0)], "k string, i int, v string, price double")
    got = {r["k"]: r["v"] for r in clean.dedup_first(df, ["k"], [F.col("i")]).collect()}
    assert got == {"k": "first", None: "n"}
    assert sorted(r["price"] for r in clean.fill_with_mean(df, "price").collect()) == [2.0, 3.0, 4.0]
    assert [r["price"] for r in clean.fill_with_mean(df.where("price is null"), "price").collect()] == [0.0]


def test_finalise_fills_missing_columns(spark):
    got = clean.finalise(spark.createDataFrame([("t",)], "title string"))
    assert tuple(got.columns) == clean.FINAL_COLUMNS
    assert got.first()["price"] == 0.0 and got.first()["scenario_id"] == -1 and got.first()["brand"] == "unknown"


PROMPT = "All_Beauty: The user is Julie (ID: user_83), who clicked IDs product_22 and titles product 'Sleep N Play' recently. The ID of current product is product_68, the title is '5-pack bodysuits', the brand is 'Belocia', the price is $27.00. "


def test_prompt_golden_rows(spark):
    schema = "Domain string, user_id long, user_name string, asin long, title string, brand string, price double, user_hist_id string, user_hist_title string, rank string"
    row = ("All_Beauty", 83, "Julie", 68, "5-pack bodysuits", "Belocia", 27.0, "product_22", "product 'Sleep N Play'", "unknown")
    df = spark.createDataFrame([row], schema)
    assert df.select(prompt.prompt_text(df)).first()[0] == PROMPT
    bare = df.withColumns({"user_name": F.lit("nan"), "user_hist_id": F.lit("unknown"), "user_hist_title": F.lit(None).cast("string")})
    assert bare.select(prompt.prompt_text(bare)).first()[0].startswith("All_Beauty: The user is anonymous (ID: user_83). The ID of current product is product_68, ")
    numbered = df.withColumns({"Domain": F.lit(None).cast("string"), "scenario_id": F.lit(3)})
    assert numbered.select(prompt.prompt_text(numbered)).first()[0].startswith("Gift Cards: ")
    blank = df.withColumns({"Domain": F.lit("nan"), "scenario_id": F.lit(3)})
    assert blank.select(prompt.prompt_text(blank)).first()[0].startswith("Unknown Scenario: ")


def test_graph_golden_rows(spark):
    t = [("user_1", "click_history_id", "product_2"), ("product_2", "has_brand", "X")]
    df = spark.createDataFrame([(7, t, "beauty")], "sample_id long, triples array<struct<head:string,relation:string,tail:string>>, domain string")
    e = graph.edges(df)
    got = {r["entity"]: (r["in_share"], r["out_share"], r["centrality"]) for r in graph.degrees(e).collect()}
    assert got == {"user_1": (0, 0.5, 0.5), "product_2": (0.5, 0.5, 1.0), "X": (0.5, 0, 0.5)}
    assert {r["clustering"] for r in graph.clustering(e).collect()} == {0.0}
    done = df.select(graph.complete_scenarios(F.col("triples"), F.col("domain")).alias("t")).first()["t"]
    assert tuple(done[-1]) == ("user_1", "belongs_to_scenario", "scenario_beauty") and len(done) == 3
    titled = df.select(graph.complete_titles(F.col("triples"), F.lit("PRODUCT_2 Title: Soap now")).alias("t")).first()["t"]
    assert tuple(titled[-1]) == ("product_2", "has_title", "Soap")
    alpha = graph.attention(e, F.lit(1.0), F.lit(0.0)).collect()
    assert all(abs(r["alpha"] - 1) < 1e-6 for r in alpha)
    valid = df.select(graph.validate(F.col("triples"), F.lit("user_1 saw product_22")).alias("t")).first()["t"]
    assert valid == []


def test_validation_takes_ids_as_they_are_written(spark):
    """Ids with signs of patterns are compared, not matched; a missing source or relation confirms nothing."""
    ids = ["product_2", "product_a.b", "product_(", "product_\\E", "other", None]
    t = [(x, "has_brand", "X") for x in ids] + [("user_1", "odd", "X"), ("user_1", None, "X")]
    rows = [(1, t, "user_1 saw product_2, product_axb"), (2, t, "product_a.b; product_( product_\\E!"), (3, t, None)]
    df = spark.createDataFrame(rows, "k long, t array<struct<head:string,relation:string,tail:string>>, s string")
    got = {r["k"]: [x["head"] for x in r["v"]] for r in df.select("k", graph.validate(F.col("t"), F.col("s")).alias("v")).collect()}
    assert got == {1: ["product_2", "other", None], 2: ["product_a.b", "product_(", "product_\\E", "other", None], 3: ["other", None]}
    told = {r["k"]: [tuple(x)[:2] for x in r["v"]] for r in df.select("k", graph.verdicts(F.col("t"), F.col("s")).alias("v")).collect()}
    good, bad = (True, "grounded"), (False, "id not in text")
    assert told[1] == [good, bad, bad, bad, good, good, (False, "unknown relation"), bad]


def test_attention_in_rows_equals_that_over_edges(spark):
    t = [("user_1", "click_history_id", "a"), ("user_1", "click_history_id", "a"), ("b", "has_price", "a"), ("b", "odd", "c"), ("c", None, "c")]
    df = spark.createDataFrame([(1, t), (2, t[:1]), (3, [])], "sample_id long, triples array<struct<head:string,relation:string,tail:string>>")
    over = graph.attention(graph.edges(df), F.length("head") - F.lit(3.0), F.lit(0.1)).select("sample_id", "tail", "head", F.round("alpha", 12))
    each = df.select("sample_id", F.explode(graph.attention_in_rows(F.col("triples"), lambda t: F.length(t["head"]) - F.lit(3.0), lambda t: F.lit(0.1))).alias("n"))
    rows = each.select("sample_id", "n.tail", F.explode("n.edges").alias("e")).select("sample_id", "tail", "e.head", F.round("e.alpha", 12))
    assert sorted(rows.collect()) == sorted(over.collect()) and rows.count() == 6


def test_clustering_of_a_triangle(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (1, "a", "b"), (1, "d", "d")], "sample_id long, head string, tail string")
    got = {r["entity"]: r["clustering"] for r in graph.clustering(e).collect()}
    assert got["a"] == got["b"] == 1.0 and got["c"] == pytest.approx(1 / 3) and got["d"] == 0.0


def test_class_weights_and_auc(spark):
    df = spark.createDataFrame([(i, int(i < 8), float(i % 3)) for i in range(10)], "i int, y int, s double")
    got = {r["y"]: r["weight"] for r in quality.class_weights(df, "y").collect()}
    assert got == {0: 2.5, 1: 0.625}
    pairs = [(a, b) for _, y, a in df.collect() if y for _, z, b in df.collect() if not z]
    want = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert metrics.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(want)
    assert metrics.roc_auc(df.where("y = 1"), "s", "y").first()["auc"] == 0.5


def test_early_stopping_tolerance(spark):
    df = spark.createDataFrame([("r", 1, 0.7), ("r", 2, 0.70005), ("r", 3, 0.7002)], "run string, epoch int, auc double")
    got = metrics.early_stopping(df, "epoch", "auc", ["run"]).orderBy("epoch").collect()
    assert [r["improved"] for r in got] == [True, False, True] and [r["idle_epochs"] for r in got] == [0, 1, 0]


def test_positional_join(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "sample_id long, a string"), spark.createDataFrame([(1, 1.0), (2, 2.0)], "sample_id long, b double")
    assert quality.positional_join([a, b]).count() == 2
    with pytest.raises(PySparkException, match="without a counterpart"):
        quality.positional_join([a, b.where("sample_id = 1")]).collect()
    assert [tuple(r) for r in quality.stray_samples(a, b.where("sample_id = 1")).collect()] == [(2, "left")]
