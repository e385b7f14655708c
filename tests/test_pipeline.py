"""Sources, stages, streaming, models, and every query against its SQL."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.models import embed, layers, run
from clickloom.models.autodiff import Var
from clickloom.operators.metrics import roc_auc
from clickloom.plans import catalogue, config, stages
from clickloom.sources import chat_endpoint, dictionaries, files
from clickloom.streaming.history import stream_history

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    other = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(other.columns) == sorted(df.columns)
    place = [other.columns.index(c) for c in df.columns]
    got = sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
    want = sorted((tuple(plain(r[k]) for k in place) for r in other.fetchall()), key=repr)
    assert got == want


def test_native_queries_run_no_python(spark):
    for name in ("hist_ids", "prompt_lines", "html_clean_full", "kg_node_features", "auc_exact"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


REVIEWS = [
    {"reviewerID": "u1", "asin": "A", "reviewerName": "Ann", "reviewText": "good\nstuff", "overall": 5.0, "unixReviewTime": 100, "style": {"Size:": " L"}, "vote": "3"},
    {"reviewerID": "u1", "asin": "B", "reviewerName": "Ann", "reviewText": None, "overall": 3.0, "unixReviewTime": 150},
    {"reviewerID": "u1", "asin": "C", "reviewerName": None, "reviewText": "bad", "overall": 1.0, "unixReviewTime": 200},
    {"reviewerID": "u2", "asin": "A", "overall": None, "unixReviewTime": 250},
]
META = [
    {"asin": "A", "title": "Soap; bar", "brand": "X", "price": "$1,000.00", "also_buy": ["B", "Z"], "rank": "12 in Beauty (See)", "similar_item": "<b>A; Q</b>", "category": ["c", ""]},
    {"asin": "A", "title": "later", "price": "$5.00"},
    {"asin": "C", "title": "Comb", "price": "$2.00", "also_buy": []},
]


def test_stages_end_to_end(spark, tmp_path):
    for name, rows in (("review", REVIEWS), ("meta", META)):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n")
    reviews = files.read_json_lines(spark, str(tmp_path / "review.json"), files.REVIEW_SCHEMA)
    meta = files.read_json_lines(spark, str(tmp_path / "meta.json"), files.META_SCHEMA)
    assert reviews.count() == 4 and meta.count() == 3
    reviews, meta = (df.coalesce(1).withColumn("src_idx", F.monotonically_increasing_id()) for df in (reviews, meta))
    users, items = stages.dictionaries(reviews, meta)
    ids = {r["value"]: r["idx"] for r in items.collect()}
    assert sorted(ids) == ["A", "B", "C", "unknown_asin"]
    rows = {r["unixReviewTime"]: r for r in stages.process(reviews, meta, users, items, "All_Beauty", 4).collect()}
    assert sorted(rows) == ["1970-01-01 00:01:40", "1970-01-01 00:03:20"]
    first, second = rows["1970-01-01 00:01:40"], rows["1970-01-01 00:03:20"]
    assert (first["label"], first["price"], first["rank"], first["category"], first["style"], first["reviewText"]) == (1, 1000.0, "12 in Beauty", "c", "Size: L", "good stuff")
    assert first["also_buy"] == f"product_{ids['B']} and product_{ids['unknown_asin']}" and second["also_buy"] == f"product_{ids['unknown_asin']}"
    assert first["similar_item"] == f"product_{ids['unknown_asin']}"  # the cell's cleaning drops the ';' between A and Q
    assert second["user_hist_id"] == f"product_{ids['A']}" and second["user_hist_title"] == "product 'Soap, bar'" and first["user_hist_id"] == "unknown"
    assert stages.process(reviews, meta, users, items, "All_Beauty", 4, compat=True).count() == 3
    table = stages.process(reviews, meta, users, items, "All_Beauty", 4)
    prompts = stages.prompt_stage(table)
    graphs = {r["sample_id"]: r["triples"] for r in stages.graph_stage(table, prompts, "train").collect()}
    assert any(t["relation"] == "click_history_id" for g in graphs.values() for t in g)
    assert all(any(t["relation"] == "belongs_to_scenario" for t in g) for g in graphs.values())
    tested = stages.graph_stage(table, prompts, "test").select(F.explode("triples").alias("t")).where("t.relation = 'click_history_id'")
    assert tested.count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nline'), (2, None)], "id long, text string")
    files.write_csv(df, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"))
    assert back.columns == ["id", "text"] and {r["id"]: r["text"] for r in back.collect()} == {1: 'a "q"\nline', 2: None}
    (tmp_path / "a.txt").write_bytes("é one\r\n\n two ".encode("latin-1"))
    assert [r["line"] for r in files.read_text(spark, str(tmp_path / "a.txt")).orderBy("line_number").collect()] == ["é one", " two "]
    assert files.read_text_columns(spark.createDataFrame([(None, "b")], "text string, reviewText string")).first()["text"] == "b"
    with pytest.raises(ValueError, match="missing column"):
        files.read_text_columns(spark.range(1))
    files.write_lines(df.where("id = 1"), "text", str(tmp_path / "lines"))
    files.write_json(df, str(tmp_path / "json"))
    files.write_matrix(spark.createDataFrame([(1, [1.0, 2.0])], "sample_id long, vec array<double>"), str(tmp_path / "m"))
    assert files.read_matrix(spark, str(tmp_path / "m")).first()["vec"] == [1.0, 2.0]
    assert files.write_once(df, str(tmp_path / "once")).count() == 2 and files.write_once(df.limit(0), str(tmp_path / "once")).count() == 2
    with pytest.raises(RuntimeError, match="empty"):
        files.write_once(df.limit(0), str(tmp_path / "none"))
    assert files.write_version(df, str(tmp_path / "v")) != files.write_version(df, str(tmp_path / "v"))
    for _ in range(2):
        files.append_results(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    report = files.path_report(spark, {"csv": str(tmp_path) + "/{domain}", "no": str(tmp_path) + "/{domain}_{split}"}, ["csv"])
    assert report.where("exists").count() == 3 and report.where("not exists").count() == 3
    built = dictionaries.load_or_build(spark, str(tmp_path / "dict"), lambda: df)
    assert built.count() == dictionaries.load_or_build(spark, str(tmp_path / "dict"), lambda: df.limit(0)).count() == 2
    assert dictionaries.load_or_build(spark, str(tmp_path / "dict"), lambda: df.limit(1), rebuild=True).count() == 1


def test_model_connector(spark, tmp_path):
    df = spark.createDataFrame([(1, "ask"), (2, None), (3, "fail")], "id long, q string")

    def make():
        def ask(p):
            if p == "fail":
                raise OSError
            return p.upper()

        return ask

    got = {r["id"]: r["answer"] for r in chat_endpoint.ask_model(df, F.col("q"), make).collect()}
    assert got == {1: "ASK", 2: None, 3: None}

    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    def generate(rows, attempt):
        rows = rows.mapInArrow(counted, rows.schema)
        good = F.array(F.struct(F.lit("h").alias("head"), F.lit("r").alias("relation"), F.lit("t").alias("tail")))
        return rows.withColumn("triples", F.when(F.col("id") <= attempt, good).otherwise(F.slice(good, 1, 0)))

    done = chat_endpoint.extract_with_retry(df, "id", "q", generate, lambda t, _: t, str(tmp_path / "rounds")).collect()
    assert calls.value == 3 + 2 + 1  # a row is asked once a round
    assert {r["id"]: (r["attempt"], len(r["triples"])) for r in done} == {1: (1, 1), 2: (2, 1), 3: (3, 1)}


def test_stream_history(spark, tmp_path):
    rows = [(1, i, i, i % 3, 1 - i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "user_id long, src_idx long, s long, item int, label int").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s")
    for k in range(2):
        df.where(f"src_idx div 5 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_history(source).writeStream.format("memory").queryName("hist").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["src_idx"]: r["history"] for r in spark.sql("select * from hist").collect()}
    positives = [(i, i % 3) for _, i, _, _, label in rows if label == 1]
    assert got == {i: [x for j, x in positives if j < i][-3:] for i in range(10)}


@pytest.mark.parametrize("fusion", sorted(layers.FUSIONS))
@pytest.mark.parametrize("head", sorted(layers.HEADS))
def test_gradients(fusion, head):
    options = {"hidden": 8} | ({"heads": 2} if fusion != "concat" else {})
    head_options = {"mlp_final": {"hidden": (4,), "reduction": 2}, "dcnv3_fm": {"hidden": 4, "layers": 2, "factors": 2}, "cross_modal_fm": {"kg": 3, "factors": 2}}[head]
    model = layers.ctr_model(3, 4, fusion=fusion, head=head, fusion_options=options, head_options=head_options)
    rng, params = np.random.default_rng(0), model.shapes.draw(1)
    a, b, y = rng.normal(size=(5, 3)), rng.normal(size=(5, 4)), np.array([1.0, 0, 1, 1, 0])
    p = {k: Var(v) for k, v in params.items()}
    loss = run.loss_of("bce_with_logits", model.forward(p, a, b), y, 2.0)
    loss.backward()
    for name in rng.choice(sorted(params), 6):
        at = tuple(rng.integers(n) for n in params[name].shape)
        values = []
        for step in (1e-5, -1e-5):
            moved = {k: v.copy() for k, v in params.items()}
            moved[name][at] += step
            values.append(float(run.loss_of("bce_with_logits", model.forward({k: Var(v) for k, v in moved.items()}, a, b), y, 2.0).value))
        assert p[name].grad[at] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-5)


def test_training_learns(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, v[:4].tolist(), v[4:].tolist(), int(v[0] + v[5] > 0)) for i, v in enumerate(rng.normal(size=(400, 8)))]
    df = spark.createDataFrame(rows, "sample_id long, kg_vec array<double>, text_vec array<double>, label int").repartition(2).cache()
    model = layers.ctr_model(4, 4, fusion="concat", head="mlp_final", fusion_options={"hidden": 16}, head_options={"hidden": (8,)})
    params, log = run.train(df, model, epochs=6, batches=2, accumulate=2, optimiser=run.Optimiser(rate=0.03), scheduler="cosine")
    assert log[-1]["loss"] < log[0]["loss"] and max(x["auc"] for x in log) > 0.9
    run.save(spark, params, str(tmp_path / "model"))
    again = run.load(spark, str(tmp_path / "model"), model)
    a, b = (roc_auc(run.score(df, model, p), "logit", "label").first()["auc"] for p in (params, again))
    assert a == b
    assert sum(layers.parameter_counts(model).values()) == sum(v.size for v in params.values())
    for kind in ("sgd", "adam"):
        run.Optimiser(kind).step({"w": np.ones(2)}, {"w": np.ones(2)})
    assert [round(run.schedule(k, 10, 6), 3) for k in ("cosine", "step", "plateau", "none")] == [1.0, 0.5, 0.25, 1.0]


def test_graph_vectors_and_embeddings(spark):
    made = {}
    for r in catalogue.queries()["graph_vectors"](spark, SF).collect():
        made.setdefault(r["sample_id"], []).append(r["x"])
    assert made and all(len(v) == 8 and abs(np.linalg.norm(v) - 1) < 1e-4 for v in made.values())
    df = spark.createDataFrame([(1, "red shoes"), (2, "red shoes"), (3, "")], "sample_id long, text string")
    got = {r["sample_id"]: np.array(r["vec"]) for r in embed.sweep(df, {"a": embed.hashed_provider(16)}).collect()}
    assert np.allclose(got[1], got[2]) and abs(np.linalg.norm(got[1]) - 1) < 1e-5 and not got[3].any()


def test_graph_training(spark):
    from clickloom.operators import graph

    t = [(i, [("user_1", "click_history_id", f"product_{i}"), (f"product_{i}", "has_brand", "good" if i % 2 else "bad")], i % 2) for i in range(40)]
    df = spark.createDataFrame(t, "sample_id long, triples array<struct<head:string,relation:string,tail:string>>, label int")
    edges = graph.edges(df)
    cores = df.select("sample_id", F.concat(F.lit("product_"), F.col("sample_id").cast("string")).alias("core"), F.array_repeat(F.col("label").cast("double"), 32).alias("text_vector"))
    nodes = graph.node_features(edges, cores)
    in_rows = graph.features_in_rows(df, F.concat(F.lit("product_"), F.col("sample_id").cast("string")), F.array_repeat(F.col("label").cast("double"), 32))
    by_name = lambda rows: {(r["sample_id"], r["entity"]): (r["is_core"], r["features"]) for r in rows.collect()}
    assert by_name(in_rows) == by_name(nodes)
    none = spark.createDataFrame([(99, [])], df.select("sample_id", "triples").schema)
    lone = by_name(graph.features_in_rows(none, F.lit(None).cast("string"), F.array_repeat(F.lit(0.5), 32)))
    assert lone == by_name(graph.node_features(graph.edges(none), none.select("sample_id", F.lit(None).cast("string").alias("core"), F.array_repeat(F.lit(0.5), 32).alias("text_vector"))))
    assert lone[99, "placeholder"][0] and lone[99, "placeholder"][1][64:] == [0.5] * 32 + [0.0] * 4
    vec = run.graph_vectors(graph.features_in_rows(none, F.lit(None).cast("string"), F.array_repeat(F.lit(0.5), 32)), graph.edges(none)).first()["vec"]
    assert len(vec) == 128 and abs(np.linalg.norm(vec) - 1) < 1e-4
    params, losses = run.train_graph_model(nodes, edges, df, epochs=6)
    assert losses[-1] < losses[0]
    vec = run.graph_vectors(nodes, edges, params)
    assert embed.project(vec, 128, 8).first()["vec"] is not None


def test_graph_vectors_in_rows_equal_those_of_joined_graphs(spark):
    """Graphs are cut across batches, one has no triples, one has parallel edges and a loop."""
    from clickloom.operators import graph

    t = [(i, [("user_1", "click_history_id", f"product_{i + k}") for k in range(i % 5)] + [(f"product_{i}", "has_brand", "x")] * (i % 3)) for i in range(40)]
    df = spark.createDataFrame([*t, (99, []), (98, [("a", "odd", "a"), ("a", "odd", "b"), ("a", "has_price", "b")])], "sample_id long, triples array<struct<head:string,relation:string,tail:string>>").coalesce(2)
    args = F.concat(F.lit("product_"), F.col("sample_id").cast("string")), F.array_repeat(F.lit(0.5), 32)
    want = {r["sample_id"]: r["vec"] for r in run.graph_vectors(graph.features_in_rows(df, *args), graph.edges(df), double=True).collect()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = run.graph_vectors_in_rows(graph.features_in_rows(df, *args, with_edges=True), double=True)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r["sample_id"]: r["vec"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)


def test_samples(spark):
    from clickloom.operators import sampling

    df = spark.range(50)
    a, b = ([r["id"] for r in sampling.shuffled(df.repartition(n), ["id"], 7).collect()] for n in (1, 3))
    assert a == b != sorted(a) and sorted(a) == list(range(50))
    assert [r["id"] for r in sampling.head(df, 3, ["id"]).collect()] == [0, 1, 2]


def test_settings():
    assert config.ModelSettings().update(heads=8).heads == 8
    with pytest.raises(ValueError, match="unknown setting"):
        config.TrainSettings().update(speed=1)
    with pytest.raises(ValueError, match="divisible"):
        config.validate(config.ModelSettings(heads=3), config.TrainSettings())
    with pytest.raises(ValueError, match="unknown choice"):
        layers.ctr_model(4, 4, fusion="none")
    config.validate(config.ModelSettings(), config.TrainSettings())


def test_hashed_vectors_take_whole_texts():
    from clickloom.models import embed

    head = "a b " * 200
    whole, cut = embed.hashed_provider(16)(), embed.hashed_provider(16, limit=256)()
    x, y = whole([head, head + "tail " * 300])
    assert not np.allclose(x, y)
    x, y = cut([head, head + "tail " * 300])
    assert np.array_equal(x, y)
