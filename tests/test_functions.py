"""Golden rows of the scalar expressions."""

import hashlib

import pytest
from pyspark.sql import functions as F, types as T

from clickloom.functions import entities, numbers, text, vectors


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (text.clean_text, " a\nb   c ", "a b c"),
        (lambda c: text.clean_text(c, compat=True), " a\nb   c ", "ab c"),
        (text.clean_text, None, "unknown"),
        (text.clean_text, "", "unknown"),
        (text.clean_rank, "1,234 in Beauty (See Top 100)", "1,234 in Beauty"),
        (text.clean_rank, "", "unknown"),
        (text.rank_digits, "1,234 in Beauty", "1,234"),
        (text.rank_digits, "unknown", "unknown"),
        (text.style_text, "{'Size:': 'Large'}", "Size: : Large"),
        (text.style_text, "{plain}", "plain"),
        (text.style_text, "none", "unknown"),
        (text.clean_html, "Women's Shirt, size M", "Womens shirt , size m"),
        (text.clean_html, "<script>x</script><b>Hi</b><i>there</i> http://a.b c", "Hi there c"),
        (text.clean_html, None, "unknown"),
        (lambda c: text.standardise_list(text.clean_html(c, compat=True)), "product_1 and product_2 and product_1", "Product_1, Product_2"),
        (lambda c: text.standardise_list(text.clean_html(c, capitalised=False)), "product_1 and product_2 and product_1", "product_1, product_2"),
        (lambda c: text.clean_html(c, compat=True), "Women's Shirt, size M", "Womens shirt , size m"),
        (lambda c: text.clean_html(c, compat=True), "Why?!<b>so</b>", "Why ?! so"),
        (text.clean_html, "a&lt;b&gt;c&lt;/b&gt; see WWW.x.y (now)", "A c see ( now )"),
        (text.extract_attributes, "ASIN: B00AND12X and more", "And more"),
        (text.extract_attributes, "Shipping Weight:: 3 Ounces and ASIN: B0 and Item Weight: 1 Pound", "Shipping weight: 3 ounces; Item weight: 1 pound"),
        (text.standardise_list, "product_1 and product_2 and product_1", "product_1, product_2"),
        (text.standardise_list, "unknown", "unknown"),
        (text.clicked, "None", "nothing"),
        (text.clicked, "nan", "nothing"),
        (text.clicked, None, "nothing"),
        (text.one_line, "a\nb\rc", "a b c"),
        (text.one_line, None, ""),
        (lambda c: text.truncate_words(c, 7), "abc def ghi", "abc"),
        (lambda c: text.truncate_words(c, 7), "abcdefghij", "abcdefg"),
        (lambda c: text.truncate_words(c, 20), "abc def ghi", "abc def ghi"),
        (lambda c: F.to_json(text.parse_triples(c)), 'nonsense', "[]"),
        (lambda c: F.to_json(text.parse_triples(c)), '```json\n[{"head":"a","relation":"b","tail":"c",},]\n```', '[{"head":"a","relation":"b","tail":"c"}]'),
        (lambda c: F.array_join(text.split_related(c), "|"), "B01 and B02; brandX", "B01|B02|brandX"),
        (lambda c: F.array_join(text.split_related(c, compat=True), "|"), "brandX", "br|X"),
        (text.clean_related_html, "<a href='x'>A & B</a> http://u.v (c)", "A & B  c"),
        (numbers.format_epoch, "0", "1970-01-01 00:00:00"),
        (numbers.format_epoch, "soon", "unknown"),
        (numbers.format_date, "2014-01-02", "2014-01-02"),
        (entities.entity_type, "user_1", "user"),
        (entities.entity_type, "product_1", "product"),
        (entities.entity_type, "Product_1", "other"),
        (text.extract_attributes, "Item Weight: 2 Pounds (x)", "Item weight: 2 pounds"),
    ],
)
def test_text(spark, expr, value, want):
    assert one(spark, expr, value) == want


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (numbers.parse_price, "$10.00 - $20.00", 15.0),
        (numbers.parse_price, "$1,299.00", 1299.0),
        (lambda c: numbers.parse_price(c, compat=True), "$1,299.00", 1.0),
        (numbers.parse_price, "unknown", None),
        (numbers.parse_price, "call", None),
        (numbers.reclean_price, "27.99", 27.99),
        (numbers.reclean_price, "1234.5", 1234.5),
        (numbers.reclean_price, "$1,234.50 new", 1234.5),
        (lambda c: numbers.reclean_price(c, compat=True), "27.99", 27.0),
        (lambda c: numbers.reclean_price(c, compat=True), "1234.5", 123.0),
        (numbers.reclean_price, "unknown", None),
        (entities.relation_weight, "click_history_id", 2.0),
        (entities.relation_weight, "HAS_BRAND", 1.0),
        (entities.relation_weight, "x", 0.5),
        (lambda c: entities.entity_hash(c)[0], "user_83", 187 / 255),
    ],
)
def test_numbers(spark, expr, value, want):
    assert one(spark, expr, value) == want


@pytest.mark.parametrize(("rating", "label", "neutral"), [(5.0, 1, False), (4.0, 1, False), (3.0, 0, True), (2.0, 0, False), (None, 0, False)])
def test_labels(spark, rating, label, neutral):
    assert one(spark, numbers.label_of, rating, "double") == label
    assert one(spark, numbers.is_neutral, rating, "double") is neutral


def test_nested(spark):
    assert one(spark, text.flatten_map, {"A": ["1", "2"], "B": [""]}, "map<string,array<string>>") == "A: 1 and 2"
    assert one(spark, text.flatten_list, [], "array<string>") == "unknown"
    assert one(spark, text.join_items, ["x", "", "y", None], "array<string>") == "x and y"
    style = F.create_map(F.lit("Size:"), F.lit(" Large"), F.lit("Color:"), F.lit(" Red"))
    assert spark.range(1).select(text.style_map(style)).first()[0] == "Size: Large and Color: Red"


def test_deep_nesting(spark):
    df = spark.createDataFrame([({"a": [[{"b": "x\ny", "": "no"}], None, []], " ": [[{"b": "z"}]]},), (None,)], "v map<string,array<array<map<string,string>>>>")
    kind = df.schema["v"].dataType
    assert [r[0] for r in df.select(text.flatten_nested(F.col("v"), kind)).collect()] == ["a: b: x y", "unknown"]
    value, deep = "'x'", T.StringType()
    for _ in range(text.MAX_DEPTH + 1):
        deep = T.ArrayType(deep)
    assert text.flatten_items(F.lit(None), deep, depth=0) is not None  # the plan ends at the limit
    near = spark.sql(f"SELECT array(array(array({value}))) AS v")
    three = T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))
    assert near.select(text.flatten_items(F.col("v"), three, depth=text.MAX_DEPTH - 3)).first()[0] == ["x"]
    assert near.select(text.flatten_items(F.col("v"), three, depth=text.MAX_DEPTH - 2)).first()[0] == []


def test_vectors(spark):
    v = one(spark, vectors.l2_normalise, [3.0, 4.0], "array<float>")
    assert v == pytest.approx([0.6, 0.8])
    assert one(spark, lambda c: vectors.clamp(c, -1, 1), [-5.0, 0.5, 5.0], "array<double>") == [-1, 0.5, 1]
    assert one(spark, lambda c: vectors.bce_with_logits(c, F.lit(1)), 0.0, "double") == pytest.approx(0.6931471805599453)
    assert one(spark, lambda c: vectors.smooth_l1(c, F.lit(0.0)), 3.0, "double") == 2.5
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1.0, 0.0])], "t array<array<double>>, m array<double>")
    got = df.select(vectors.masked_mean(F.col("t"), F.col("m"), 2).alias("a"), vectors.last_pool(F.col("t"), F.col("m")).alias("b"), vectors.last_pool(F.col("t"), F.array(F.lit(0.0), F.lit(0.0))).alias("c")).first()
    assert got["a"] == [1, 2] and got["b"] == [1, 2] and got["c"] == [3, 4]


def test_list_standardising_is_idempotent(spark):
    value = "a; b and c, a & d、e"
    once = one(spark, text.standardise_list, value)
    assert once == "a, b, c, d, e" and one(spark, text.standardise_list, once) == once


def test_capitals_are_single_characters(spark):
    """As in SQL: no character becomes several, none depends on its place in a word."""
    rows = [("ßie Straße",), ("ﬁne",), ("ᾳ",), ("éa",), ("xΑΣ ΟΣ İ",), ("",), (None,), ("ǆ",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(text.capitalise(F.col("t"))).collect()] == ["ẞie straße", "ﬁne", "ᾼ", "Éa", "Xας ος i".replace("ς", "σ"), "", None, "Ǆ"]


def test_bytes_of_a_hash_are_compiled(spark):
    """The digest is computed once a row, and its bytes in generated code: no lambda, no array that is cut."""
    df = spark.createDataFrame([("user_83",), (None,)], "e string").select(entities.entity_hash(F.col("e"), 4).alias("h"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "slice" not in plan
    assert [round(x * 255) for x in df.first()["h"]] == list(hashlib.sha256(b"83").digest()[:4])
