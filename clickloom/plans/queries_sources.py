"""Queries over files, ledgers and chunks that Spark writes from the given tables and reads back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.models import tokenise
from clickloom.operators import clean, epochs
from clickloom.plans.stand_ins import table
from clickloom.sources import encoded, ledger, lines, matrix_files
from clickloom.sources.shared import shared_folder

ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"
#: Lines that the first-lines query takes: the limit is the feature.
FIRST_LINES = 500


def _order_lines(spark: SparkSession, d: str) -> str:
    """All orders as JSON lines in many files, in the order of keys; every tenth line is cut off."""
    whole = F.to_json(F.struct("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 3, F.substring(whole, 1, 20)).otherwise(whole).alias("value"))
    path = f"{shared_folder(spark)}/orders"
    rows.repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return path


def json_places(spark: SparkSession, d: str) -> DataFrame:
    return lines.numbered_json(spark, _order_lines(spark, d), ORDER_SCHEMA)


def json_first_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.numbered_json(spark, _order_lines(spark, d), ORDER_SCHEMA, limit=FIRST_LINES).select("place", "o_orderkey", "o_totalprice")


def keep_first_by_place(spark: SparkSession, d: str) -> DataFrame:
    rows = lines.numbered_json(spark, _order_lines(spark, d), ORDER_SCHEMA)
    return clean.dedup_first(rows, ["o_custkey"], [F.col("place")]).select("o_custkey", "o_orderkey", "o_orderpriority", "place")


def _model(prompt: str) -> str:
    """A stand-in for a model that states triples of an item and judges them.

    It refuses every fifth item at first, invents a brand for every seventh twice, knows
    nothing of every thirteenth, and fails to judge the category of every eleventh.
    """
    asked, attempt, text, *told = prompt.split("|")
    number = int(re.search(r"product_(\d+)", text)[1])
    if asked == "judge":
        relation, tail = told
        if relation == "has_category" and number % 11 == 0:
            return "hard to say"
        return ledger.fenced({"valid": tail in text, "reason": "as the text has it", "confidence": 0.9})
    if number % 5 == 0 and attempt == "1":
        return "sorry"
    if number % 13 == 0:
        return "[]"
    head, brand, kind = re.fullmatch(r"(product_\d+) of (.*) is (.*)", text).groups()
    if number % 7 == 0 and attempt in "12":
        return ledger.fenced([{"head": head, "relation": "has_brand", "tail": "nobody"}])
    return ledger.fenced([{"head": head, "relation": r, "tail": t} for r, t in (("has_brand", brand), ("has_category", kind), ("click_history_id", "product_1"))])


def kg_verdict_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Triples of all items by a model that states and judges, in three rounds at most."""
    told = table(spark, d, "part").select("p_partkey", F.concat_ws("", F.lit("product_"), F.col("p_partkey").cast("string"), F.lit(" of "), "p_brand", F.lit(" is "), "p_type").alias("text"))

    def generate(source, attempt):
        return F.concat_ws("|", F.lit("state"), F.lit(str(attempt)), source)

    def judge(source, t):
        return F.concat_ws("|", F.lit("judge"), F.lit("-"), source, t["relation"], t["tail"])

    found = ledger.extract_with_verdicts(told, "p_partkey", "text", ledger.scripted(_model), f"{shared_folder(spark)}/asked", forbidden=("click_history_id",), generate=generate, judge=judge)
    shown = F.array_join(F.transform("triples", lambda t: F.concat_ws(" ", t["relation"], t["tail"])), "; ")
    return found.select("p_partkey", "attempts", "n_candidates", "n_valid", "n_invalid", shown.alias("shown"))


VERDICT_ROUNDS = """
WITH tries AS (
  SELECT p_partkey, p_brand, p_type, a, CASE WHEN p_partkey % 5 = 0 AND a = 1 OR p_partkey % 13 = 0 THEN 0 WHEN p_partkey % 7 = 0 AND a < 3 THEN 1 ELSE 2 END AS n,
    CASE WHEN p_partkey % 5 = 0 AND a = 1 OR p_partkey % 13 = 0 OR p_partkey % 7 = 0 AND a < 3 THEN 0 WHEN p_partkey % 11 = 0 THEN 1 ELSE 2 END AS good
  FROM part, (SELECT unnest([1, 2, 3]) AS a)
), ends AS (SELECT p_partkey, least(coalesce(min(a) FILTER (good > 0), 3), 3) AS attempts FROM tries GROUP BY p_partkey
)
SELECT p_partkey, attempts::INTEGER AS attempts, sum(n)::BIGINT AS n_candidates, sum(good)::BIGINT AS n_valid, sum(n - good)::BIGINT AS n_invalid,
  CASE max(good) WHEN 0 THEN '' WHEN 1 THEN 'has_brand ' || any_value(p_brand) ELSE 'has_brand ' || any_value(p_brand) || '; has_category ' || any_value(p_type) END AS shown
FROM tries JOIN ends USING (p_partkey) WHERE a <= attempts GROUP BY p_partkey, attempts
"""

#: Pieces of the query's vocabulary, longest first where they compete; ids follow the padding and the unknown token.
PIECES = ("tion", "ing", "the", "and", "en", "er", "es", "on", "th", *"abcdefghijklmnopqrstuvwxyz0123456789")
WIDTH = 256


def subword_masks(spark: SparkSession, d: str) -> DataFrame:
    """Ids and masks of all documents, of one width."""
    vocabulary = {p: k + 2 for k, p in enumerate(PIECES)}
    rows = tokenise.tokenise(table(spark, d, "documents"), vocabulary, WIDTH, padding=0, unknown=1, ending="", key="doc_id")
    padded = F.size(F.filter("ids", lambda i: i == 0))
    masked = F.aggregate(F.zip_with("ids", "mask", lambda i, m: i * m), F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.select("doc_id", "n_tokens", F.size("ids").alias("width"), F.aggregate("mask", F.lit(0), lambda n, m: n + m).alias("mask_sum"), padded.alias("padded"), masked.alias("id_sum"), (F.col("n_tokens") > WIDTH).alias("cut"))


_TOKEN_LISTS = f"""SELECT doc_id, flatten([CASE WHEN regexp_full_match(w, '[a-z0-9]+') THEN regexp_extract_all(w, '{"|".join(p for p in PIECES if len(p) > 1)}|[a-z0-9]') ELSE ['?'] END
  for w in regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]')]) AS t FROM documents"""

SUBWORDS = f"""WITH lists AS ({_TOKEN_LISTS})
SELECT doc_id, len(t)::BIGINT AS n_tokens, {WIDTH} AS width, least(len(t), {WIDTH})::INTEGER AS mask_sum, ({WIDTH} - least(len(t), {WIDTH}))::INTEGER AS padded,
  coalesce(list_sum([CASE WHEN x = '?' THEN 1 ELSE list_position([{", ".join(f"'{p}'" for p in PIECES)}], x) + 1 END for x in t[1:{WIDTH}]]), 0)::BIGINT AS id_sum, len(t) > {WIDTH} AS cut FROM lists"""

CHUNK_ROWS, CHUNKS_A_BATCH, EPOCH = 1024, 3, 1


def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    """Where an epoch puts all orders: chunk, place of the chunk, and batch."""
    path = f"{shared_folder(spark)}/chunks"
    n = epochs.write_chunks(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], path, CHUNK_ROWS)
    plan = epochs.epoch_plan(spark, EPOCH, n, CHUNKS_A_BATCH)
    return spark.read.parquet(path).join(F.broadcast(plan), "chunk").select("o_orderkey", "o_custkey", "chunk", "place", "batch")


EPOCH_ORDER = f"""
WITH RECURSIVE n AS (SELECT ((count(*) + {CHUNK_ROWS - 1}) // {CHUNK_ROWS})::BIGINT AS n FROM orders
), h AS (SELECT n, greatest((length(bin(n - 1)) + 1) // 2, 1)::INTEGER AS half FROM n
), walk AS (
  SELECT k, n, half, k >> half AS l, k & ((1::BIGINT << half) - 1) AS r, 0 AS i FROM h, (SELECT unnest(range(n)) AS k FROM n)
  UNION ALL SELECT k, n, half, r, xor(l, ('0x' || left(md5('42|{EPOCH}|' || (i % {epochs.ROUNDS}) || '|' || r), 8))::BIGINT & ((1::BIGINT << half) - 1)), i % {epochs.ROUNDS} + 1
  FROM walk WHERE i < {epochs.ROUNDS} OR (l << half | r) >= n
), plan AS (SELECT k AS place, (l << half | r) AS chunk FROM walk WHERE i = {epochs.ROUNDS} AND (l << half | r) < n
), dealt AS (SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) // {CHUNK_ROWS} AS chunk FROM orders)
SELECT o_orderkey, o_custkey, chunk::INTEGER AS chunk, place::INTEGER AS place, (place // {CHUNKS_A_BATCH})::INTEGER AS batch FROM dealt JOIN plan USING (chunk)
"""


def text_encodings(spark: SparkSession, d: str) -> DataFrame:
    """All items as lines of files in three encodings, told apart and read by ranges of bytes."""
    top = f"{shared_folder(spark)}/texts"
    named = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.lit("caf\u00e9"), "p_name").alias("name"))
    for k, charset in enumerate(("UTF-8", "UTF-16LE", "ISO-8859-1")):
        named.where(F.col("p_partkey") % 3 == k).write.option("encoding", charset).json(f"{top}/{k}")
    rows = encoded.read_encoded(spark, f"{top}/*/*.json", range_bytes=1 << 16)
    return rows.select(F.from_json("line", "p_partkey bigint, name string").alias("r"), "encoding").select("r.p_partkey", "r.name", "encoding")


def matrix_rows(spark: SparkSession, d: str) -> DataFrame:
    """All whole vectors of 64 components as a matrix of files, read back by ranges of rows."""
    path = f"{shared_folder(spark)}/matrix"
    whole = table(spark, d, "embeddings").where((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull()))
    matrix_files.write_npy(whole, path, key="vec_id", vector="embedding", part_bytes=1 << 18)
    rows = matrix_files.read_npy(spark, path, range_bytes=1 << 16)
    return rows.select("row", F.size("vec").alias("width"), F.col("vec")[0].alias("first"), F.col("vec")[63].alias("last"), F.array_max("vec").alias("largest"))


TEXT_ENCODINGS = """SELECT p_partkey, 'caf\u00e9 ' || p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-le' ELSE 'latin-1' END AS encoding FROM part"""
MATRIX_ROWS = """
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, 64 AS width, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, list_max(embedding)::DOUBLE AS largest
FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0
"""

_PLACED = "placed AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, * FROM orders), good AS (SELECT * FROM placed WHERE o_orderkey % 10 <> 3)"

QUERIES = {
    "json_places": (json_places, f"WITH {_PLACED} SELECT place, o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM good"),
    "json_first_lines": (json_first_lines, f"WITH {_PLACED} SELECT place, o_orderkey, o_totalprice FROM good WHERE place < {FIRST_LINES}"),
    "keep_first_by_place": (keep_first_by_place, f"WITH {_PLACED} SELECT o_custkey, o_orderkey, o_orderpriority, place FROM good QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY place) = 1"),
    "kg_verdict_rounds": (kg_verdict_rounds, VERDICT_ROUNDS),
    "subword_masks": (subword_masks, SUBWORDS),
    "epoch_order": (epoch_order, EPOCH_ORDER),
    "text_encodings": (text_encodings, TEXT_ENCODINGS),
    "matrix_rows": (matrix_rows, MATRIX_ROWS),
}
