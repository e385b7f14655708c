"""The driver's tables in the roles of the click-through-rate data, in Spark and in SQL.

``events`` is the interaction log (item from ``props``, rating by event type), ``part``
the item metadata, ``pages`` the HTML, ``documents`` and ``conversations`` the texts,
``embeddings`` the vectors, ``labels`` the labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The rating that an event type stands for.
RATINGS = {"purchase": 5.0, "click": 4.0, "view": 3.0, "signup": 2.0, "error": 1.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_idx, user_id, item, ts, overall) of all events."""
    rating = F.lit(None).cast("double")
    for kind, value in RATINGS.items():
        rating = F.when(F.col("event_type") == kind, value).otherwise(rating)
    item = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("src_idx"), "user_id", item.alias("item"), "ts", rating.alias("overall"))


INTERACTIONS = """interactions AS (
  SELECT event_id AS src_idx, user_id, json_extract_string(props, '$.k')::INTEGER AS item, ts,
    CASE event_type WHEN 'purchase' THEN 5.0::DOUBLE WHEN 'click' THEN 4.0::DOUBLE WHEN 'view' THEN 3.0::DOUBLE WHEN 'signup' THEN 2.0::DOUBLE WHEN 'error' THEN 1.0::DOUBLE END AS overall
  FROM events)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, title, brand, category, price, src_idx): metadata rows, several an item."""
    part = table(spark, sf_dir, "part")
    return part.select((F.col("p_partkey") % 100).cast("int").alias("item"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("src_idx"))


ITEMS = """items AS (SELECT (p_partkey % 100)::INTEGER AS item, p_name AS title, p_brand AS brand, p_type AS category, p_retailprice AS price, p_partkey AS src_idx FROM part)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled samples with history and the item's first metadata row: the processed table's columns."""
    from clickloom.functions.numbers import is_neutral, label_of
    from clickloom.operators.clean import dedup_first
    from clickloom.operators.history import click_history

    rows = interactions(spark, sf_dir).where(~is_neutral(F.col("overall"))).withColumn("label", label_of(F.col("overall")))
    rows = click_history(rows, "user_id", ["ts", "src_idx"], F.col("label") == 1, F.col("item"), segment=F.date_trunc("week", "ts"))
    meta = dedup_first(items(spark, sf_dir), ["item"], [F.col("src_idx")]).drop("src_idx")
    # the stand-in has 100 items at any size: a join by item would send all samples to as few tasks
    return rows.join(F.broadcast(meta), "item", "left").select(F.col("src_idx").alias("sample_id"), "user_id", F.col("item").alias("asin"), "title", "brand", "category", "price", "label", "ts", "history")


#: History by row numbers: the k-th last positive before a row.
SAMPLES = f"""{INTERACTIONS}, {ITEMS}, labelled AS (
  SELECT *, CASE WHEN overall > 3 THEN 1 ELSE 0 END AS label FROM interactions WHERE overall IS DISTINCT FROM 3
), hist AS (
  SELECT *, coalesce(list(item) FILTER (label = 1) OVER (PARTITION BY user_id ORDER BY ts, src_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])[-3:] AS history FROM labelled
), meta AS (SELECT item, title, brand, category, price FROM items QUALIFY row_number() OVER (PARTITION BY item ORDER BY src_idx) = 1
), samples AS (
  SELECT src_idx AS sample_id, user_id, item AS asin, title, brand, category, price, label, ts, history FROM hist LEFT JOIN meta USING (item))"""
