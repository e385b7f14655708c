"""The stages end to end: raw reviews and metadata to labelled rows, splits, prompts and graphs.

Each stage is one lazy plan from tables to a table; what joins them is data, not
files that are inferred anew. ``compat`` reproduces the replaced pipeline's results
where those differ from the plain reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickloom.functions import numbers, text
from clickloom.operators import clean, dictionary, graph, history, prompt, split
from clickloom.sources import ledger

UNKNOWN_USER, UNKNOWN_ITEM = "unknown_user", "unknown_asin"


def dictionaries(reviews: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users of all reviews; items of reviews and metadata."""
    return dictionary.build_dictionary([reviews.select("reviewerID")], UNKNOWN_USER), dictionary.build_dictionary([reviews.select("asin"), meta.select("asin")], UNKNOWN_ITEM)


def process(reviews: DataFrame, meta: DataFrame, users: DataFrame, item_ids: DataFrame, domain: str, scenario_id: int, k: int = 3, compat: bool = False) -> DataFrame:
    """Raw reviews and metadata to the processed table, with ``sample_id`` in front.

    Both inputs carry ``src_idx``, their order in the source. The price mean is taken
    over the joined rows before neutral ratings go; histories come after.
    """
    related = {c: F.col(c) for c in ("also_buy", "also_view", "similar_item") if c in meta.columns}
    lists = meta.select("asin", "src_idx", *[(text.split_related(text.clean_related_html(c), compat) if dict(meta.dtypes)[n] == "string" else F.filter(F.transform(c, text.clean_related_html), lambda x: x != "")).alias(f"_{n}") for n, c in related.items()])
    told = clean.impute(clean.drop_excluded(meta).drop(*related), compat).withColumn("src_idx", F.col("src_idx"))
    told = clean.dedup_first(told, ["asin"], [F.col("src_idx")]).drop("src_idx")
    lists = clean.dedup_first(lists, ["asin"], [F.col("src_idx")]).drop("src_idx")
    rows = clean.impute(clean.drop_excluded(reviews), compat).withColumn("sample_id", F.col("src_idx"))
    rows = rows.join(told, "asin", "left").join(lists, "asin", "left")
    for c in told.columns:
        if c != "asin" and dict(rows.dtypes)[c] == "string":
            rows = rows.withColumn(c, F.coalesce(c, F.lit(text.UNKNOWN)))
    if "price" in rows.columns:
        rows = clean.fill_with_mean(rows.withColumn("price", numbers.parse_price(F.col("price"), compat)), "price")
    rows = rows.withColumn("_time", numbers.parse_time(F.col("unixReviewTime"))).withColumn("unixReviewTime", numbers.format_epoch(F.col("unixReviewTime").cast("string")))
    rows = dictionary.encode(rows, users, F.col("reviewerID"), UNKNOWN_USER, "user_id").withColumn("user_name", F.col("reviewerName"))
    rows = dictionary.encode(rows.withColumnRenamed("asin", "asin_original"), item_ids, F.col("asin_original"), UNKNOWN_ITEM, "asin")
    for n in related:
        limit = None if n == "similar_item" else 5
        rows = dictionary.encode_list(rows, item_ids, "sample_id", F.col(f"_{n}"), UNKNOWN_ITEM, n, limit).drop(f"_{n}")
    rows = rows.where(~numbers.is_neutral(F.col("overall")))
    if not compat:
        rows = rows.where("overall is not null")
    rows = rows.withColumn("label", numbers.label_of(F.col("overall")))
    item = F.struct(F.col("asin").alias("id"), F.regexp_replace("title", ";", ",").alias("title"))
    rows = history.click_history(rows, "user_id", ["_time", "sample_id"], F.col("label") == 1, item, k, F.date_trunc("quarter", "_time"), "_h")
    rows = rows.withColumn("user_hist_id", history.render_ids(F.col("_h.id"))).withColumn("user_hist_title", history.render_titles(F.col("_h.title")))
    rows = rows.withColumn("Domain", F.lit(domain)).withColumn("scenario_id", F.lit(scenario_id))
    return clean.finalise(rows, ("sample_id", *clean.FINAL_COLUMNS))


def split_stage(processed: DataFrame) -> DataFrame:
    """Rows of each domain by time into train, valid and test."""
    return split.chronological_split(processed, numbers.parse_time(F.col("unixReviewTime")), [F.col("sample_id")], ["Domain"])


def prompt_stage(rows: DataFrame) -> DataFrame:
    """(sample_id, text)."""
    return rows.select("sample_id", prompt.prompt_text(rows.drop("sample_id", "label")).alias("text"))


def model_graph_stage(rows: DataFrame, prompts: DataFrame, split_name: str, make_client, path: str, rounds: int = 3) -> DataFrame:
    """(sample_id, triples): stated and confirmed by a model in rounds, completed."""
    told = prompts.withColumn("_cut", text.truncate_words(text.collapse(F.col("text"))))
    found = ledger.extract_with_verdicts(told, "sample_id", "_cut", make_client, path, rounds, graph.TEST_FORBIDDEN if split_name == "test" else ())
    found = found.join(rows.select("sample_id", F.col("Domain").alias("_domain")), "sample_id").join(prompts, "sample_id")
    return found.select("sample_id", graph.complete_titles(graph.complete_scenarios(F.col("triples"), F.col("_domain")), F.col("text")).alias("triples"))


def graph_stage(rows: DataFrame, prompts: DataFrame, split_name: str) -> DataFrame:
    """(sample_id, triples): extracted by rule, validated against the prompt, completed."""
    ids = F.transform(F.filter(F.split("user_hist_id", " and "), lambda x: F.startswith(x, F.lit("product_"))), lambda x: F.replace(x, F.lit("product_"), F.lit(""))) if "user_hist_id" in rows.columns else None
    found = rows.select("sample_id", F.col("Domain").alias("_domain"), graph.rule_triples(rows, ids).alias("triples")).join(prompts, "sample_id")
    triples = graph.allowed(F.col("triples"), graph.TEST_FORBIDDEN if split_name == "test" else ())
    found = found.withColumn("triples", graph.validate(triples, F.col("text")))
    return found.select("sample_id", graph.complete_titles(graph.complete_scenarios(F.col("triples"), F.col("_domain")), F.col("text")).alias("triples"))
