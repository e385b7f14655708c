"""Queries of ingestion, joins, dictionaries, histories, splits and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import numbers, text
from clickloom.operators import clean, dictionary, history, quality, split
from clickloom.plans.stand_ins import INTERACTIONS, ITEMS, SAMPLES, interactions, items, samples, table



def _labelled(spark, d):
    return interactions(spark, d).where(~numbers.is_neutral(F.col("overall"))).withColumn("label", numbers.label_of(F.col("overall")))


LABELLED = f"{INTERACTIONS}, labelled AS (SELECT *, CASE WHEN overall > 3 THEN 1 ELSE 0 END AS label FROM interactions WHERE overall IS DISTINCT FROM 3)"
HIST = f"""{LABELLED}, hist AS (
  SELECT *, coalesce(list(item) FILTER (label = 1) OVER (PARTITION BY user_id ORDER BY ts, src_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])[-3:] AS h FROM labelled)"""


def _history(spark, d):
    return history.click_history(_labelled(spark, d), "user_id", ["ts", "src_idx"], F.col("label") == 1, F.col("item"), segment=F.date_trunc("week", "ts"))


def hist_ids(spark, d):
    return _history(spark, d).select("src_idx", "user_id", "item", "label", history.render_ids(F.col("history")).alias("user_hist_id"))


HIST_IDS = f"WITH {HIST} SELECT src_idx, user_id, item, label, CASE WHEN len(h) = 0 THEN 'unknown' ELSE array_to_string(['product_' || x for x in h], ' and ') END AS user_hist_id FROM hist"


def hist_titles(spark, d):
    titles = clean.dedup_first(items(spark, d).where(~text.is_blank(F.col("title"))), ["item"], [F.col("src_idx")]).select("item", F.regexp_replace("title", ";", ",").alias("title"))
    rows = _labelled(spark, d).join(titles, "item", "left").withColumn("shown", F.coalesce("title", F.lit("unknown")))
    rows = history.click_history(rows, "user_id", ["ts", "src_idx"], F.col("label") == 1, F.col("shown"), segment=F.date_trunc("week", "ts"))
    return rows.select("src_idx", "user_id", history.render_titles(F.col("history")).alias("user_hist_title"))


HIST_TITLES = f"""WITH {LABELLED}, {ITEMS}, titles AS (SELECT item, replace(title, ';', ',') AS title FROM items WHERE title IS NOT NULL AND lower(trim(title)) NOT IN ('', 'nan', 'none', 'unknown') QUALIFY row_number() OVER (PARTITION BY item ORDER BY src_idx) = 1),
named AS (SELECT l.*, coalesce(title, 'unknown') AS shown FROM labelled l LEFT JOIN titles USING (item)),
hist AS (SELECT *, coalesce(list(shown) FILTER (label = 1) OVER (PARTITION BY user_id ORDER BY ts, src_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])[-3:] AS h FROM named)
SELECT src_idx, user_id, CASE WHEN len(h) = 0 THEN 'unknown' ELSE array_to_string(['product ''' || x || '''' for x in h], ' and ') END AS user_hist_title FROM hist"""


def hist_coverage(spark, d):
    known = F.size("history") > 0
    return _history(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(known, 1)).alias("n_known"), F.bround(F.avg(known.cast("double")) * 100, 2).alias("pct_known"))


HIST_COVERAGE = f"WITH {HIST} SELECT count(*) AS n_rows, count(*) FILTER (len(h) > 0) AS n_known, round_even(avg((len(h) > 0)::INTEGER::DOUBLE) * 100, 2) AS pct_known FROM hist"


def label_drop_neutral(spark, d):
    return _labelled(spark, d).select("src_idx", "user_id", "item", "overall", "label")


def positive_ratio(spark, d):
    return quality.positive_ratio(_labelled(spark, d), F.col("label"), ["user_id"])


def meta_dedup_first(spark, d):
    return clean.dedup_first(items(spark, d), ["item"], [F.col("src_idx")])


def item_first_title(spark, d):
    rows = items(spark, d).where(~text.is_blank(F.col("title")))
    return rows.groupBy("item").agg(F.regexp_replace(F.min_by("title", "src_idx"), ";", ",").alias("title"))


def review_meta_left_join(spark, d):
    meta = clean.dedup_first(items(spark, d), ["item"], [F.col("src_idx")]).select("item", "title", "brand", "price")
    return interactions(spark, d).join(meta, "item", "left").select("src_idx", "user_id", "item", "title", "brand", "price")


def join_unmatched(spark, d):
    """Of doubled item ids, those that no item has."""
    rows = interactions(spark, d).withColumn("item", F.col("item") * 2)
    return rows.join(items(spark, d).select("item"), "item", "left_anti").groupBy("item").agg(F.count(F.lit(1)).alias("n_rows"))


def user_dictionary(spark, d):
    return dictionary.build_dictionary([interactions(spark, d).select("user_id")], "unknown_user")


USER_DICT = f"WITH {INTERACTIONS}, v AS (SELECT DISTINCT user_id::VARCHAR AS value FROM interactions WHERE user_id IS NOT NULL UNION SELECT 'unknown_user') SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx FROM v"


def item_dictionary(spark, d):
    return dictionary.build_dictionary([interactions(spark, d).select("item"), table(spark, d, "part").select("p_partkey")], "unknown_asin")


ITEM_DICT_CTE = f"{INTERACTIONS}, v AS (SELECT DISTINCT item::VARCHAR AS value FROM interactions WHERE item IS NOT NULL UNION SELECT p_partkey::VARCHAR FROM part WHERE p_partkey IS NOT NULL UNION SELECT 'unknown_asin'), dict AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx FROM v)"


def encode_unknown(spark, d):
    """Items from 50 on carry a letter, which no known one has."""
    known = dictionary.build_dictionary([table(spark, d, "part").select("p_partkey")], "unknown_asin")
    named = F.concat(F.col("item").cast("string"), F.when(F.col("item") >= 50, "x").otherwise(""))
    return dictionary.encode(interactions(spark, d), known, named, "unknown_asin", "asin").select("src_idx", "item", "asin")


ENCODE = f"""WITH {INTERACTIONS}, v AS (SELECT DISTINCT p_partkey::VARCHAR AS value FROM part UNION SELECT 'unknown_asin'), dict AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx FROM v)
SELECT src_idx, item, coalesce(idx, (SELECT idx FROM dict WHERE value = 'unknown_asin')) AS asin FROM interactions LEFT JOIN dict ON item::VARCHAR || CASE WHEN item >= 50 THEN 'x' ELSE '' END = value"""


def _cell():
    return F.concat_ws("; ", *[((F.col("p_partkey") * k) % 150).cast("string") for k in (1, 3, 7)], F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") % 50).cast("string"), F.lit(" and "), (F.col("p_size") % 9).cast("string"), F.lit(" and x"))))

CELL_SQL = "concat_ws('; ', ((p_partkey * 1) % 150)::VARCHAR, ((p_partkey * 3) % 150)::VARCHAR, ((p_partkey * 7) % 150)::VARCHAR, CASE WHEN p_size % 2 = 0 THEN (p_size % 50)::VARCHAR || ' and ' || (p_size % 9)::VARCHAR || ' and x' END)"


def _related(spark, d, limit):
    part = table(spark, d, "part").select("p_partkey", text.split_related(_cell()).alias("related"))
    known = dictionary.build_dictionary([table(spark, d, "part").select("p_partkey")], "unknown_asin")
    return dictionary.encode_list(part, known, "p_partkey", F.col("related"), "unknown_asin", "also_buy", limit).select("p_partkey", "also_buy")


def related_items_encode(spark, d):
    return _related(spark, d, None)


def related_top5(spark, d):
    return _related(spark, d, 5)


def _related_sql(limit):
    cut = f"[1:{limit}]" if limit else ""
    return f"""WITH v AS (SELECT DISTINCT p_partkey::VARCHAR AS value FROM part UNION SELECT 'unknown_asin'), dict AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx FROM v),
cells AS (SELECT p_partkey, (list_filter([trim(x) for x in regexp_split_to_array({CELL_SQL}, ';|\\band\\b')], lambda x: x <> '')){cut} AS l FROM part),
each AS (SELECT p_partkey, unnest(l) AS item, unnest(range(len(l))) AS pos FROM cells)
SELECT p_partkey, string_agg('product_' || coalesce(idx, (SELECT idx FROM dict WHERE value = 'unknown_asin')), ' and ' ORDER BY pos) AS also_buy FROM each LEFT JOIN dict ON item = value GROUP BY p_partkey"""



def _price():
    return F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("$"), F.format_string("%.2f", "p_retailprice"), F.lit(" - $"), F.format_string("%.2f", F.col("p_retailprice") + 10))).when(F.col("p_partkey") % 5 == 1, "unknown").when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("$1,"), F.format_string("%.2f", (F.col("p_partkey") % 900 + 100).cast("double")))).when(F.col("p_partkey") % 5 == 3, "ask us").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", "p_retailprice")))

PRICE_SQL = "CASE WHEN p_partkey % 5 = 0 THEN '$' || printf('%.2f', p_retailprice) || ' - $' || printf('%.2f', p_retailprice + 10) WHEN p_partkey % 5 = 1 THEN 'unknown' WHEN p_partkey % 5 = 2 THEN '$1,' || printf('%.2f', (p_partkey % 900 + 100)::DOUBLE) WHEN p_partkey % 5 = 3 THEN 'ask us' ELSE '$' || printf('%.2f', p_retailprice) END"
PARSED_SQL = f"""priced AS (SELECT p_partkey, p_brand, {PRICE_SQL} AS t FROM part), nums AS (SELECT p_partkey, p_brand, t, [x::DOUBLE for x in regexp_extract_all(regexp_replace(t, '(\\d),(\\d\\d\\d)', '\\1\\2', 'g'), '\\d+\\.?\\d*')] AS n FROM priced),
parsed AS (SELECT p_partkey, p_brand, CASE WHEN t <> 'unknown' THEN round_even(CASE WHEN contains(t, '-') AND len(n) >= 2 THEN (n[1] + n[2]) / 2 ELSE n[1] END, 2) END AS price FROM nums)"""


def _priced(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", numbers.parse_price(_price().cast("string")).alias("price"))


def price_parse(spark, d):
    return _priced(spark, d).select("p_partkey", "price")


def price_mean_fill(spark, d):
    return clean.fill_with_mean(_priced(spark, d), "price").select("p_partkey", "price")


def price_mean_fill_by_brand(spark, d):
    return clean.fill_with_mean(_priced(spark, d), "price", by=["p_brand"]).select("p_partkey", "price")


def price_reclean(spark, d):
    written = F.format_string("%.2f", "p_retailprice")
    return table(spark, d, "part").select("p_partkey", numbers.reclean_price(written).alias("price"), numbers.reclean_price(written, compat=True).alias("price_compat"))


def ts_format(spark, d):
    seconds = F.when(F.col("event_id") % 10 == 0, "not a time").otherwise(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    return table(spark, d, "events").select("event_id", numbers.format_epoch(seconds).alias("unixReviewTime"))


def ts_parse_mixed(spark, d):
    mixed = F.when(F.col("event_id") % 3 == 0, F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")).when(F.col("event_id") % 3 == 1, F.translate(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "-", "‐")).otherwise(F.lit("never"))
    return table(spark, d, "events").select("event_id", F.date_format(numbers.parse_time(mixed), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def _timed(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_custkey")


def chrono_split(spark, d):
    rows = split.chronological_split(_timed(spark, d), F.col("o_orderdate"), [F.col("o_orderkey")], ["o_orderpriority"])
    return rows.select("o_orderkey", "o_orderpriority", "split")


SPLIT_CTE = """ranked AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_orderdate IS NOT NULL),
points AS (SELECT *, round_even(n * 0.9::DOUBLE, 0)::BIGINT AS t FROM ranked), named AS (SELECT *, round_even(t * (8.0::DOUBLE / 9), 0)::BIGINT AS v FROM points),
splits AS (SELECT o_orderkey, o_orderpriority, CASE WHEN r <= v THEN 'train' WHEN r <= t THEN 'valid' ELSE 'test' END AS split FROM named)"""


def split_sizes(spark, d):
    return split.require_splits(chrono_split(spark, d)).groupBy("o_orderpriority", "split").agg(F.count(F.lit(1)).alias("n_rows"))


def split_projection(spark, d):
    rows = samples(spark, d).withColumn("user_hist_id", history.render_ids(F.col("history"))).drop("history")
    rows = split.chronological_split(rows, F.col("ts"), [F.col("sample_id")])
    test = split.split_columns(rows, "test")
    return test.select("sample_id", "user_id", "asin", "label", F.lit("user_hist_id" in test.columns).alias("leaks"))


SPLIT_PROJECTION = f"""WITH {SAMPLES}, ranked AS (SELECT *, row_number() OVER (ORDER BY ts, sample_id) AS r, count(*) OVER () AS n FROM samples WHERE ts IS NOT NULL)
SELECT sample_id, user_id, asin, label, false AS leaks FROM ranked WHERE r > round_even(n * 0.9::DOUBLE, 0)"""


def column_unknown_profile(spark, d):
    part = table(spark, d, "part").select(*[F.when(F.col("p_partkey") % m == 0, "unknown").otherwise(F.col(c)).alias(c) for m, c in ((3, "p_name"), (7, "p_brand"), (1000003, "p_type"))])
    return quality.unknown_profile(part, ["p_name", "p_brand", "p_type"])


def format_issues(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("product_"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "!").otherwise("")).alias("also_buy"), F.concat("p_type", F.when(F.col("p_size") % 2 == 0, "; odd").otherwise("")).alias("details"))
    return quality.format_issues(part, ["also_buy"], ["details"])


FORMAT = """WITH p AS (SELECT 'product_' || p_size || CASE WHEN p_size % 3 = 0 THEN '!' ELSE '' END AS also_buy, p_type || CASE WHEN p_size % 2 = 0 THEN '; odd' ELSE '' END AS details FROM part),
a AS (SELECT DISTINCT also_buy AS v FROM p ORDER BY 1 LIMIT 5), b AS (SELECT DISTINCT details AS v FROM p ORDER BY 1 LIMIT 5)
(SELECT 'also_buy' AS "column", left(v, 50) AS issue FROM a WHERE NOT (v = 'unknown' OR regexp_matches(v, '^[\\w\\s_,]+$')) ORDER BY v LIMIT 3) UNION ALL
(SELECT 'details', left(v, 50) FROM b WHERE NOT (v = 'unknown' OR NOT contains(v, '; ') OR regexp_matches(v, '^[A-Z][^:]+: [^;]+(; [A-Z][^:]+: [^;]+)*$')) ORDER BY v LIMIT 3)"""


def positional_join_check(spark, d):
    rows = samples(spark, d)
    labels = rows.select("sample_id", "label").where("sample_id % 10 != 3")
    vectors = rows.select("sample_id").where("sample_id % 10 != 4")
    return quality.stray_samples(labels, vectors)


def positional_join(spark, d):
    rows = samples(spark, d)
    return quality.positional_join([rows.select("sample_id", "label"), rows.select("sample_id", "asin"), rows.select("sample_id", "price")])


def final_columns(spark, d):
    rows = samples(spark, d).withColumn("Domain", F.lit("All_Beauty")).withColumn("user_hist_id", history.render_ids(F.col("history")))
    return clean.finalise(rows.drop("sample_id", "ts", "history"))


FINAL = f"""WITH {SAMPLES} SELECT 'All_Beauty' AS "Domain", -1 AS scenario_id, user_id, 'unknown' AS user_name, asin, price, brand, title, 'unknown' AS similar_item, 'unknown' AS rank, category, 'unknown' AS "reviewText", label,
CASE WHEN len(history) = 0 THEN 'unknown' ELSE array_to_string(['product_' || x for x in history], ' and ') END AS user_hist_id, 'unknown' AS user_hist_title, 'unknown' AS "unixReviewTime", 'unknown' AS also_buy, 'unknown' AS also_view, 'unknown' AS description, 'unknown' AS details, 'unknown' AS feature, 'unknown' AS style FROM samples"""

FIRST = f"WITH {ITEMS} SELECT item, title, brand, category, price, src_idx FROM items QUALIFY row_number() OVER (PARTITION BY item ORDER BY src_idx) = 1"

QUERIES = {
    "hist_ids": (hist_ids, HIST_IDS),
    "hist_titles": (hist_titles, HIST_TITLES),
    "hist_coverage": (hist_coverage, HIST_COVERAGE),
    "label_drop_neutral": (label_drop_neutral, f"WITH {LABELLED} SELECT src_idx, user_id, item, overall, label FROM labelled"),
    "positive_ratio": (positive_ratio, f"WITH {LABELLED} SELECT user_id, count(*) AS n_rows, round_even(avg(label::DOUBLE) * 100, 2) AS positive_pct FROM labelled GROUP BY user_id"),
    "meta_dedup_first": (meta_dedup_first, FIRST),
    "item_first_title": (item_first_title, f"WITH {ITEMS} SELECT item, replace(arg_min(title, src_idx), ';', ',') AS title FROM items WHERE title IS NOT NULL AND lower(trim(title)) NOT IN ('', 'nan', 'none', 'unknown') GROUP BY item"),
    "review_meta_left_join": (review_meta_left_join, f"WITH {INTERACTIONS}, {ITEMS}, meta AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY item ORDER BY src_idx) = 1) SELECT i.src_idx, user_id, i.item, title, brand, price FROM interactions i LEFT JOIN meta m ON i.item = m.item"),
    "join_unmatched": (join_unmatched, f"WITH {INTERACTIONS}, {ITEMS} SELECT item * 2 AS item, count(*) AS n_rows FROM interactions WHERE item * 2 NOT IN (SELECT item FROM items) GROUP BY ALL"),
    "user_dictionary": (user_dictionary, USER_DICT),
    "item_dictionary": (item_dictionary, f"WITH {ITEM_DICT_CTE} SELECT value, idx FROM dict"),
    "encode_unknown": (encode_unknown, ENCODE),
    "related_items_encode": (related_items_encode, _related_sql(None)),
    "related_top5": (related_top5, _related_sql(5)),
    "price_parse": (price_parse, f"WITH {PARSED_SQL} SELECT p_partkey, price FROM parsed"),
    "price_mean_fill": (price_mean_fill, f"WITH {PARSED_SQL} SELECT p_partkey, coalesce(price, (SELECT round_even(coalesce(avg(price), 0), 2) FROM parsed)) AS price FROM parsed"),
    "price_mean_fill_by_brand": (price_mean_fill_by_brand, f"WITH {PARSED_SQL} SELECT p_partkey, coalesce(price, round_even(coalesce(avg(price) OVER (PARTITION BY p_brand), 0), 2)) AS price FROM parsed"),
    "price_reclean": (price_reclean, "SELECT p_partkey, printf('%.2f', p_retailprice)::DOUBLE AS price, regexp_extract(printf('%.2f', p_retailprice), '^\\d{1,3}')::DOUBLE AS price_compat FROM part"),
    "ts_format": (ts_format, "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS \"unixReviewTime\" FROM events"),
    "ts_parse_mixed": (ts_parse_mixed, "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS parsed FROM events"),
    "chrono_split": (chrono_split, f"WITH {SPLIT_CTE} SELECT * FROM splits"),
    "split_sizes": (split_sizes, f"WITH {SPLIT_CTE} SELECT o_orderpriority, split, count(*) AS n_rows FROM splits GROUP BY ALL"),
    "split_projection": (split_projection, SPLIT_PROJECTION),
    "column_unknown_profile": (
        column_unknown_profile,
        "SELECT 'p_name' AS \"column\", count(*) AS n_rows, count(*) FILTER (p_partkey % 3 = 0) AS n_unknown, round_even(count(*) FILTER (p_partkey % 3 = 0) / count(*) * 100, 2) AS pct_unknown FROM part UNION ALL SELECT 'p_brand', count(*), count(*) FILTER (p_partkey % 7 = 0), round_even(count(*) FILTER (p_partkey % 7 = 0) / count(*) * 100, 2) FROM part UNION ALL SELECT 'p_type', count(*), count(*) FILTER (p_partkey % 1000003 = 0), round_even(count(*) FILTER (p_partkey % 1000003 = 0) / count(*) * 100, 2) FROM part",
    ),
    "format_issues": (format_issues, FORMAT),
    "positional_join_check": (positional_join_check, f"WITH {SAMPLES} SELECT sample_id, CASE WHEN sample_id % 10 = 4 THEN 'left' ELSE 'right' END AS side FROM samples WHERE sample_id % 10 IN (3, 4)"),
    "positional_join": (positional_join, f"WITH {SAMPLES} SELECT sample_id, label, asin, price FROM samples"),
    "final_columns": (final_columns, FINAL),
}
