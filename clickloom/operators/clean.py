"""Column-wise imputation and cleaning: which expression a column gets, decided by its type and name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from clickloom.functions import numbers, text

# Columns dropped on reading, and the columns of the processed table in order.
EXCLUDED = ("vote", "imageURL", "imageURLHighRes", "image", "main_cat", "fit", "verified", "tech1", "tech2")
FINAL_COLUMNS = (
    "Domain", "scenario_id", "user_id", "user_name", "asin", "price", "brand", "title", "similar_item", "rank", "category", "reviewText", "label",
    "user_hist_id", "user_hist_title", "unixReviewTime", "also_buy", "also_view", "description", "details", "feature", "style",
)
DEFAULTS = {"price": 0.0, "scenario_id": -1}
# Which cleaning a column of the processed table gets.
TEXT_FIELDS = ("description", "feature", "category", "style", "user_hist_title", "title", "summary", "reviewText")
LIST_FIELDS = ("also_buy", "also_view", "similar_item")
ATTRIBUTE_FIELDS = ("details",)


def drop_excluded(df: DataFrame, names: Sequence[str] = EXCLUDED) -> DataFrame:
    return df.drop(*names)


def finalise(df: DataFrame, columns: Sequence[str] = FINAL_COLUMNS) -> DataFrame:
    """The columns of the processed table, in order, missing ones as their default."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(DEFAULTS.get(c, text.UNKNOWN)).alias(c) for c in columns])


def _imputed(field: T.StructField, compat: bool) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if field.name == "style":
        return text.style_map(c) if isinstance(kind, T.MapType) else text.style_text(c)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        value = text.flatten_nested(c, kind, compat)
    elif isinstance(kind, T.StringType):
        value = text.clean_text(c, compat)
    else:
        return c
    return text.clean_rank(value) if field.name == "rank" else value


def impute(df: DataFrame, compat: bool = False) -> DataFrame:
    """One pass over all columns: styles, booleans, nested (to any depth), text and rank columns as their type asks."""
    return df.select(*[_imputed(f, compat).alias(f.name) for f in df.schema])


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; by aggregation, so a hot key combines before it moves."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)])
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    return df.groupBy(*keys).agg(F.min_by(row, ranked).alias("_row")).select(*[(F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c)) for c in df.columns])


def fill_with_mean(df: DataFrame, col: str, by: Sequence[str] = (), out: str | None = None, decimals: int = 2) -> DataFrame:
    """NULLs become the rounded mean (0 if there is none), over all rows or over each ``by``."""
    out = out or col
    mean = F.bround(F.coalesce(F.avg(col), F.lit(0.0)), decimals).alias("_mean")
    if by:
        means = df.groupBy(*by).agg(mean)
        joined = df.join(means, list(by), "left")
    else:  # one row
        joined = df.join(F.broadcast(df.agg(mean)))
    return joined.withColumn(out, F.coalesce(F.col(col), F.col("_mean"))).drop("_mean").select(*df.columns, *([out] if out not in df.columns else []))


def clean_table(df: DataFrame, compat: bool = False, visible: Callable[[Column], Column] | None = None) -> DataFrame:
    """The second cleaning of a processed table: text, list, attribute, rank and price columns.

    The items of lists keep their case unless ``compat`` asks otherwise. ``visible`` is
    what ``text.clean_html`` takes.
    """
    if visible:  # each cell goes to the tokeniser once, before any expression that refers to it twice
        cells = [c for c in df.columns if c in (*TEXT_FIELDS, *LIST_FIELDS, *ATTRIBUTE_FIELDS)]
        df = df.withColumns({c: F.when(text.is_blank(F.col(f"`{c}`")), F.col(f"`{c}`")).otherwise(visible(F.trim(F.col(f"`{c}`")))) for c in cells})

    def one(name: str) -> Column:
        c, shown = F.col(f"`{name}`"), (lambda x: x) if visible else None
        if name in TEXT_FIELDS:
            return text.clean_html(c, compat, visible=shown)
        if name in LIST_FIELDS:
            return text.bound(text.clean_html(c, compat, capitalised=compat, visible=shown), text.standardise_list)
        if name in ATTRIBUTE_FIELDS:
            return text.bound(text.clean_html(c, compat, visible=shown), lambda x: text.extract_attributes(x, compat))
        if name == "rank":
            return text.rank_digits(c)
        return c

    cleaned = df.select(*[one(c).alias(c) for c in df.columns])
    return fill_with_mean(cleaned.withColumn("price", numbers.reclean_price(F.col("price").cast("string"), compat)), "price") if "price" in df.columns else cleaned
