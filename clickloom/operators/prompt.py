"""Rows as prompt sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.text import clicked, is_blank, one_line

# Names of scenarios, and the sentence parts of item attributes in order.
SCENARIOS = {0: "Amazon Fashion", 1: "Digital Music", 2: "Musical Instruments", 3: "Gift Cards", 4: "All Beauty"}
ATTRIBUTES = (
    ("title", "the title is '{}'"), ("brand", "the brand is '{}'"), ("price", "the price is ${}"), ("similar_item", "similar items are {}"), ("rank", "the rank is '{}'"),
    ("category", "the category is '{}'"), ("reviewText", "the review text is '{}'"), ("unixReviewTime", "the Unix review time is '{}'"), ("also_buy", "customers also bought {}"),
    ("also_view", "customers also viewed {}"), ("description", "the description is '{}'"), ("details", "the details are '{}'"), ("feature", "the feature is '{}'"), ("style", "the style is '{}'"),
)


def scenario_name(df: DataFrame) -> Column:
    """The domain's name; the scenario's number only where the domain is NULL or absent."""
    by_number = F.lit("Unknown Scenario")
    if "scenario_id" in df.columns:
        number = F.col("scenario_id").cast("int")
        named = F.concat(F.lit("Scenario "), number.cast("string"))
        for k, v in SCENARIOS.items():
            named = F.when(number == k, v).otherwise(named)
        by_number = F.coalesce(named, by_number)
    if "Domain" not in df.columns:
        return by_number
    domain = one_line(F.trim(F.col("Domain")))
    return F.when(F.col("Domain").isNull(), by_number).when(is_blank(domain), "Unknown Scenario").otherwise(domain)


def prompt_text(df: DataFrame) -> Column:
    """The sentence of a row, from those of the known columns that ``df`` has."""

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    user = F.when(text("user_id").isNull(), "unknown" if "user_id" not in df.columns else "nan").otherwise(one_line(text("user_id")))
    named = clicked(text("user_name"))
    name = one_line(F.when(named == "nothing", "anonymous").otherwise(named))
    ids, titles = one_line(clicked(text("user_hist_id"))), one_line(clicked(text("user_hist_title")))
    asin = one_line(F.coalesce(text("asin"), F.lit("nan" if "asin" in df.columns else "unknown")))
    parts = [F.concat(F.lit("The ID of current product is product_"), asin)]
    for field, template in ATTRIBUTES:
        if field not in df.columns:
            continue
        head, tail = template.split("{}")
        if field == "price":
            value = F.col("price").try_cast("double")
            parts.append(F.when(value.isNotNull() & ~F.isnan(value), F.concat(F.lit(head), F.format_string("%.2f", value), F.lit(tail))))
        else:
            value = F.translate(one_line(text(field)), "'", '"')
            parts.append(F.when(~is_blank(text(field)), F.concat(F.lit(head), value, F.lit(tail))))
    who = F.concat(F.lit("The user is "), name, F.lit(" (ID: user_"), user, F.lit(")"))
    history = F.when((ids == "nothing") & (titles == "nothing"), ". ").otherwise(F.concat(F.lit(", who clicked IDs "), ids, F.lit(" and titles "), titles, F.lit(" recently. ")))
    return F.concat(scenario_name(df), F.lit(": "), who, history, F.concat_ws(", ", *parts), F.lit(". "))
