"""Price, label and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clickloom.functions.text import clean_html, is_blank


def parse_price(c: Column, compat: bool = False) -> Column:
    """First number of a price text, or the mean of the first two of a range; 2 decimals.

    ``compat`` ends a number at a comma, so ``$1,299.00`` is 1.
    """
    text = F.trim(c) if compat else F.regexp_replace(F.trim(c), r"(\d),(?=\d{3})", "$1")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\d+\.?\d*"), F.lit(0)), lambda x: x.try_cast("double"))
    ranged = F.contains(text, F.lit("-")) & (F.size(numbers) >= 2)
    value = F.when(ranged, (F.try_element_at(numbers, F.lit(1)) + F.try_element_at(numbers, F.lit(2))) / 2).otherwise(F.try_element_at(numbers, F.lit(1)))
    return F.when(c != "unknown", F.bround(value, 2))


def reclean_price(c: Column, compat: bool = False) -> Column:
    """The second price pass, over a price already written as text: its first number.

    ``compat`` spaces punctuation before it looks for digits, so that decimals fall
    away and no more than three digits count that no comma joins.
    """
    if compat:
        digits = F.regexp_extract(clean_html(c, compat=True), r"\d{1,3}", 0)
    else:
        digits = F.replace(F.regexp_extract(c, r"\d[\d,]*(?:\.\d+)?|\.\d+", 0), F.lit(","), F.lit(""))
    return F.when(~is_blank(c), digits.try_cast("double"))


def label_of(rating: Column) -> Column:
    """1 for ratings over 3, else 0."""
    return F.when(rating > 3, 1).otherwise(0)


def is_neutral(rating: Column) -> Column:
    """Ratings of exactly 3; NULL is not neutral."""
    return rating.eqNullSafe(F.lit(3.0))


def format_epoch(c: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in UTC, ``unknown`` if they aren't a number."""
    return F.coalesce(F.date_format(F.timestamp_seconds(c.try_cast("double")), "yyyy-MM-dd HH:mm:ss"), F.lit("unknown"))


def format_date(c: Column) -> Column:
    """A date text as ``yyyy-MM-dd``, ``unknown`` if it isn't one."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd"), F.lit("unknown"))


def parse_time(c: Column) -> Column:
    """Epoch seconds or a date text as a timestamp; typographic hyphens count as '-'; else NULL."""
    text = F.trim(F.translate(c.cast("string"), "‐‑", "--"))
    return F.coalesce(F.timestamp_seconds(text.try_cast("double")), F.try_to_timestamp(text))
