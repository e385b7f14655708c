"""Entity and relation expressions of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The relations that extraction may give.
RELATIONS = (
    "has_username", "belongs_to_scenario", "has_price", "has_brand", "has_title", "belongs_to_category", "has_style", "has_rank", "click_history_id", "expresses_sentiment",
    "compares_to", "suggests_preference", "click_history_title", "has_similar_item",
)
# Weights of relations in attention; all others weigh 0.5.
RELATION_WEIGHTS = {
    "click_history_id": 2.0,
    "has_price": 1.0, "has_brand": 1.0, "has_title": 1.0, "belongs_to_category": 1.0, "has_style": 1.0, "has_rank": 1.0, "has_verified_status": 1.0,
    "also_bought_with": 1.5, "also_viewed_with": 1.5, "has_similar_item": 1.5,
    "has_username": 0.5, "belongs_to_scenario": 0.5,
}
DEFAULT_WEIGHT = 0.5


def entity_type(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("user_")), "user").when(F.startswith(c, F.lit("product_")), "product").otherwise("other")


def entity_hash(c: Column, dim: int = 32) -> Column:
    """Bytes of the SHA-256 of what follows the last '_', as shares of 255.

    For a select of its own, where Spark computes what all bytes share once a row and compiles the
    rest; in a lambda nothing is shared.
    """
    if dim > 32:  # a digest has 32 bytes
        return F.array_repeat(F.lit(0.0), dim)
    digest = F.rpad(F.sha2(F.substring_index(c, "_", -1), 256), 72, "0")
    # six numbers of six bytes each; the bytes are shifted out of them
    numbers = [F.conv(F.substring(digest, k * 12 + 1, 12), 16, 10).cast("long") for k in range(6)]
    return F.array(*[F.shiftright(numbers[i // 6], 8 * (5 - i % 6)).bitwiseAND(F.lit(255)).cast("double") / 255 for i in range(dim)])


def relation_weight(c: Column) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    low = F.lower(c)
    by_weight: dict[float, list[str]] = {}
    for name, w in RELATION_WEIGHTS.items():
        by_weight.setdefault(w, []).append(name)
    for w, names in by_weight.items():
        out = F.when(low.isin(*names), F.lit(w)).otherwise(out)
    return out
