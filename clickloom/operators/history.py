"""Leak-free click histories: the last k positive items strictly before each row of a user.

A user's rows are cut into segments of time. Within a segment, k running ``last``
windows carry the latest positives along, at constant memory a row; between
segments, lists of at most k items are carried over. So a user with a third of
all rows is spread over their segments, and no list of all earlier items is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _last_k(items: Column, k: int) -> Column:
    """The last k of an array, fewer if it has fewer."""
    return F.slice(items, F.greatest(F.size(items) - k + 1, F.lit(1)), k)


def click_history(df: DataFrame, user: str, order: Sequence[str], positive: Column, item: Column, k: int = 3, segment: Column | None = None, out: str = "history") -> DataFrame:
    """Add ``out``: the last k values of ``item`` on positive rows before this one, oldest first.

    ``order`` is a total order of a user's rows; ``segment`` is a key that follows it
    (rows of an earlier segment come first), by default one segment.
    """
    rows = df.withColumn("_seg", segment if segment is not None else F.lit(0)).withColumn("_value", F.when(positive, item))
    rows = rows.withColumn("_pos", positive)
    before = Window.partitionBy(user, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # carried structs keep NULL items apart from no item
    rows = rows.withColumn("_c1", F.last(F.when(F.col("_pos"), F.struct(F.col("_value").alias("v"))), ignorenulls=True).over(before))
    for j in range(2, k + 1):
        rows = rows.withColumn(f"_c{j}", F.last(F.when(F.col("_pos"), F.struct(F.col(f"_c{j - 1}").alias("s"))), ignorenulls=True).over(before)["s"])
    own = F.array(*[F.col(f"_c{j}") for j in range(k, 0, -1)])
    rows = rows.withColumn("_own", F.transform(F.filter(own, lambda s: s.isNotNull()), lambda s: s["v"]))
    rows = rows.drop(*[f"_c{j}" for j in range(1, k + 1)])
    if segment is not None:
        with_self = F.when(F.col("_pos"), F.concat("_own", F.array("_value")))
        ends = rows.groupBy(user, "_seg").agg(F.max_by(with_self, F.when(F.col("_pos"), F.struct(*order))).alias("_tail"))
        by_user = Window.partitionBy(user).orderBy("_seg")
        some = ends.where("_tail is not null").withColumn("_full", _last_k(F.flatten(F.collect_list("_tail").over(by_user.rowsBetween(-(k - 1), 0))), k))
        carried = ends.select(user, "_seg").join(some.select(user, "_seg", "_full"), [user, "_seg"], "left")
        carried = carried.withColumn("_carry", F.last("_full", ignorenulls=True).over(by_user.rowsBetween(Window.unboundedPreceding, -1))).drop("_full")
        rows = rows.join(carried, [user, "_seg"])
        rows = rows.withColumn("_own", F.when(F.col("_carry").isNull(), F.col("_own")).otherwise(F.concat("_carry", "_own"))).drop("_carry")
    return rows.withColumn(out, _last_k(F.col("_own"), k)).select(*df.columns, out)


def render_ids(history: Column) -> Column:
    """``product_<id>`` joined by ' and '; ``unknown`` if empty."""
    return F.when(F.size(history) == 0, "unknown").otherwise(F.array_join(F.transform(history, lambda x: F.concat(F.lit("product_"), x.cast("string"))), " and "))


def render_titles(history: Column) -> Column:
    """``product '<title>'`` joined by ' and '; ``unknown`` if empty."""
    titles = F.transform(history, lambda x: F.concat(F.lit("product '"), F.coalesce(x, F.lit("unknown")), F.lit("'")))
    return F.when(F.size(history) == 0, "unknown").otherwise(F.array_join(titles, " and "))
