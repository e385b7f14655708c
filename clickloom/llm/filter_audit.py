"""Interaction audit of quality filters: which filter removes what, in every order.

One native pass over the texts tests every filter on every document and keeps a row
of an id, a part, a digest and five bits. Exact repeats come from the digests: those
that occur more than once are written with their least id and joined back.

The lookup then runs in Arrow batches: a table of 32 rows (which filters a document
fails) by 120 columns (the orders) names the first failing step, ``np.bincount``
adds up removals by part, order and step, once plain and once for each label, and
each task sends the sums of its parts. Spark adds those up; what a filter would have
removed again (redundant) and what is left (kept) follow from the sums.

Tasks hold the sums of ``HELD_PARTS`` parts at most, so memory follows neither parts
nor rows. A digest, an id or a part with a third of all rows is combined before it
moves; written sides let adaptive execution split the joins beyond ``broadcast_keys``.

Defined results: a null text is an empty one, a null part the empty string; a null id
repeats nothing and is repeated by nothing, and has no labels; rows of one id and one
text don't repeat each other; several label rows of an id count as one, set if any of
them is 1; an empty table has no parts and so no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.text import bound
from clickloom.llm._shared import in_batches, materialize, sized

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
WORDS = r"[^\x20\x09-\x0D]+"
#: Parts whose sums a task holds; the eldest are sent on beyond.
HELD_PARTS = 256
#: Rows that are looked up at once (120 orders each).
ROWS = 4096


def first_failures() -> np.ndarray:
    """32 by 120: the step (from 0) at which an order removes a document that fails these filters; 5 if none does."""
    masks = np.arange(1 << STEPS)[:, None]
    bits = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    fails = (masks[:, :, None] >> bits[None]) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


def _text_bits(text: Column) -> Column:
    """Bits of the filters that look at one text alone: A, B, C, D."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))

    def of_words(w: Column) -> Column:
        few = F.when(F.size(w) < 200, 1).otherwise(0)
        return few + F.when(F.size(F.array_distinct(w)) * 100 < F.size(w) * 50, 2).otherwise(0)

    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    shouting = F.when(capitals.cast("long") * 100 > F.length(text).cast("long") * 3, 4).otherwise(0)
    signs = F.when(F.regexp_like(text, F.lit("[#$%&*|]")), 8).otherwise(0)
    return bound(words, of_words) + shouting + signs


def failing_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", broadcast_keys: int = 1_000_000) -> DataFrame:
    """A row for each document: its id, ``part``, ``mask`` (bits of FILTERS, A first), ``good`` and ``toxic``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tested = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
        _text_bits(text).alias("_bits"),
    )
    tested = materialize(tested, "tested")
    repeated = tested.groupBy("_digest").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"))
    repeated = materialize(repeated.where("_least < _most").drop("_most"), "repeated")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_label_id"))
    marks = marks.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("_toxic"))
    marks = materialize(marks.where("_good or _toxic"), "marks")
    known = tested.join(sized(repeated, broadcast_keys), "_digest", "left").drop("_digest")
    known = known.join(sized(marks, broadcast_keys), F.col("_id") == F.col("_label_id"), "left")
    repeats = F.when(F.col("_id") > F.col("_least"), 16).otherwise(0)
    return known.select(F.col("_id").alias(id_col), "part", (F.col("_bits") + repeats).cast("int").alias("mask"), F.coalesce("_good", F.lit(False)).alias("good"), F.coalesce("_toxic", F.lit(False)).alias("toxic"))


class _Sums:
    """Sums of one part: documents by mask, and removals by order and step, plain and by label."""

    def __init__(self):
        self.masks = np.zeros(1 << STEPS, dtype=np.int64)
        self.removed = np.zeros((3, len(ORDERS) * (STEPS + 1)), dtype=np.int64)

    def add(self, masks: np.ndarray, labels: tuple[np.ndarray, np.ndarray], table: np.ndarray) -> None:
        self.masks += np.bincount(masks, minlength=1 << STEPS)
        cells = np.arange(len(ORDERS)) * (STEPS + 1)
        for row, chosen in enumerate((masks, masks[labels[0]], masks[labels[1]])):
            for k in range(0, len(chosen), ROWS):
                at = table[chosen[k : k + ROWS]] + cells
                self.removed[row] += np.bincount(at.ravel(), minlength=self.removed.shape[1])


def _partial_sums(failing: DataFrame) -> DataFrame:
    table = first_failures()
    names = ("documents", "fails", "unique_fails", "removed", "good_lost", "toxic_lost")
    schema = "part string, filter_order string, step int, filter string, " + ", ".join(f"{n} long" for n in names)

    def rows(part: str, sums: _Sums) -> pa.RecordBatch:
        which = np.array([[FILTERS.index(f) for f in order] for order in ORDERS]).ravel()
        masks = np.arange(1 << STEPS)
        fails = np.array([sums.masks[(masks >> f) & 1 == 1].sum() for f in range(STEPS)])
        removed = sums.removed.reshape(3, len(ORDERS), STEPS + 1)[:, :, :STEPS].reshape(3, -1)
        n = len(which)
        columns = [
            pa.array([part] * n),
            pa.array([order for order in ORDERS for _ in range(STEPS)]),
            pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))),
            pa.array([f for order in ORDERS for f in order]),
            pa.array(np.full(n, sums.masks.sum())),
            pa.array(fails[which]),
            pa.array(sums.masks[1 << which]),
            *(pa.array(r) for r in removed),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", "filter", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, _Sums] = OrderedDict()
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            codes = parts.indices.to_numpy(zero_copy_only=False)
            masks, good, toxic = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for code, part in enumerate(parts.dictionary.to_pylist()):
                rows_of = codes == code
                held.setdefault(part, _Sums()).add(masks[rows_of], (good[rows_of], toxic[rows_of]), table)
                if len(held) > HELD_PARTS:
                    yield rows(*held.popitem(last=False))
        while held:
            yield rows(*held.popitem(last=False))

    return failing.select("part", "mask", "good", "toxic").transform(in_batches, run, schema)


def filter_interactions(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """For each part, order and step: what is kept, removed, redundant, lost by label, and the filter's Shapley sum.

    ``options`` are those of ``failing_filters``.
    """
    keys = ["part", "filter_order", "step", "filter"]
    partial = _partial_sums(failing_filters(docs, labels, **options))
    sums = partial.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in partial.columns if c not in keys])
    gone = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))  # 5 rows
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))  # 120 rows
    return sums.select("part", "filter_order", "step", (F.col("documents") - gone).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t
), marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM d JOIN least USING (t) LEFT JOIN marks USING (doc_id)
), groups AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM failing GROUP BY ALL
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (SELECT o, unnest(range(1, 6)) AS s FROM orders
), looked AS (
  SELECT part, o, s, substr(o, s, 1) AS filter, n, g, x, fails, fails <> '' AND regexp_matches(fails, '[' || substr(o, s, 1) || ']') AS hit,
    s > 1 AND regexp_matches(fails, '[' || CASE WHEN s > 1 THEN substr(o, 1, s - 1) ELSE '-' END || ']') AS before
  FROM groups, steps
), counted AS (
  SELECT part, o AS filter_order, s AS step, filter,
    sum(CASE WHEN hit OR before THEN 0 ELSE n END) AS kept, sum(CASE WHEN hit AND NOT before THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT before THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT before THEN x ELSE 0 END) AS toxic_lost
  FROM looked GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""
