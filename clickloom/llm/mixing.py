"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Sources share ``share`` times all words in proportion to their weights, but none more
than ``repeats`` times its own; what one can't take is shared out again. That is a
water level: with sources sorted by size over weight, those at their bound come
first, and two running sums give the level.

Words are dealt in blocks of ``block_words``. A mix of so many blocks gives its seats
to the highest quotients target / (2 s - 1), which is Sainte-Laguë's rule. Shard k of
S takes the seats between those of a mix of k - 1 S-ths and of k S-ths of the blocks:
the rule never takes a seat back, so each shard has whole quotas, and all shards
together have the mix's. Seats far from the last one given need no sorting: with
m sources, any level of t N / (T + ...) gives each source all but about m t / T + 1
of its seats at once, and only the few quotients left are sorted.

Documents of a source are put in a seeded order and cut into blocks there, so its
blocks come in a seeded order too; shards take them one after another, and go
through the source again when it ends, at most up to its bound, where the last
block is cut short. A document then takes as many words as its stretch of that
order overlaps with the source's: a formula of positions, no block is ever a row.

Nothing big meets in one task. Running sums over sources go through range partitions,
those over documents through cells of the seeded key; rows that are equal in source,
id and size are counted before they move, scan task by scan task, and laid side by
side afterwards. Sources are joined by broadcast up to ``broadcast_keys`` of them,
else by a join of a written table that adaptive execution can split.

Defined results: a null source is a source of its own and the last one; null and
word-free texts have size 0 and take nothing; a null id is ordered as such; equal
rows are interchangeable; a table without words has targets of 0; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.llm._shared import materialize, refuse_clashes, sized

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Words of a block, and shards of the mix.
BLOCK_WORDS, SHARDS = 16, 8
#: Hex digits of the seeded key that name a cell.
CELL_DIGITS = 3


def _before(df: DataFrame, order: Sequence[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Add running sums (the row's own included) in a total order: ``sums`` maps new columns to what they add up.

    Rows lie in range partitions of the order, each is summed by itself, and the
    totals of the lower ones are added; there are as many totals as partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), name)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_below_{out}") for out, c in sums.items()])
    lower = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_below_{out}").over(lower), F.lit(0)).alias(f"_below_{out}") for out in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.select("*", *[F.sum(c).over(inside).alias(out) for out, c in sums.items()])
    added = own.join(F.broadcast(totals), "_range")
    return added.select(*df.columns, *[(F.col(out) + F.col(f"_below_{out}")).alias(out) for out in sums])


def target_words(sources: DataFrame, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """Add ``_rank`` (from 0, by source), ``_weight``, ``_bound`` and ``_target`` to a row for each source.

    ``sources`` has ``_stratum``, whose order is the sources', and ``_source_size``.
    """
    ranked = _before(sources.withColumn("_one", F.lit(1).cast("long")), [F.col("_stratum")], {"_rank": "_one"}, "ranked_sources")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1).withColumn("_weight", weight).withColumn("_bound", F.col("_source_size") * int(repeats))
    ranked = ranked.withColumn("_ratio", F.col("_bound").cast("double") / F.col("_weight"))
    summed = materialize(_before(ranked, [F.col("_ratio"), F.col("_rank")], {"_bounds": "_bound", "_weights": "_weight"}, "levels"), "levels")
    whole = summed.agg(F.sum("_source_size").alias("_words"), F.sum("_weight").alias("_all_weights"))
    wanted = F.col("_words").cast("double") * F.lit(float(share))
    left = wanted - (F.col("_bounds") - F.col("_bound")).cast("double")
    at_bound = left > F.col("_ratio") * (F.col("_all_weights") - F.col("_weights") + F.col("_weight")).cast("double")
    marked = summed.join(F.broadcast(whole)).withColumn("_full", at_bound)  # ``whole`` is one row
    full = marked.where("_full").agg(F.coalesce(F.max("_bounds"), F.lit(0)).alias("_full_words"), F.coalesce(F.max("_weights"), F.lit(0)).alias("_full_weights"))
    spare = (F.col("_all_weights") - F.col("_full_weights")).cast("double")
    level = F.when(spare > 0, (wanted - F.col("_full_words").cast("double")) / spare).otherwise(0.0)
    target = F.when(F.col("_full"), F.col("_bound").cast("double")).otherwise(F.least(level * F.col("_weight"), F.col("_bound").cast("double")))
    return marked.join(F.broadcast(full)).withColumn("_target", target).select(*sources.columns, "_rank", "_weight", "_bound", "_target")


def apportion(sources: DataFrame, houses: DataFrame) -> DataFrame:
    """Seats of each source in every house by Sainte-Laguë: ``_rank``, ``_house``, ``_seats``.

    ``sources`` has ``_rank`` (ties go to the lower) and ``_target``; ``houses`` has
    ``_house`` and ``_size`` (seats to give), a few rows.
    """
    voting = sources.where("_target > 0").select("_rank", "_target")
    total = voting.agg(F.sum("_target").alias("_votes"), F.count(F.lit(1)).alias("_m"))
    pairs = voting.join(F.broadcast(total)).join(F.broadcast(houses))  # one row, and a row a shard
    part = F.col("_target") / F.col("_votes")
    sure = F.floor(part * (F.col("_size") - F.col("_m") / 2) + F.lit(0.5)) - 1
    pairs = pairs.withColumn("_sure", F.greatest(sure, F.lit(0)).cast("long")).withColumn("_more", (F.ceil(part * F.col("_m")) + 4).cast("int"))
    pairs = materialize(pairs, "sure_seats")
    open_seats = pairs.groupBy("_house").agg((F.max("_size") - F.sum("_sure")).alias("_open"))
    seats = pairs.select("_house", "_rank", "_target", "_sure", F.explode(F.sequence(F.lit(1), F.col("_more"))).alias("_next"))
    seats = seats.withColumn("_seat", F.col("_sure") + F.col("_next")).withColumn("_quotient", F.col("_target") / (2 * F.col("_seat") - 1).cast("double")).withColumn("_one", F.lit(1).cast("long"))
    order = [F.col("_house"), F.col("_quotient").desc(), F.col("_rank"), F.col("_seat")]
    placed = _before(seats, order, {"_place": "_one"}, "quotients")
    # a house's candidates are as many as every other's
    each = seats.where(F.col("_house") == 1).agg(F.count(F.lit(1)).alias("_each"))
    won = placed.join(F.broadcast(each)).join(F.broadcast(open_seats), "_house")  # one row, and a row a shard
    won = won.where(F.col("_place") - (F.col("_house") - 1) * F.col("_each") <= F.col("_open")).groupBy("_house", "_rank").agg(F.count(F.lit(1)).alias("_won"))
    return pairs.join(won, ["_house", "_rank"], "left").select("_rank", "_house", (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("_seats"))


def source_plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each source: its target, and ``_ends``, the words that it has given after each shard."""
    sources = sizes.groupBy("_stratum").agg(F.sum(F.col("_size") * F.col("_copies")).alias("_source_size"))
    targets = materialize(target_words(sources, weights, share, repeats), "targets")
    blocks = F.floor(F.coalesce(F.sum("_target"), F.lit(0.0)) / block_words + 0.5).cast("long")
    house = targets.agg(blocks.alias("_blocks")).select(F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("_house"), "_blocks")
    house = house.select("_house", F.expr(f"_blocks * _house div {int(shards)}").alias("_size"))
    seats = apportion(targets, materialize(house, "houses"))
    quotas = seats.groupBy("_rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("_house", "_seats"))), lambda h: h["_seats"]).alias("_quotas"))  # a row a shard
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    plan = targets.join(quotas, "_rank", "left").withColumn("_quotas", F.coalesce("_quotas", none))
    return plan.withColumn("_ends", F.transform("_quotas", lambda q: F.least(q * block_words, F.col("_bound"))))


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0).cast("long"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", broadcast_keys: int = 200_000) -> DataFrame:
    """What the mix takes of each document.

    Returns the id, ``size``, ``source_size`` and ``target`` (of its source), ``taken``
    (words, repeats counted) and ``spans``: structs of shard, first word (from 0) and
    words, in the order in which the shards take them.
    """
    refuse_clashes([id_col], ["size", "source_size", "target", "taken", "spans"])
    stratum = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("_id"), stratum.alias("_stratum"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long").alias("_size"), F.spark_partition_id().alias("_task"))
    # equal rows of one scan task are counted in it and stay one row until the end
    rows = materialize(rows.groupBy("_stratum", "_id", "_size", "_task").agg(F.count(F.lit(1)).alias("_copies")), "sizes")
    plan = materialize(source_plan(rows, weights, share, repeats, shards, block_words), "source_plan")

    rows = rows.withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("~"))).cast("binary")))
    rows = rows.withColumn("_cell", F.substring("_key", 1, CELL_DIGITS)).withColumn("_words", F.col("_size") * F.col("_copies"))
    cells = rows.groupBy("_stratum", "_cell").agg(F.sum("_words").alias("_n"))
    upward = Window.partitionBy("_stratum").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("_stratum", "_cell", (F.sum("_n").over(upward) - F.col("_n")).alias("_below"))
    inside = Window.partitionBy("_stratum", "_cell").orderBy("_key", F.col("_id").asc_nulls_first(), "_size", "_task").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_up_to", F.sum("_words").over(inside)).join(cells, ["_stratum", "_cell"])
    placed = placed.withColumn("_start", F.col("_below") + F.col("_up_to") - F.col("_words"))
    placed = placed.select("_stratum", "_id", "_size", "_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"))
    placed = placed.select("_stratum", "_id", "_size", (F.col("_start") + F.col("_copy") * F.col("_size")).alias("_start"))
    joined = placed.join(sized(plan.select("_stratum", "_source_size", "_target", "_ends"), broadcast_keys), "_stratum")

    def cuts(turn: int) -> Column:
        """The words of a document that each shard takes in the source's ``turn``-th round."""
        at = F.col("_start") + turn * F.col("_source_size")

        def cut(end: Column, shard: Column) -> Column:
            before = F.when(shard > 0, F.element_at("_ends", F.greatest(shard, F.lit(1)))).otherwise(F.lit(0).cast("long"))
            return F.struct(shard.alias("shard"), F.greatest(before - at, F.lit(0).cast("long")).alias("first"), _overlap(at, at + F.col("_size"), before, end).alias("words"))

        return F.filter(F.transform("_ends", cut), lambda s: s["words"] > 0)

    joined = joined.withColumn("_spans", F.concat(*[cuts(t) for t in range(repeats)]))
    taken = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    whole = F.col("_spans")
    return joined.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"), whole.alias("spans"))


#: Every quotient of every source is listed and sorted here; the operator sorts a few.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS stratum,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('29|' || coalesce(doc_id::VARCHAR, '~')) AS key FROM documents
), s AS (SELECT stratum, sum(size)::BIGINT AS source_size FROM d GROUP BY stratum
), ranked AS (SELECT *, row_number() OVER (ORDER BY stratum) - 1 AS rank FROM s
), weighed AS (SELECT *, ([3, 1, 2])[(rank % 3)::INTEGER + 1] AS w, 2 * source_size AS bound FROM ranked
), levels AS (
  SELECT *, sum(bound) OVER o AS bounds, sum(w) OVER o AS ws, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS wanted, sum(w) OVER () AS all_w
  FROM weighed WINDOW o AS (ORDER BY bound::DOUBLE / w, rank ROWS UNBOUNDED PRECEDING)
), marked AS (SELECT *, wanted - (bounds - bound)::DOUBLE > bound::DOUBLE / w * (all_w - ws + w)::DOUBLE AS full_up FROM levels
), spare AS (
  SELECT CASE WHEN max(all_w) > coalesce(max(ws) FILTER (full_up), 0)
    THEN (max(wanted) - coalesce(max(bounds) FILTER (full_up), 0)::DOUBLE) / (max(all_w) - coalesce(max(ws) FILTER (full_up), 0))::DOUBLE ELSE 0 END AS level FROM marked
), targets AS (SELECT stratum, rank, source_size, bound, CASE WHEN full_up THEN bound::DOUBLE ELSE least(level * w, bound::DOUBLE) END AS target FROM marked, spare
), quotients AS (
  SELECT rank, target / (2 * unnest(range(1, bound // 16 + 100)) - 1)::DOUBLE AS q FROM targets WHERE target > 0
), won AS (
  SELECT rank, count(*) AS blocks FROM (SELECT rank, row_number() OVER (ORDER BY q DESC, rank) AS place FROM quotients)
  WHERE place <= (SELECT floor(sum(target) / 16 + 0.5) FROM targets) GROUP BY rank
), plan AS (SELECT targets.*, least(coalesce(blocks, 0) * 16, bound)::BIGINT AS goes FROM targets LEFT JOIN won USING (rank)
), placed AS (SELECT *, (sum(size) OVER (PARTITION BY stratum ORDER BY key, doc_id NULLS FIRST, size, r ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos FROM d)
SELECT doc_id, size, source_size, target,
  (greatest(least(pos + size, goes) - pos, 0) + greatest(least(pos + source_size + size, goes) - (pos + source_size), 0))::BIGINT AS taken
FROM placed JOIN plan USING (stratum)
"""
