"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are put in a seeded pseudo-random order and given the
fractional rank ``(rank - 1 + u) / n``: ``n`` rows lie evenly over (0, 1), ``u`` is
a seeded offset of the source, so that many tiny sources don't meet at one value.
Sorting all rows by that number interleaves the sources in proportion, and
cutting the sequence in equal runs gives shards that all match the mixture.

No source and no cut meets in one task. A rank is the count of rows in lower
hash cells plus a row number inside a cell, and likewise for the global position,
so a source with a third of all rows is dealt over 4096 cells.

Defined results: a null source is a source of its own; a null text has size 1 and
crc 0; a null id is hashed as such; equal rows are interchangeable; an empty table
gives no rows; other columns are ignored unless named in ``keep``, where names of results are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from clickloom.llm._shared import refuse_clashes

#: Hash cells of a source and cells of the global order: hex digits of the key.
CELL_DIGITS = 3
CELLS = 16**CELL_DIGITS


def stratified_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """Deal rows into shards of counts at most one apart, each with the source mixture.

    Returns the id, ``keep``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (the
    place in the shard, gapless from 0).
    """
    refuse_clashes(keep, [id_col, "size", "text_crc32", "shard", "slot"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string"))).alias("_stratum"),
    )
    rows = rows.withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("~")), F.col("_crc").cast("string")).cast("binary")))
    rows = rows.withColumn("_cell", F.substring("_key", 1, CELL_DIGITS))

    # rank inside a source: rows of lower cells, then the row number in the cell
    per_cell = rows.groupBy("_stratum", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    in_source = Window.partitionBy("_stratum")
    below = per_cell.select(
        "_stratum",
        "_cell",
        (F.sum("_n").over(in_source.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_below"),
        F.sum("_n").over(in_source).alias("_total"),
    )
    order = ["_key", F.col("_id").asc_nulls_first(), "_size", "_crc"]
    ranked = rows.withColumn("_in_cell", F.row_number().over(Window.partitionBy("_stratum", "_cell").orderBy(*order))).join(below, ["_stratum", "_cell"])
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "_stratum").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    ranked = ranked.withColumn("_frac", ((F.col("_below") + F.col("_in_cell") - 1).cast("double") + offset) / F.col("_total").cast("double"))
    ranked = ranked.withColumn("_bin", F.least(F.floor(F.col("_frac") * CELLS), F.lit(CELLS - 1)).cast("int"))

    # global position, in the same way; the table of bins has at most CELLS rows
    bins = ranked.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    bins = bins.select(
        "_bin",
        (F.sum("_n").over(everything.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(everything).alias("_rows"),
    )
    placed = ranked.withColumn("_in_bin", F.row_number().over(Window.partitionBy("_bin").orderBy("_frac", "_stratum", *order))).join(F.broadcast(bins), "_bin")
    placed = placed.withColumn("_pos", F.col("_before") + F.col("_in_bin") - 1)
    placed = placed.withColumn("_shard", F.expr(f"_pos * {int(n_shards)}L div _rows"))
    # the first position of shard s is the least p with p * k >= s * rows
    first = F.expr(f"(_shard * _rows + {int(n_shards) - 1}L) div {int(n_shards)}L")
    return placed.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_pos") - first).alias("slot"),
    )


#: DuckDB has no crc32: it goes byte by byte over the table that the polynomial gives.
ORACLE_SQL = """
WITH RECURSIVE bits AS (
  SELECT i AS b, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8
), bytes AS (
  SELECT d.doc_id, d.source, octet_length(encode(coalesce(d.text, ''))) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x)::BIGINT for x in regexp_extract_all(hex(encode(coalesce(d.text, ''))), '..')]),
      lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc
  FROM documents d, crc_table t
), keyed AS (
  SELECT doc_id, size, crc, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS stratum,
    md5('17|' || coalesce(doc_id::VARCHAR, '~') || '|' || crc) AS key FROM bytes
), ranked AS (
  SELECT *, ((row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id NULLS FIRST, size, crc) - 1)::DOUBLE
      + ('0x' || substr(md5('17|' || stratum), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE) / (count(*) OVER (PARTITION BY stratum))::DOUBLE AS frac
  FROM keyed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY frac, stratum, key, doc_id NULLS FIRST, size, crc) - 1 AS pos, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (pos * 8 // n)::INTEGER AS shard,
  (pos - ((pos * 8 // n) * n + 7) // 8)::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
