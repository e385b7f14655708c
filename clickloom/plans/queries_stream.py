"""The streaming histories as queries: one run over what the source holds, then its sink read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import history
from clickloom.plans.queries_table import HIST
from clickloom.plans.stand_ins import interactions
from clickloom.sources.shared import shared_folder
from clickloom.streaming.history import STORE, ordered_histories, stream_history, use_store

def stream_hist(spark, d):
    base = shared_folder(spark)
    rows = interactions(spark, d).where("overall is null or overall != 3").select("user_id", "src_idx", "ts", "item", F.when(F.col("overall") > 3, 1).otherwise(0).alias("label"))
    rows.write.parquet(f"{base}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    sink = stream_history(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("src_idx", "user_id", "item", "label", history.render_ids(F.col("history")).alias("user_hist_id"))


def stream_hist_ordered(spark, d):
    """All interactions from ten files in shuffled order, a trigger each; a row far ahead ends the source."""
    base = shared_folder(spark)
    rows = interactions(spark, d).where("overall is null or overall != 3").select("user_id", "src_idx", F.col("ts").cast("timestamp").alias("ts"), "item", F.when(F.col("overall") > 3, 1).otherwise(0).alias("label"))
    rows.repartition(10, F.xxhash64("src_idx")).write.parquet(f"{base}/in")
    end = rows.agg((F.max("ts") + F.expr("interval 4000 days")).alias("ts")).select(F.lit(None).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("src_idx"), "ts", F.lit(None).cast("int").alias("item"), F.lit(0).alias("label"))
    end.coalesce(1).write.mode("append").parquet(f"{base}/in")
    before = use_store(spark)
    try:
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        sink = ordered_histories(source, delay="3999 days").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append")
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return spark.read.parquet(f"{base}/out").select("src_idx", "user_id", "item", "label", "late", history.render_ids(F.col("history")).alias("user_hist_id"))


HIST_SQL = f"WITH {HIST} SELECT src_idx, user_id, item, label, CASE WHEN len(h) = 0 THEN 'unknown' ELSE array_to_string(['product_' || x for x in h], ' and ') END AS user_hist_id FROM hist"

QUERIES = {
    "stream_hist": (stream_hist, HIST_SQL),
    "stream_hist_ordered": (stream_hist_ordered, HIST_SQL.replace(" FROM hist", ", false AS late FROM hist")),
}
