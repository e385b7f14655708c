"""Evaluation metrics, exact and distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve by rank sums, ties at half; 0.5 if only one class is there.

    Rows are reduced to one for each distinct score first; the running count over
    scores goes by cells of the score's leading part, so no task holds all scores.
    """
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("_s"))
    per = per.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("_q"))
    # an increasing step function of the score: fine near zero, coarse beyond
    cell = F.floor(F.col("_s") / (1 + F.abs("_s")) * 2048)
    per = per.withColumn("_cell", cell)
    cells = per.groupBy("_cell").agg(F.sum("_q").alias("_n"))
    order = Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_cell", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_below"))  # 4097 rows at most
    within = Window.partitionBy("_cell").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    won = per.join(F.broadcast(cells), "_cell").select("_p", "_q", (F.col("_p") * (F.col("_below") + F.coalesce(F.sum("_q").over(within), F.lit(0)) + F.col("_q") * 0.5)).alias("_w"))
    pairs = F.sum("_p").cast("double") * F.sum("_q").cast("double")
    return won.agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("_q"), F.lit(0)).alias("n_neg"), F.coalesce(F.when(pairs > 0, F.sum("_w") / pairs), F.lit(0.5)).alias("auc"))


def confusion(df: DataFrame, probability: Column, label: Column, threshold: float = 0.5) -> DataFrame:
    """Counts of (label, predicted) at a threshold."""
    return df.select(label.cast("int").alias("label"), (probability >= threshold).cast("int").alias("predicted")).groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n_rows"))


def early_stopping(df: DataFrame, epoch: str, metric: str, by: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Per epoch: best before, whether it improves by more than the tolerance, and epochs since the last improvement.

    Runs are short series; each is ordered within its own group.
    """
    order = Window.partitionBy(*by).orderBy(epoch)
    # an epoch improves on the best so far only beyond the tolerance, so the best is a fold, not a maximum
    series = F.collect_list(F.struct(F.col(epoch).alias("epoch"), F.col(metric).alias("m"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("double").alias("before"), F.lit(False).alias("hit"), F.lit(0).alias("idle"))

    def step(acc, x):
        better = acc["best"].isNull() | (x["m"] > acc["best"] + tolerance)
        return F.struct(F.when(better, x["m"]).otherwise(acc["best"]).alias("best"), acc["best"].alias("before"), better.alias("hit"), F.when(better, 0).otherwise(acc["idle"] + 1).alias("idle"))

    return df.withColumn("_f", F.aggregate(series, start, step)).select(*by, epoch, metric, F.col("_f.before").alias("best_before"), F.col("_f.hit").alias("improved"), F.col("_f.idle").alias("idle_epochs"))
