"""Errors of predictions and quality of rankings; all are one or two aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.plans.store import stored


def errors(rows: DataFrame, truth: str = "rating", predicted: str = "predicted", cutoff: float | None = None) -> DataFrame:
    """rmse, mae, n; with a cutoff also error_rate, the share on the wrong side of it."""
    e = F.col(truth) - F.col(predicted)
    out = [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n")]
    if cutoff is not None:
        out.append(F.avg(((F.col(truth) >= cutoff) != (F.col(predicted) >= cutoff)).cast("double")).alias("error_rate"))
    return rows.agg(*out)


def log_loss(rows: DataFrame, truth: str = "label", predicted: str = "predicted", floor: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(predicted), F.lit(floor)), F.lit(1 - floor))
    return rows.agg((-F.avg(F.col(truth) * F.log(p) + (1 - F.col(truth)) * F.log(1 - p))).alias("log_loss"))


def average_precision(predicted: DataFrame, actual: DataFrame, k: int) -> DataFrame:
    """user and ap: predicted has user, item, rank (from 1); actual user, item.

    The sum over hits in the first k of hits so far / rank, divided by the smaller of k and the number of actual items.
    """
    size = actual.select("user", "item").distinct().groupBy("user").agg(F.count("*").alias("size"))
    hits = predicted.where(F.col("rank") <= k).join(actual.select("user", "item").distinct(), ["user", "item"])
    order = Window.partitionBy("user").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = hits.withColumn("p", F.count("*").over(order) / F.col("rank")).groupBy("user").agg(F.sum("p").alias("p"))
    return size.join(summed, "user", "left").select("user", (F.coalesce("p", F.lit(0.0)) / F.least("size", F.lit(k))).alias("ap"))


def mean_average_precision(predicted: DataFrame, actual: DataFrame, k: int) -> DataFrame:
    return average_precision(predicted, actual, k).agg(F.avg("ap").alias("map"))


def mean_reciprocal_rank(predicted: DataFrame, relevant: DataFrame) -> DataFrame:
    """mrr over the users of relevant (user, item); a user without a hit counts 0."""
    users = relevant.select("user").distinct()
    first = predicted.join(relevant.select("user", "item").distinct(), ["user", "item"]).groupBy("user").agg(F.min("rank").alias("rank"))
    return users.join(first, "user", "left").agg(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def roc_auc(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """auc by the rank sum, ties counted half.

    Ranks come from counts per distinct score, so the window runs over those, split by ranges of the score.
    """
    per = rows.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) > 0).cast("long")).alias("p"), F.sum((F.col(label) <= 0).cast("long")).alias("n"))
    ranged = per.repartitionByRange("s").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "scores")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("n"))
    below = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = ranged.withColumn("inner", inner).join(F.broadcast(below), "part")  # a row per partition
    won = F.sum(F.col("p") * (F.col("below") + F.col("inner") + F.col("n") / 2))
    return wins.agg((won / (F.sum("p") * F.sum("n"))).alias("auc"))


def halted(history: list[float], falling: bool = True) -> bool:
    """Whether the last value is worse than the one before it: an error that rose, or a score that fell."""
    return len(history) > 1 and (history[-1] > history[-2] if falling else history[-1] < history[-2])
