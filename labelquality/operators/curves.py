"""Threshold curves on scores: precision/recall, ROC area, average precision.

A curve needs running totals over all distinct scores. Rows are first aggregated to one row per distinct
score, and these are stored in the shared folder in ranges of similar size, as many as the rows need; running
sums are taken inside each range and shifted by the totals of the ranges above it, which join by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.scalar import ratio
from ..sources.shared import stored

ROWS_PER_RANGE = 250_000


def score_counts(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Distinct scores with their positive and negative counts. Rows without a score are left out; NaN is an error."""
    known = df.filter(F.col(score).isNotNull())
    return known.groupBy(ranked_score(F.col(score)).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def ranked_score(score: Column) -> Column:
    """The score; a task that meets NaN fails, since NaN has no place in a ranking."""
    return F.when(F.isnan(score), F.raise_error("a score is NaN")).otherwise(score)


def cumulative_counts(df: DataFrame, score: str, positive: Column, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per distinct score: pos, neg, and tp, fp = counts at this score or above, and the totals.

    Aggregates and stores when called, since the ranges follow from the number of distinct scores.
    """
    return accumulated(stored(score_counts(df, score, positive), "scores"), rows_per_range)


def accumulated(counts: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``cumulative_counts`` from a stored table (score, pos, neg) of distinct scores."""
    ranges = max(1, -(-counts.count() // rows_per_range))
    everything = Window.partitionBy()
    if ranges == 1:  # at most rows_per_range rows
        down = Window.orderBy(F.desc("score"))
        sums = {"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)}
        return counts.withColumns(sums | {"positives": F.sum("pos").over(everything), "negatives": F.sum("neg").over(everything)})
    # Range 0 holds the highest scores.
    placed = stored(counts.repartitionByRange(ranges, F.desc("score")).withColumn("part", F.spark_partition_id()), "ranges")
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = placed.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("tp_above"),
        F.coalesce(F.sum("q").over(above), F.lit(0)).alias("fp_above"),
        F.sum("p").over(everything).alias("positives"),
        F.sum("q").over(everything).alias("negatives"),
    )
    inside = Window.partitionBy("part").orderBy(F.desc("score"))
    return (
        placed.withColumn("tp", F.sum("pos").over(inside))
        .withColumn("fp", F.sum("neg").over(inside))
        .join(offsets, "part")
        .withColumn("tp", F.col("tp") + F.col("tp_above"))
        .withColumn("fp", F.col("fp") + F.col("fp_above"))
        .drop("part", "tp_above", "fp_above")
    )


def pr_curve(df: DataFrame, score: str, positive: Column, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Precision and recall when everything at or above a distinct score is accepted."""
    cum = cumulative_counts(df, score, positive, rows_per_range)
    return cum.select(
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        # With no positive at all recall is 1 by convention.
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("positives")), F.lit(1.0)).alias("recall"),
        "pos",
        "positives",
    )


def best_f1_threshold(df: DataFrame, score: str, positive: Column, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Threshold with the best F1, the lowest one among equals."""
    p, r = F.col("precision"), F.col("recall")
    f1 = 2.0 * (p * r) / (p + r + F.lit(fixed.F1_EPSILON))
    curve = pr_curve(df, score, positive, rows_per_range).withColumn("f1", f1)
    return curve.agg(
        F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1_score")
    )


def roc_auc(df: DataFrame, score: str, positive: Column, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting one half; NULL if a class is missing."""
    cum = cumulative_counts(df, score, positive, rows_per_range)
    higher = F.col("tp") - F.col("pos")
    wins = F.sum(F.col("neg").cast("double") * (higher + 0.5 * F.col("pos")))
    pairs = F.max(F.col("positives").cast("double") * F.col("negatives"))
    return cum.agg(F.try_divide(wins, F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, positive: Column, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Sum of precision weighted by the recall each threshold adds."""
    curve = pr_curve(df, score, positive, rows_per_range)
    return curve.agg(
        F.coalesce(F.try_divide(F.sum(F.col("precision") * F.col("pos")), F.max("positives")), F.lit(0.0)).alias("average_precision")
    )


def precision_at_recall(df: DataFrame, score: str, positive: Column, levels=(0.90, 0.95), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Best precision among thresholds that reach each recall level."""
    curve = pr_curve(df, score, positive, rows_per_range)
    return curve.agg(
        *[F.max(F.when(F.col("recall") >= lv, F.col("precision"))).alias(f"precision_at_{round(lv * 100)}_recall") for lv in levels]
    )


def curve_metrics(df: DataFrame, score: str, positive: Column, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """ROC area, PR area, precision at 90% and 95% recall and best F1 from a single curve."""
    return metrics_of(cumulative_counts(df, score, positive, rows_per_range))


def metrics_of(cum: DataFrame) -> DataFrame:
    """The same from cumulative counts."""
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("positives")), F.lit(1.0))
    pts = cum.withColumn("precision", precision).withColumn("recall", recall)
    p, r = F.col("precision"), F.col("recall")
    wins = F.sum(F.col("neg").cast("double") * (F.col("tp") - 0.5 * F.col("pos")))
    pairs = F.max(F.col("positives").cast("double") * F.col("negatives"))
    return pts.agg(
        F.try_divide(wins, F.nullif(pairs, F.lit(0.0))).alias("roc_auc"),
        F.coalesce(F.try_divide(F.sum(p * F.col("pos")), F.max("positives")), F.lit(0.0)).alias("pr_auc"),
        F.max(F.when(r >= 0.90, p)).alias("precision_at_90_recall"),
        F.max(F.when(r >= 0.95, p)).alias("precision_at_95_recall"),
        F.max(2.0 * p * r / (p + r + F.lit(fixed.F1_EPSILON))).alias("f1_score"),
    )
