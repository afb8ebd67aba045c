"""Prediction tables: from logits to labels, entropy and confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import probability as pr


def predictions(
    df: DataFrame,
    logits: str = "logits",
    id_col: str = "id",
    gold: str | None = "gold",
    temperature: float = 1.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Single-label prediction columns from logits; ``temperature`` divides the logits first, and they are returned divided."""
    out = df.withColumn("probabilities", pr.softmax(F.col(logits), temperature))
    cols = [
        F.col(id_col).alias("example_id"),
        pr.argmax_label(F.col("probabilities")).alias("predicted_label"),
        pr.tempered(F.col(logits), temperature).alias("logits"),
        "probabilities",
        pr.categorical_entropy(F.col("probabilities")).alias("entropy"),
        pr.max_prob(F.col("probabilities")).alias("max_prob"),
    ]
    if gold:
        cols.insert(1, F.col(gold).cast("int").alias("gold_label"))
        cols.append((pr.argmax_label(F.col("probabilities")) == F.col(gold)).alias("correct"))
    return out.select(*cols, *keep)


def multilabel_predictions(
    df: DataFrame,
    logits: str = "logits",
    id_col: str = "id",
    thresholds: Sequence[float] | float = 0.5,
    temperature: float = 1.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Multi-label prediction columns from logits."""
    return (
        df.withColumn("probabilities", pr.sigmoid_probs(F.col(logits), temperature))
        .withColumn("predicted_labels", pr.multilabel_predict(F.col("probabilities"), thresholds))
        .select(
            F.col(id_col).alias("example_id"),
            "predicted_labels",
            pr.tempered(F.col(logits), temperature).alias("logits"),
            "probabilities",
            pr.binary_entropy_mean(F.col("probabilities")).alias("entropy"),
            pr.multilabel_confidence(F.col("probabilities"), F.col("predicted_labels")).alias("confidence"),
            F.lit(True).alias("thresholded"),
            *keep,
        )
    )


def verify_predictions(preds: DataFrame) -> DataFrame:
    """Row count, mean probability sum, and the largest gap between stored and recomputed entropy."""
    again = pr.categorical_entropy(F.col("probabilities"))
    return preds.agg(
        F.count("*").alias("n"),
        F.avg(pr.array_sum(F.col("probabilities"))).alias("mean_probability_sum"),
        F.max(F.abs(again - F.col("entropy"))).alias("max_entropy_gap"),
    )


def average_entropy_confidence(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg("entropy").alias("average_entropy"), F.avg("max_prob").alias("average_confidence"))
