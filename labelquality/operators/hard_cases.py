"""Hard cases: rows worth a second look, the reasons, and patterns among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, text as tx
from ..functions.scalar import ratio


def _disagrees() -> Column:
    return (F.col("llm_label") >= 0) & (F.col("llm_label") != F.col("gold_label"))


def hard_cases(
    annotations: DataFrame,
    texts: DataFrame | None = None,
    threshold: float = fixed.LOW_CONFIDENCE,
    id_col: str = "id",
    text_col: str = "text",
) -> DataFrame:
    """Valid annotations that disagree with gold or are of low confidence, with reasons.

    If the annotations carry ``text_col``, a preview is cut from it in the same narrow step. Texts in a table of
    their own (``texts``) are first filtered to the hard ids, so only the previews of hard rows are joined.
    """
    reasons = F.array_compact(
        F.array(
            F.when(_disagrees(), "disagreement"),
            F.when(F.col("llm_confidence_numeric") < threshold, "low_confidence"),
        )
    )
    hard = annotations.filter("is_valid").withColumn("reason", reasons).filter(F.size("reason") > 0)
    if texts is None:
        if text_col not in annotations.columns:
            return hard
        return hard.withColumn("text_preview", tx.text_preview(F.col(text_col))).drop(text_col)
    wanted = texts.join(hard.select(F.col("row_id").alias(id_col)), id_col, "left_semi")
    previews = wanted.select(F.col(id_col).alias("row_id"), tx.text_preview(F.col(text_col)).alias("text_preview"))
    return hard.join(previews, "row_id", "left")


def hard_case_rate(annotations: DataFrame, threshold: float = fixed.LOW_CONFIDENCE) -> DataFrame:
    hard = F.coalesce(_disagrees() | (F.col("llm_confidence_numeric") < threshold), F.lit(False))
    return annotations.filter("is_valid").agg(
        F.count("*").alias("total"),
        F.count_if(hard).alias("hard_cases"),
        F.coalesce(F.avg(hard.cast("double")), F.lit(0.0)).alias("hard_case_rate"),
    )


def hard_by_agreement(df: DataFrame, threshold: float = fixed.AGREEMENT_THRESHOLD) -> DataFrame:
    score = F.coalesce((F.col("llm_label") == F.col("gold_label")).cast("double"), F.lit(0.0))
    return df.withColumn("agreement_score", score).withColumn("is_hard_case_agreement", F.col("agreement_score") < threshold)


def hard_by_entropy(df: DataFrame, threshold: float = fixed.ENTROPY_THRESHOLD, entropy: str = "entropy") -> DataFrame:
    return df.withColumn("entropy_score", F.col(entropy)).withColumn(
        "is_hard_case_entropy", F.coalesce(F.col(entropy) > threshold, F.lit(False))
    )


def with_predictions(annotations: DataFrame, predictions: DataFrame) -> DataFrame:
    """Align supervised predictions with annotations by key (left: unmatched annotations stay)."""
    right = predictions.select(
        F.col("example_id").alias("row_id"), F.col("predicted_label").alias("supervised_label"), "entropy", "max_prob"
    )
    return annotations.join(right, "row_id", "left")


def hard_by_disagreement(df: DataFrame) -> DataFrame:
    """Needs llm_label and supervised_label; a missing side does not count as disagreement."""
    differs = F.coalesce(F.col("llm_label") != F.col("supervised_label"), F.lit(False))
    return df.withColumn("model_disagreement", differs.cast("int")).withColumn("is_hard_case_disagreement", differs)


def difficulty_score(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted difficulty from the three indicators, and whether it exceeds one half."""
    w = weights or fixed.DIFFICULTY_WEIGHTS
    marked = hard_by_disagreement(hard_by_entropy(hard_by_agreement(df)))
    score = (
        F.lit(w["agreement"]) * (1.0 - F.col("agreement_score"))
        + F.lit(w["entropy"]) * F.coalesce("entropy_score", F.lit(0.0))
        + F.lit(w["disagreement"]) * F.col("model_disagreement")
    )
    return marked.withColumn("difficulty_score", score).withColumn(
        "is_hard_case_overall", F.col("difficulty_score") > fixed.DIFFICULTY_THRESHOLD
    )


def hard_case_patterns(df: DataFrame, features: list[str], hard: str = "is_hard_case_overall") -> DataFrame:
    """Totals, ratio, confidence mix and mean text features, hard against easy: one row per side.

    Needs ``hard``, llm_confidence and the feature columns.
    """
    total = F.sum("cases").over(Window.partitionBy())  # two rows
    grades = [F.count_if(F.col("llm_confidence") == g).alias(f"{g}_confidence") for g in fixed.CONFIDENCE_VALUES]
    return (
        df.groupBy(F.col(hard).alias("is_hard"))
        .agg(F.count("*").alias("cases"), *grades, *[F.avg(c).alias(f"mean_{c}") for c in features])
        .withColumn("ratio", ratio(F.col("cases"), total))
    )


def error_pairs(annotations: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent (gold, model) confusions; ties by label."""
    return (
        annotations.filter(F.col("is_valid") & _disagrees())
        .groupBy("gold_label", "llm_label")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "gold_label", "llm_label")
        .limit(limit)
    )
