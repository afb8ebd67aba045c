"""Trust scores: features, learners, decisions, evaluation, persistence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import fixed
from ..functions.scalar import ratio
from ..sources.shared import stored
from . import agreement, curves, sampling
from .forest import SETTINGS, Forest, ForestModel
from .text_features import text_features

FEATURE_COLUMNS = [f"trust_feat_{name}" for name in fixed.TRUST_FEATURES]

_COLUMNS = {"featuresCol": "features", "labelCol": "trust_label"}


def _forest(**settings) -> Estimator:
    """The forest grown in tasks; Spark's own, which keeps all trees on the driver, for settings that only it has."""
    return (Forest if SETTINGS.issuperset(settings) else RandomForestClassifier)(**_COLUMNS, **settings)


# Learner factories; n is the number of training rows, other settings can be given. The logistic penalty is an L2
# weight of 1 on the summed loss, which is 1/n on Spark's mean loss, on the features as they are. Forest trees go
# down as far as the library allows (30 levels), since the model asks for no limit.
LEARNERS = {
    "logistic_regression": lambda n, **o: LogisticRegression(**_COLUMNS, **({"regParam": 1.0 / max(n, 1), "standardization": False, "tol": 1e-6} | o)),
    "random_forest": lambda n, **o: _forest(**({"numTrees": 100, "maxDepth": 30, "seed": fixed.SEED} | o)),
    "gradient_boosting": lambda n, **o: GBTClassifier(**_COLUMNS, **({"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": fixed.SEED} | o)),
}


def trust_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the eight feature columns. Narrow: nothing moves.

    Needs llm_label, llm_confidence_numeric, supervised_label, entropy, max_prob and the text. Join
    annotations, predictions and texts on their key first (``hard_cases.with_predictions``).
    """
    names = [c for c in df.columns if c != text_col]
    texts = text_features(df, text_col, keep=tuple(names))
    differs = F.coalesce((F.col("llm_label") != F.col("supervised_label")).cast("double"), F.lit(0.0))
    values = [
        F.col("llm_confidence_numeric"),
        differs,
        F.col("entropy"),
        F.col("max_prob"),
        F.col("negation_density"),
        F.col("hedge_density"),
        F.col("sentiment_compound"),
        F.col("flesch_reading_ease"),
    ]
    return texts.select(*names, *[F.coalesce(v, F.lit(0.0)).alias(c) for v, c in zip(values, FEATURE_COLUMNS)])


def trust_label(df: DataFrame) -> DataFrame:
    """1 where the model label equals gold."""
    return df.withColumn("trust_label", F.coalesce((F.col("llm_label") == F.col("gold_label")).cast("int"), F.lit(0)))


@dataclass
class TrustModel:
    """A fitted model with the columns it reads and its decision threshold."""

    model: PipelineModel
    model_type: str
    feature_columns: list[str]
    threshold: float = fixed.TRUST_THRESHOLD
    task: str | None = None

    def score(self, df: DataFrame) -> DataFrame:
        return score_trust(df, self)


def score_trust(df: DataFrame, trained: TrustModel | None) -> DataFrame:
    """Add ``trust_score``, the probability that the annotation is right."""
    if trained is None:
        raise ValueError("Model must be trained before prediction")
    scored = trained.model.transform(df)
    return scored.withColumn("trust_score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def trust_decision(df: DataFrame, threshold: float = fixed.TRUST_THRESHOLD, score: str = "trust_score") -> DataFrame:
    """1 = accept, 0 = send to review."""
    return df.withColumn("trust_decision", (F.col(score) >= F.lit(float(threshold))).cast("int"))


def fit_trust(train: DataFrame, model_type: str, features: Sequence[str] = tuple(FEATURE_COLUMNS), **settings) -> TrustModel:
    """Fit a learner on all rows of ``train`` (the feature columns and ``trust_label``); ``settings`` go to the learner."""
    if model_type not in LEARNERS:
        raise ValueError(f"Unknown model type: {model_type}")
    columns = list(features)
    stages = [VectorAssembler(inputCols=columns, outputCol="features"), LEARNERS[model_type](train.count(), **settings)]
    return TrustModel(Pipeline(stages=stages).fit(train), model_type, columns)


def root_splits(trained: TrustModel) -> list[tuple[str, float, float] | None]:
    """(feature, threshold, impurity gain) of the first decision of every tree; None for a tree that is a single leaf."""
    model = trained.model.stages[-1]
    if isinstance(model, ForestModel):
        return [r and (trained.feature_columns[r[0]], *r[1:]) for r in model.roots()]
    roots = [tree._java_obj.rootNode() for tree in model.trees]
    inner = [r if r.subtreeDepth() else None for r in roots]
    return [r and (trained.feature_columns[r.split().featureIndex()], r.split().threshold(), r.gain()) for r in inner]


def train_trust(
    df: DataFrame,
    model_type: str = "logistic_regression",
    validation_split: float = 0.2,
    id_col: str = "row_id",
    features: Sequence[str] = tuple(FEATURE_COLUMNS),
    seed: int = fixed.SEED,
    **settings,
) -> tuple[TrustModel, dict[str, float]]:
    """Fit on a stratified share of the rows and pick the threshold with the best F1 on the others.

    ``settings`` go to the learner (numTrees, maxDepth, regParam, ...). The split rows (id, label, features) are
    written to the shared folder once; all passes of the fit and the evaluation read that table.
    """
    if model_type not in LEARNERS:
        raise ValueError(f"Unknown model type: {model_type}")
    columns = list(features)
    data = stored(trust_label(df).select(id_col, "trust_label", *columns), "trust-rows")
    parts = stored(sampling.split_in_two(data, validation_split, "train", "validation", id_col, "trust_label", seed), "trust-split")
    parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        trained = fit_trust(parts.filter("split = 'train'"), model_type, columns, **settings)
        scored = score_trust(parts, trained).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            held = scored.filter("split = 'validation'")
            right = F.col("trust_label") == 1
            best = curves.best_f1_threshold(held, "trust_score", right).first()
            trained.threshold = float(best["threshold"]) if best["threshold"] is not None else fixed.TRUST_THRESHOLD
            half = (F.col("trust_score") >= fixed.TRUST_THRESHOLD).cast("int") == F.col("trust_label")
            rates = {r["split"]: r["acc"] for r in scored.groupBy("split").agg(F.avg(half.cast("double")).alias("acc")).collect()}
            auc = curves.roc_auc(held, "trust_score", right).first()["roc_auc"]
        finally:
            scored.unpersist()
    finally:
        parts.unpersist()
    metrics = {
        "train_accuracy": rates.get("train"),
        "val_accuracy": rates.get("validation"),
        "val_auc": auc,
        "optimal_threshold": trained.threshold,
    }
    return trained, metrics


def trust_eval(df: DataFrame, threshold: float = fixed.TRUST_THRESHOLD, score: str = "trust_score", label: str = "trust_label") -> DataFrame:
    """Accuracy, precision, recall and F1 of the decisions, and the ROC area of the scores."""
    decided = trust_decision(df, threshold, score)
    s = agreement.summary(agreement.class_counts(agreement.confusion_counts(decided, label, "trust_decision")))
    auc = curves.roc_auc(df, score, F.col(label) == 1)
    return s.select("n", "accuracy", *[F.col(f"{m}_binary").alias(m) for m in agreement.METRICS]).withColumn("auc", auc.scalar())


def confidence_regions(df: DataFrame, thresholds: Sequence[float], score: str = "trust_score", label: str = "trust_label") -> DataFrame:
    """For each threshold: accepted share, accuracy among accepted, rows left to review.

    One pass: rows are counted between neighbouring thresholds, then accumulated over the few thresholds.
    """
    levels = sorted(float(t) for t in thresholds)
    # Number of thresholds the score reaches (score >= threshold).
    reached = F.when(F.col(score) >= levels[0], F.lit(1)).otherwise(F.lit(0))
    for t in levels[1:]:
        reached = reached + F.when(F.col(score) >= t, F.lit(1)).otherwise(F.lit(0))
    between = df.groupBy(reached.alias("level")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("right"))
    zero = F.lit(0).cast("long")
    grid = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(levels)], "level int, threshold double")
    table = between.select("level", F.lit(None).cast("double").alias("threshold"), "n", "right").unionByName(
        grid.select("level", "threshold", zero.alias("n"), zero.alias("right"))
    )
    per = table.groupBy("level").agg(F.max("threshold").alias("threshold"), F.sum("n").alias("n"), F.sum("right").alias("right"))
    upward = Window.orderBy(F.desc("level"))  # one row per threshold
    everything = Window.partitionBy()
    run = per.select(
        "threshold",
        F.sum("n").over(upward).alias("accepted"),
        F.sum("right").over(upward).alias("right"),
        F.sum("n").over(everything).alias("total"),
    )
    return run.filter("threshold IS NOT NULL").select(
        "threshold",
        ratio(F.col("accepted"), F.col("total")).alias("coverage"),
        ratio(F.col("right"), F.col("accepted")).alias("accepted_accuracy"),
        (F.col("total") - F.col("accepted")).alias("review_count"),
    )


def review_queue(df: DataFrame, threshold: float = fixed.TRUST_THRESHOLD, limit: int = 100, score: str = "trust_score", id_col: str = "row_id") -> DataFrame:
    """The least trusted annotations first, for people to check."""
    return df.filter(F.col(score) < F.lit(float(threshold))).orderBy(score, id_col).limit(limit)


def save_trust(spark: SparkSession, trained: TrustModel | None, path: str) -> None:
    """Write the fitted stages and a one-row table with type, task, columns and threshold."""
    if trained is None:
        raise ValueError("Model must be trained before saving")
    trained.model.write().overwrite().save(f"{path}/model")
    row = [(trained.model_type, trained.task, trained.feature_columns, float(trained.threshold))]
    schema = "model_type string, task string, feature_columns array<string>, threshold double"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_trust(spark: SparkSession, path: str) -> TrustModel:
    meta = spark.read.parquet(f"{path}/metadata").first()
    return TrustModel(PipelineModel.load(f"{path}/model"), meta["model_type"], list(meta["feature_columns"]), meta["threshold"], meta["task"])
