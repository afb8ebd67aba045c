"""Operator inputs derived from the benchmark tables, always from whole tables.

* labelled text: documents joined with labels; gold = toxic, subgroup = language
* raw responses: a deterministic mix of tagged, bare, fenced, chatty and broken answers per document
* logits: logits of 64 classes and labels from the embeddings table
* binary logits per labelled document, from its length
* binary scores: lineitem quantity or price as a score, return flag as the outcome
* two coders: event type, and event type with every seventh event coded "view"
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.annotations import parse_annotations
from ..operators.uncertainty import predictions

SUPERVISED_TEMPERATURE = 1.0
CLASS_TEMPERATURE = 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), "text", F.col("toxic").alias("gold"), "quality", "lang", "source", "n_chars"
    )


def _mod(a: int, b: int, m: int) -> Column:
    return (F.col("id") * a + b) % m


def with_raw_response(df: DataFrame) -> DataFrame:
    """Add the deterministic raw response of each labelled row."""
    answered = F.when(_mod(7919, 13, 10) < 2, 1 - F.col("gold")).otherwise(F.col("gold"))
    grade = F.when(_mod(17, 3, 7) < 2, "low").when(_mod(17, 3, 7) < 4, "medium").otherwise("high")
    staged = (
        df.withColumn("_p", answered)
        .withColumn("_f", _mod(31, 7, 12))
        .withColumn("_c", grade)
        .withColumn("_lab", F.when(F.col("_p") == 1, "toxic").otherwise("non-toxic"))
        .withColumn("_j", F.concat(F.lit('{"label": "'), "_lab", F.lit('", "confidence": "'), "_c", F.lit('"}')))
    )
    f, j, lab = F.col("_f"), F.col("_j"), F.col("_lab")
    text = (
        F.when(f <= 4, F.concat(F.lit("<json>"), j, F.lit("</json>")))
        .when(f == 5, j)
        .when(f == 6, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
        .when(f == 7, F.concat(F.lit("Sure! "), j, F.lit(" Hope this helps")))
        .when(f == 8, F.concat(F.lit('{"label": "'), lab, F.lit('"}')))
        .when(f == 9, F.concat(F.lit('{"label": "'), lab, F.lit('", "confidence": "certain"}')))
        .when(f == 10, F.concat(F.lit('{"label": "'), lab, F.lit('", "conf')))
        .otherwise(
            F.concat(
                F.lit('assistant\n{"label": "'),
                F.when(F.col("_p") == 1, "TOXIC").otherwise("Not Toxic"),
                F.lit('", "confidence": "'),
                "_c",
                F.lit('"}'),
            )
        )
    )
    return staged.withColumn("raw_response", text).drop("_p", "_f", "_c", "_lab", "_j")


def annotations(spark: SparkSession, sf_dir: str, with_text: bool = False, mode: str = "single", keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed annotations of the labelled documents; the text is read only if asked for."""
    raw = with_raw_response(labelled_text(spark, sf_dir))
    return parse_annotations(raw, "jigsaw", text_col="text" if with_text else None, mode=mode, keep=keep)


def with_binary_logits(df: DataFrame) -> DataFrame:
    """Two-class logits [0, z] with z from the document length, between -2.5 and 2.5."""
    z = ((F.col("n_chars") % 41) - 20) / 8.0
    return df.withColumn("logits", F.array(F.lit(0.0), z.cast("double")))


def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supervised predictions for the labelled documents."""
    return predictions(with_binary_logits(labelled_text(spark, sf_dir)), temperature=SUPERVISED_TEMPERATURE)


def class_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of 64 classes, of which the labels use 0 to 9: id, logits, gold."""
    vectors = table(spark, sf_dir, "embeddings")
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return vectors.select(F.col("vec_id").alias("id"), logits.alias("logits"), F.col("label").alias("gold"))


def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of 64 classes, sharpened so that confidences spread over the bins."""
    return predictions(class_logits(spark, sf_dir), temperature=CLASS_TEMPERATURE)


def multilabel_truth(gold: Column) -> Column:
    """True class set of a row: its label and the next one (so sets of two)."""
    return F.array(gold, (gold + 1) % 10)


def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p from the quantity (never on a bin edge), y from the return flag, grp from the line status."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        ((F.col("l_quantity") - 0.5) / 50.0).alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_linestatus").alias("grp"),
    )


def price_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score with nearly as many distinct values as rows: the price, scaled to about [0, 1]."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        (F.col("l_extendedprice") / 120000.0).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y")
    )


def coders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two codings of the events, and the subgroups of an event: its coder-a type and the parity of its user."""
    events = table(spark, sf_dir, "events")
    b = F.when(F.col("event_id") % 7 == 0, "view").otherwise(F.col("event_type"))
    return events.select(F.col("event_id").alias("id"), F.col("event_type").alias("a"), b.alias("b"), "user_id")


TRUST_INPUT_COLUMNS = (
    "row_id", "gold_label", "llm_label", "llm_confidence", "llm_confidence_numeric", "is_valid", "supervised_label", "entropy", "max_prob",
)


def trust_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations, supervised predictions and text of the labelled documents, from a single join.

    Where the three lie in separate tables, join them on their key; here all derive from one row.
    """
    raw = with_binary_logits(with_raw_response(labelled_text(spark, sf_dir)))
    ann = parse_annotations(raw, "jigsaw", text_col=None, keep=("logits", "text"))
    kept = tuple(c for c in ann.columns if c not in ("row_id", "logits"))
    preds = predictions(ann, id_col="row_id", gold=None, temperature=SUPERVISED_TEMPERATURE, keep=kept)
    named = preds.withColumnRenamed("example_id", "row_id").withColumnRenamed("predicted_label", "supervised_label")
    return named.select(*TRUST_INPUT_COLUMNS, "text")
