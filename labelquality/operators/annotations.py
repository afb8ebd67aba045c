"""Annotation table: responses to typed rows, plus the summaries and filters that start from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import fixed, text as tx
from ..functions.labels import confidence_numeric, display_label, label_code, label_name
from ..functions.responses import clean_response, extract_json, validate_response


def validated(df: DataFrame, task: str, response: str = "raw_response", mode: str = "single") -> DataFrame:
    """Clean, extract and validate in one narrow projection; keeps all input columns."""
    out = df.withColumn(response, clean_response(F.col(response), mode))
    out = extract_json(out, response)
    return validate_response(out, task).drop("json_text", "extract_error")


def parse_annotations(
    df: DataFrame,
    dataset: str,
    id_col: str = "id",
    gold_col: str = "gold",
    text_col: str | None = "text",
    mode: str = "single",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One typed row per response, valid or not.

    Without ``text_col`` the hash and length columns are left out, so that the text is not read at all.
    """
    task = fixed.DATASETS[dataset]["task"]
    out = validated(df, task, mode=mode)
    ok = F.col("is_valid")
    code = label_code(F.col("label"), dataset)
    cols = [F.col(id_col).alias("row_id")]
    if text_col:
        cols += [tx.text_hash(F.col(text_col)).alias("text_hash"), F.length(text_col).alias("text_len")]
    cols += [
        F.col(gold_col).cast("int").alias("gold_label"),
        label_name(F.col(gold_col), dataset).alias("gold_label_str"),
        F.when(ok, code).alias("llm_label"),
        F.when(ok, display_label(F.col("label"))).alias("llm_label_str"),
        F.col("confidence").alias("llm_confidence"),
        F.when(ok, confidence_numeric(F.col("confidence"))).alias("llm_confidence_numeric"),
        F.col("rationale").alias("llm_rationale"),
        "raw_response",
        "is_valid",
        "error",
        "error_type",
        *keep,
    ]
    return out.select(*cols)


def validation_pass_rate(annotations: DataFrame) -> DataFrame:
    """Valid rows over all rows."""
    return annotations.agg(
        F.count("*").alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.coalesce(F.avg(F.col("is_valid").cast("double")), F.lit(0.0)).alias("pass_rate"),
    )


def error_breakdown(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("is_valid", "error_type").agg(F.count("*").alias("n"))


def dedup_by_hash(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: its displayed hash, the smallest id, and how many copies there were.

    Texts are told apart by the whole SHA-256; the sixteen digits of ``text_hash`` are for display. Only ids and
    hashes are aggregated, map-side first, so a hot text costs one row per task.
    """
    return (
        df.select(F.col(id_col).alias("id"), F.sha2(F.col(text_col), 256).alias("sha256"))
        .groupBy("sha256")
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"))
        .select(F.substring("sha256", 1, fixed.HASH_PREFIX).alias("text_hash"), "sha256", "id", "copies")
    )


def select_rationale(
    df: DataFrame,
    id_col: str = "row_id",
    entropy_threshold: float = fixed.ENTROPY_THRESHOLD,
    audit_rate: float = fixed.AUDIT_RATE,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Rows that need a rationale, with the reasons.

    Needs llm_label, gold_label, llm_confidence_numeric and entropy. The audit share is drawn by a hash
    of the id, so the same rows are drawn on every run and no counting is needed.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("llm_confidence_numeric") < fixed.LOW_CONFIDENCE, "low_confidence"),
            F.when((F.col("llm_label") >= 0) & (F.col("llm_label") != F.col("gold_label")), "disagreement"),
            F.when(F.col("entropy") > entropy_threshold, "baseline_uncertain"),
            F.when(draw < audit_rate, "audit"),
        )
    )
    return df.withColumn("rationale_reasons", reasons).filter(F.size("rationale_reasons") > 0)


def annotate_with(
    df: DataFrame,
    respond: Callable[[pd.Series], pd.Series],
    text_col: str = "text",
    response_col: str = "raw_response",
) -> DataFrame:
    """Add a model's raw responses to a DataFrame.

    ``respond`` maps a batch of texts to a batch of responses; build the model inside a closure that
    caches it, so each Python worker loads it once. Batches follow spark.sql.execution.arrow settings.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(response_col, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[response_col] = respond(batch[text_col]).astype("object")
            yield batch[[*names, response_col]]

    return df.mapInPandas(run, schema)
