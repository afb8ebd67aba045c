"""Writers. Large tables are written by the executors; only small metric tables become single files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_annotations(annotations: DataFrame, path: str, mode: str = "append") -> None:
    """One parquet table, valid and failed rows in separate partitions."""
    annotations.write.mode(mode).partitionBy("is_valid").parquet(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """The written table; the partition column comes back as a boolean and still prunes partitions."""
    return spark.read.parquet(path).withColumn("is_valid", F.col("is_valid").cast("boolean"))


def valid_rows(annotations: DataFrame) -> DataFrame:
    return annotations.filter("is_valid")


def failed_rows(annotations: DataFrame) -> DataFrame:
    """Failed rows in their short form."""
    return annotations.filter("NOT is_valid").select(
        "row_id", "text_hash", "text_len", "error", F.col("raw_response").alias("raw_output")
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that ``read_csv_splits`` reads back exactly, line breaks, quotes and blanks included."""
    (
        df.write.mode("overwrite")
        .options(header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def write_sample_ids(sample: DataFrame, path: str, id_col: str = "id", text_col: str = "text", label_col: str = "label") -> None:
    """The sample as (text, label) and its (original_index, label) list."""
    write_csv(sample.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")), f"{path}/sample.csv")
    write_csv(sample.select(F.col(id_col).alias("original_index"), F.col(label_col).alias("label")), f"{path}/sample_ids.csv")


def write_metrics(reports: DataFrame, path: str, by: str = "dataset") -> bool:
    """Metric rows as JSON with a time stamp, one folder per data set, plus a combined file.

    The combined file is written only if there is more than one data set; returns whether it was.
    """
    stamped = reports.withColumn("timestamp", F.current_timestamp()).withColumn(f"{by}_name", F.col(by))
    stamped.write.mode("overwrite").partitionBy(by).json(f"{path}/by_{by}")
    written = reports.sparkSession.read.json(f"{path}/by_{by}")
    several = len(written.select(by).distinct().limit(2).collect()) > 1
    if several:
        written.drop(f"{by}_name").coalesce(1).write.mode("overwrite").json(f"{path}/combined")
    return several


def write_predictions(predictions: DataFrame, path: str, mode: str = "overwrite") -> None:
    predictions.write.mode(mode).parquet(path)
