"""Labelling runs that can stop and go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.annotations import parse_annotations


def resume_pending(
    todo: DataFrame, done: DataFrame, id_col: str = "id", done_id: str = "row_id", retry_failed: bool = False, max_failures: int | None = None
) -> DataFrame:
    """Rows not done yet, matched by key. Rows without an id are always pending.

    Failed rows count as done if they are in ``done``. With ``retry_failed`` only rows with ``is_valid`` do, so failed rows are
    offered again, until they have failed ``max_failures`` times.
    """
    key = F.col(done_id).alias(id_col)
    if not retry_failed:
        return todo.join(done.select(key), id_col, "left_anti")
    enough = F.bool_or("is_valid")
    if max_failures is not None:
        enough = enough | (F.count_if(~F.col("is_valid")) >= max_failures)
    finished = done.groupBy(key).agg(enough.alias("_enough")).filter("_enough").drop("_enough")
    return todo.join(finished, id_col, "left_anti")


def once(parsed: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Of a stream of annotations the first valid row of every id and each different failed answer to it, whenever they arrive.

    The ids live in the query's state store, which grows with their number, not with the rows; a run that goes on from its
    checkpoint goes on from this state. Of several valid answers to an id in one batch one stays.
    """
    answer = F.when(F.col("is_valid"), F.lit("")).otherwise(F.concat(F.lit("="), F.coalesce("raw_response", F.lit(""))))
    return parsed.withColumn("_answer", F.xxhash64(answer)).dropDuplicates([id_col, "_answer"]).drop("_answer")


def latest_annotations(written: DataFrame, id_col: str = "row_id") -> DataFrame:
    """One row per id of a table that ``incremental_annotate`` wrote, with ``failures``, the failed answers to it.

    The valid row where there is one, else the failed one that comes last in the order of its text.
    """
    best = F.struct(F.col("is_valid"), F.col("raw_response"))
    columns = [c for c in written.columns if c != id_col]
    found = written.groupBy(id_col).agg(F.max_by(F.struct(*columns), best).alias("row"), F.count_if(~F.col("is_valid")).alias("failures"))
    return found.select(id_col, "row.*", "failures")


def incremental_annotate(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    dataset: str,
    mode: str = "single",
    files_per_batch: int = 1000,
    text_col: str | None = "text",
) -> None:
    """Parse every response file not processed yet and append the rows, an id's valid answer once (``once``).

    The checkpoint records which files are done and which ids are, and the file sink commits each batch once, so a run that
    dies goes on where it stopped, without repeating or rewriting finished rows. State is kept in RocksDB, outside the
    memory of the executors' JVMs, for queries started here.
    """
    responses = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    parsed = once(parse_annotations(responses, dataset, text_col=text_col, mode=mode))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (
            parsed.writeStream.format("parquet")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .partitionBy("is_valid")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
