"""A training corpus from documents: known language, near copies out, repeated passages out, mixed, encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor, which are stored in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelquality.llm import bpe, language, mixing, simhash, suffixes
from labelquality.llm.catalog import vocabulary
from labelquality.llm.repeats import keyed_columns
from labelquality.llm.texts import free
from labelquality.sources.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, which have no language, go. The model learns from the documents that are not held out."""
    return language.keep_known(docs, language.learn(docs.filter(~language.held_out(F.col("doc_id")))))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints the one with the smallest doc_id stays, decided by row."""
    return simhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by repeated strings go from the texts; half a character at a cut goes with them. All rows stay."""
    first, second = free("_k1", docs.columns), free("_k2", docs.columns)
    cut = suffixes.cut_texts(docs).select(F.col("k1").alias(first), F.col("k2").alias(second), F.col("kept").alias("text"))
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    _, k1, k2, _ = keyed_columns("doc_id", "text")
    joined = docs.select(*rest, k1.alias(first), k2.alias(second)).join(cut, [first, second])
    return joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    row, times, turn = (free(c, docs.columns) for c in ("_row", "_copies", "_turn"))  # ids may be null or repeated, rows are numbered
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    copies = mixing.mix(rows, carry=(row,)).select(row, F.col("copies").alias(times))
    return rows.join(copies, row).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(turn)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every document, with digests of them and of the decoded text."""
    return bpe.digests(docs, vocabulary(), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("encoding", encoded),
]

ORACLE_SQL = None  # no stage can be said in SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents table, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
