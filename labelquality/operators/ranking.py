"""Ranks over a global order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import stored

ROWS = 33  # bits of monotonically_increasing_id that count the rows of a partition


def ranked(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``rank``, from 0 in every ``key`` by ``order``, and ``total``, the rows of the key. The key is not null.

    Rows are dealt by ranges of (key, order), sorted inside them and stored, so a key of many rows lies in many ranges. What a
    range adds to a rank is one number per (key, range). Rows equal in key and order take their ranks in any order.
    """
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn("_at", at)
    dealt = stored(dealt.withColumn("_part", F.shiftrightunsigned("_at", ROWS)), name)
    parts = dealt.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(key, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("total"))
    found = dealt.join(parts, [key, "_part"]).withColumn("rank", F.col("_base") + F.col("_at") - F.col("_first"))
    return found.drop("_at", "_part", "_first", "_base")
