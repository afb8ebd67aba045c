"""Minimax contiguous partition of documents into shards.

Documents of equal text are one group. Groups are ordered by a hash of the text and cut into shards of
contiguous groups, so that the largest shard is as small as it can be. The order is taken at BUCKETS hash
buckets: a bucket is an atom that holds whole groups, so the table of atoms has a fixed bound at any input size
and an atom is a vanishing part of a shard, except where a single group is large.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import stored

BUCKETS = 1 << 18
ROWS_PER_PART = 50_000  # of one bucket that are numbered in one place


def feasible(prefix: np.ndarray, capacity: int, shards: int) -> bool:
    """Greedy check: fill each shard up to the capacity. prefix: running sums of the atoms."""
    done = 0
    for _ in range(shards):
        k = np.searchsorted(prefix, done + capacity, "right")
        if k == len(prefix):
            return True
        done = prefix[k - 1] if k else 0
    return False


def least_capacity(sizes: np.ndarray, shards: int) -> int:
    """Smallest capacity for which the ordered atoms fit into contiguous shards, by binary search."""
    prefix = np.cumsum(sizes)
    low, high = int(sizes.max(initial=0)), int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(prefix, mid, shards) else (mid + 1, high)
    return low


def cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Index of the first atom of shards 1, 2, ...: no shard above the least capacity, and each end as near as that
    allows to an even share."""
    capacity, n = least_capacity(sizes, shards), len(sizes)
    prefix = np.concatenate(([0], np.cumsum(sizes)))
    earliest = np.zeros(shards + 1, np.int64)  # of each start, such that the rest still fits
    earliest[shards] = n
    for k in range(shards - 1, 0, -1):
        earliest[k] = np.searchsorted(prefix, prefix[earliest[k + 1]] - capacity, "left")
    starts, start = [], 0
    for k in range(1, shards):
        latest = int(np.searchsorted(prefix, prefix[start] + capacity, "right")) - 1
        ideal = k * prefix[n] / shards
        j = int(np.searchsorted(prefix, ideal, "left"))
        j -= int(j > 0 and ideal - prefix[j - 1] < prefix[min(j, n)] - ideal)
        start = int(min(max(j, earliest[k], start), latest))
        starts.append(start)
    return np.array(starts, np.int64)


def _dealt(placed: DataFrame) -> tuple[DataFrame, Column]:
    """What rows of hot buckets are dealt by: their doc_id, or the row where one doc_id (or none) has more rows than a part holds."""
    crowds = placed.filter("parts > 1").groupBy(F.col("bucket").alias("_bucket"), F.col("doc_id").alias("_id")).agg(F.count("*").alias("equal"))
    crowds = crowds.filter(F.col("equal") > ROWS_PER_PART)
    met = (F.col("bucket") == F.col("_bucket")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    joined = placed.join(crowds, met, "left").drop("_bucket", "_id")
    return joined, F.when(F.col("equal").isNotNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id"))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``; texts of one group share a shard.

    Size is the text's UTF-8 bytes plus 8. Null texts count as empty. Slots run from 0 without gaps in each
    shard. With fewer groups than shards some shards stay empty; an empty table gives an empty result. Only the
    table of atoms (BUCKETS rows at most) passes through the driver. Numbering goes on within a bucket or, for a
    bucket of many rows (a text with many copies), within parts of it dealt by a hash of the doc_id. More than
    ROWS_PER_PART rows of one doc_id, or without any, are dealt by row; their slots are theirs in any order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bucket = F.shiftrightunsigned(F.xxhash64(text), 64 - 18).cast("int")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), bucket.alias("bucket")
    )
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    atoms = rows.groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toArrow().sort_by("bucket")
    order, sizes, counts = (atoms[c].to_numpy() for c in ("bucket", "size", "n"))
    ends = [int(order[k]) if k < len(order) else BUCKETS for k in cuts(sizes, shards)] if len(order) else []
    number = sum([(F.col("bucket") >= e).cast("int") for e in ends], F.lit(0))
    many = counts > ROWS_PER_PART
    parts = [(int(b), int(-(-n // ROWS_PER_PART))) for b, n in zip(order[many], counts[many])]
    hot = docs.sparkSession.createDataFrame(parts, "bucket int, parts int")
    placed = rows.join(F.broadcast(hot), "bucket", "left")  # BUCKETS rows at most
    placed, deal = _dealt(placed) if parts else (placed, F.lit(0))
    placed = placed.withColumn("part", F.coalesce(F.pmod(deal, F.col("parts")), F.lit(0)).cast("int")).withColumn("shard", number)
    before = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket", "part").agg(F.count("*").alias("n"))
    starts = starts.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("rank", F.row_number().over(inside)).join(starts, ["bucket", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))
