"""Connected components of a link table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.shared import stored


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    Alternates the large-star and small-star steps until no link changes: every node moves its links to its
    smallest neighbour, so the number of links never grows and the number of rounds is logarithmic. Each round
    is stored in the shared folder, which cuts the lineage. Links from a node to itself or to null are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    edges = stored(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))).distinct(), "links")
    seen = _summary(edges)
    while seen[0]:
        both = edges.select(F.inline(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.inline(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))))
        edges = stored(small.filter("hi != lo").distinct(), "links")
        now = _summary(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())
