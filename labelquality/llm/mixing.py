"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import stored
from .texts import WORD

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5  # of all words
MOST = 2.0  # times a source's own words
BLOCK = 4096  # documents of one source in one flight
EPSILON = 1e-9


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target) from (source, size): one row per source, null last.

    Sources in code-point order weigh ``weights`` in turn and share ``budget`` times all sizes. Targets stop at
    ``most`` times the source's size and the excess is shared again, which ends at min(most * size, level *
    weight): sources are full from the smallest ratio of room to weight on, and the level follows from the rest.
    """
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))  # one row per source, here and below
    everything = Window.partitionBy()
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = by_source.withColumn("w", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("room", F.col("source_size") * float(most)).withColumn("ratio", F.col("room") / F.col("w"))
    fuller = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(fuller), F.lit(0.0))
    rest = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(fuller), F.lit(0.0))
    weighed = weighed.withColumn("level", left / rest)
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.coalesce(F.least("room", F.col("w") * level), F.col("room"))
    return weighed.select("source", "n", "source_size", target.alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, draw: np.random.Generator, land: bool = False) -> np.ndarray:
    """Move chances to 0 or 1 so that their sum and the sum of size * chance stay as they are.

    Keeps three undecided documents at a time. With three columns and two constraints there is a direction u in
    the null space, the cross product of the constraints; the chances move along +u or -u, with probabilities
    that keep each chance's expectation, until one of the three is decided. At most two documents stay undecided.
    With ``land`` the document count is given up next, which leaves one, and that is decided by its chance alone.
    """
    chance = chance.copy()
    open_ = np.flatnonzero((chance > EPSILON) & (chance < 1 - EPSILON))
    order, pool, at = open_.tolist(), [], 0
    coins = draw.random(len(order) + 3).tolist()
    p, s = chance.tolist(), size.tolist()

    def move(pool: list[int], u: list[float], coin: float) -> list[int]:
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(pool, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(pool, u) if v)
        step = up if coin * (up + down) < down else -down
        for i, v in zip(pool, u):
            p[i] += step * v
        return [i for i in pool if EPSILON < p[i] < 1 - EPSILON]

    turn = iter(coins)
    while True:
        while len(pool) < 3 and at < len(order):
            pool.append(order[at])
            at += 1
        if len(pool) < 3:
            break
        a, b, c = (s[i] for i in pool)
        u = [b - c, c - a, a - b]
        scale = max(map(abs, u))
        pool = move(pool, [v / scale for v in u] if scale else [1.0, -1.0, 0.0], next(turn))
    if len(pool) == 2 and s[pool[0]] == s[pool[1]]:
        pool = move(pool, [1.0, -1.0], next(turn))
    if land:
        if len(pool) == 2:
            a, b = (s[i] for i in pool)
            pool = move(pool, [b / max(a, b), -a / max(a, b)], next(turn))
        for i in pool:
            p[i] = float(next(turn) < p[i])
    return np.array(p)


def _fly(land: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """Large documents first, so that what stays undecided is small."""
        block = block.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], ignore_index=True)
        draw = np.random.default_rng(block["h"].to_numpy().view(np.uint64))
        block["chance"] = flight(block["chance"].to_numpy(float), block["size"].to_numpy(float), draw, land)
        return block

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) and the columns ``carry`` for every row of ``docs``.

    A source's rate is target / source_size, between 0 and 2. Each of its documents is taken floor(rate) times,
    and once more with the chance that is left. The cube method turns these chances into decisions that keep each
    source's words and document count: flights run over blocks of a source dealt by a hash of the doc_id, the at
    most two undecided documents of each block form the next, much smaller round, and the last block of a source
    lands. So a source of any size is split, and its words miss the target by less than one small document.
    Decisions depend on (seed, doc_id, size) only, so reruns agree. More than BLOCK rows of a source with one
    (doc_id, size), or with none and one size, are dealt by row; which of these equal rows is taken may differ. Null texts have size 0, null is a source of
    its own, repeated rows are decided one by one, an empty table gives an empty result.
    """
    h = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), "size")
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), *carry)
    sizes = stored(sizes.withColumn("h", h).withColumn("deal", F.monotonically_increasing_id()), "sizes")
    crowds = sizes.groupBy(F.col("source").alias("_source"), F.col("h").alias("_h")).agg(F.count("*").alias("equal")).filter(F.col("equal") > BLOCK)
    met = F.col("source").eqNullSafe(F.col("_source")) & (F.col("h") == F.col("_h"))
    dealt_by = F.when(F.col("equal").isNotNull(), F.col("deal")).otherwise(F.lit(0))
    plan = stored(targets(sizes, weights), "targets")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rated = sizes.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("rate", rate)
    whole = F.floor(F.col("rate") + EPSILON)
    state = rated.withColumn("whole", whole.cast("int")).withColumn("chance", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    state = state.drop("rate").join(crowds, met, "left").withColumn("deal", dealt_by).drop("_source", "_h", "equal")
    decided, turn = [], 0
    undecided = f"chance > {EPSILON} and chance < {1 - EPSILON}"
    while True:
        open_ = state.filter(undecided)
        counts = open_.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        last = (counts.agg(F.max("blocks")).first()[0] or 0) <= 1
        decided.append(state.filter(f"not ({undecided})"))
        counts = counts.withColumnRenamed("source", "_source")
        dealt = open_.join(counts, F.col("source").eqNullSafe(F.col("_source"))).withColumn("block", F.pmod(F.xxhash64(F.lit(turn), "h", "deal"), F.col("blocks")).cast("int"))
        flown = dealt.drop("_source", "blocks").groupBy("source", "block").applyInPandas(_fly(last), dealt.drop("_source", "blocks").schema)
        state = stored(flown.drop("block").select(*state.columns), "flight")
        if last:
            break
        turn += 1
    decided.append(state)
    rows = decided[0]
    for more in decided[1:]:
        rows = rows.unionByName(more)
    copies = (F.col("whole") + F.round("chance")).cast("int")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), *carry)
