"""Calibration: reliability bins, ECE and relatives, Brier scores, temperature fitting.

Bins are left-open and right-closed. A probability of exactly 0 falls in no bin but still counts in the
denominator. One aggregation of raw rows yields at most bins + 1 rows; all measures derive from it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, probability as pr
from ..functions.scalar import ratio, upper_bound_index


def bin_edges(bins: int) -> list[float]:
    return np.linspace(0.0, 1.0, bins + 1).tolist()


def bin_index(p: Column, bins: int) -> Column:
    """1..bins; 0 for a probability that lies in no bin."""
    edges = bin_edges(bins)
    inside = (p > edges[0]) & (p <= edges[-1])
    return F.when(inside, upper_bound_index(p, edges)).otherwise(F.lit(0))


def bin_counts(df: DataFrame, prob: Column, outcome: Column, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Per bin (0 = outside): rows, sum of probability, sum of outcomes."""
    return (
        df.select(*by, prob.alias("p"), outcome.cast("double").alias("y"))
        .groupBy(*by, bin_index(F.col("p"), bins).alias("bin"))
        .agg(F.count("*").alias("n"), F.sum("p").alias("sum_p"), F.sum("y").alias("sum_y"))
    )


def reliability_bins(df: DataFrame, prob: Column, outcome: Column, bins: int = fixed.CALIBRATION_BINS) -> DataFrame:
    """One row per bin: count, mean confidence, accuracy. An empty bin shows its midpoint and 0."""
    edges = F.array(*[F.lit(e) for e in bin_edges(bins)])
    zero = F.lit(0.0)
    grid = df.sparkSession.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("n"), zero.alias("sum_p"), zero.alias("sum_y")
    )
    lower, upper = F.element_at(edges, F.col("bin")), F.element_at(edges, F.col("bin") + 1)
    full = F.col("n") > 0
    return (
        bin_counts(df, prob, outcome, bins)
        .filter("bin > 0")
        .unionByName(grid)
        .groupBy("bin")
        .agg(F.sum("n").alias("n"), F.sum("sum_p").alias("sum_p"), F.sum("sum_y").alias("sum_y"))
        .select(
            "bin",
            lower.alias("lower"),
            upper.alias("upper"),
            "n",
            F.when(full, ratio(F.col("sum_p"), F.col("n"))).otherwise((lower + upper) / 2).alias("confidence"),
            ratio(F.col("sum_y"), F.col("n")).alias("accuracy"),
        )
    )


def calibration_summary(counts: DataFrame, by: Sequence[str] = (), more: dict[str, Column] | None = None) -> DataFrame:
    """ECE, MCE and the reliability and resolution terms, from ``bin_counts``; ``more`` are aggregates of the same pass."""
    total = F.sum("n")
    inside = F.col("bin") > 0
    gap = F.when(inside, F.abs(F.col("sum_p") - F.col("sum_y")))
    base = F.sum("sum_y") / total
    # sum w (acc - base)^2 = sum n acc^2 / N - 2 base sum n acc / N + base^2 sum n / N, over bins
    second = F.sum(F.when(inside, F.col("sum_y") * F.col("sum_y") / F.col("n"))) / total
    first = F.sum(F.when(inside, F.col("sum_y"))) / total
    share = F.sum(F.when(inside, F.col("n"))) / total
    return counts.groupBy(*by).agg(
        total.alias("n"),
        F.coalesce(F.sum(gap) / total, F.lit(0.0)).alias("ece"),
        F.coalesce(F.max(gap / F.col("n")), F.lit(0.0)).alias("mce"),
        F.coalesce(F.sum(gap * gap / F.col("n")) / total, F.lit(0.0)).alias("reliability"),
        F.coalesce(second - 2.0 * base * first + base * base * share, F.lit(0.0)).alias("resolution"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )


def ece(df: DataFrame, probs: str, gold: str, bins: int = fixed.CALIBRATION_BINS) -> DataFrame:
    """Multiclass ECE on the largest probability and whether its class is right."""
    right = pr.argmax_label(F.col(probs)) == F.col(gold)
    return calibration_summary(bin_counts(df, pr.max_prob(F.col(probs)), right, bins)).select("n", "ece")


def calibration_metrics(df: DataFrame, prob: str, outcome: str, bins: int = fixed.BINARY_BINS) -> DataFrame:
    """ECE, MCE, Brier, reliability and resolution of a binary score, in one pass."""
    p, y = F.col(prob), F.col(outcome).cast("double")
    counts = (
        df.select(p.alias("p"), y.alias("y"))
        .groupBy(bin_index(F.col("p"), bins).alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.sum("p").alias("sum_p"),
            F.sum("y").alias("sum_y"),
            F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sum_sq"),
        )
    )
    brier = F.sum("sum_sq") / F.sum("n")
    return calibration_summary(counts, more={"brier_score": brier})


def ece_binary(df: DataFrame, prob: str, outcome: str, bins: int = fixed.BINARY_BINS) -> DataFrame:
    return calibration_summary(bin_counts(df, F.col(prob), F.col(outcome), bins)).select("n", "ece")


def mce(df: DataFrame, prob: str, outcome: str, bins: int = fixed.BINARY_BINS) -> DataFrame:
    return calibration_summary(bin_counts(df, F.col(prob), F.col(outcome), bins)).select("n", "mce")


def reliability_resolution(df: DataFrame, prob: str, outcome: str, bins: int = fixed.BINARY_BINS) -> DataFrame:
    return calibration_summary(bin_counts(df, F.col(prob), F.col(outcome), bins)).select("n", "reliability", "resolution")


def _cells(df: DataFrame, probs: str, truth: str) -> DataFrame:
    """(label, p, y) per class of every row; folded back by the partial aggregation of the same stage."""
    return df.select(F.col(truth), F.posexplode(probs).alias("label", "p")).select(
        "label", "p", F.array_contains(F.col(truth), F.col("label")).cast("double").alias("y")
    )


def ece_multilabel(df: DataFrame, probs: str, truth: str, bins: int = fixed.CALIBRATION_BINS) -> DataFrame:
    """ECE per class, and a row labelled "macro" with their mean."""
    cells = _cells(df, probs, truth)
    per = calibration_summary(bin_counts(cells, F.col("p"), F.col("y"), bins, by=["label"]), by=["label"])
    macro = per.agg(F.lit("macro").alias("label"), F.avg("ece").alias("ece"))
    return per.select(F.col("label").cast("string").alias("label"), "ece").unionByName(macro)


def brier(df: DataFrame, probs: str, gold: str) -> DataFrame:
    """Mean squared error over rows and classes."""
    return df.agg(
        F.count("*").alias("n"), F.avg(pr.squared_error(F.col(probs), F.col(gold))).alias("brier_score")
    )


def brier_binary(df: DataFrame, prob: str, outcome: str) -> DataFrame:
    gap = F.col(prob) - F.col(outcome).cast("double")
    return df.agg(F.count("*").alias("n"), F.avg(gap * gap).alias("brier_score"))


def brier_multilabel(df: DataFrame, probs: str, truth: str) -> DataFrame:
    gap = F.col("p") - F.col("y")
    per = _cells(df, probs, truth).groupBy("label").agg(F.avg(gap * gap).alias("brier_score"))
    macro = per.agg(F.lit("macro").alias("label"), F.avg("brier_score").alias("brier_score"))
    return per.select(F.col("label").cast("string").alias("label"), "brier_score").unionByName(macro)


def nll(logits: Column, gold: Column, beta: Column) -> Column:
    """Cross-entropy of one row at inverse temperature ``beta``."""
    return pr.log_sum_exp(logits, beta) - beta * F.element_at(logits, gold.cast("int") + 1)


def bce(logits: Column, truth: Column, beta: Column) -> Column:
    """Mean binary cross-entropy of one row's classes; ``truth`` is the array of true classes."""
    cell = F.transform(
        logits,
        lambda z, c: F.greatest(z * beta, F.lit(0.0))
        + F.log1p(F.exp(-F.abs(z * beta)))
        - F.when(F.array_contains(truth, c), z * beta).otherwise(0.0),
    )
    return pr.array_sum(cell) / F.size(logits)


def temperature_grid(df: DataFrame, logits: str, gold: str, grid: Sequence[float]) -> DataFrame:
    """Mean loss at each grid temperature: one pass, one average per grid point."""
    losses = [
        F.struct(F.lit(float(t)).alias("temperature"), F.avg(nll(F.col(logits), F.col(gold), F.lit(1.0 / t))).alias("nll"))
        for t in grid
    ]
    return df.agg(F.array(*losses).alias("points")).select(F.inline("points"))


def best_of_grid(points: DataFrame) -> DataFrame:
    return points.agg(F.min_by("temperature", F.struct("nll", "temperature")).alias("temperature"), F.min("nll").alias("nll"))


def _slope_and_curve(logits: Column, gold: Column, beta: Column) -> tuple[Column, Column]:
    """First and second derivative of ``nll`` in beta: E[z] - z_gold and Var[z] under softmax(beta z)."""
    probs = pr.softmax(F.transform(logits, lambda z: z * beta))
    pairs = F.zip_with(probs, logits, lambda p, z: F.struct(p.alias("p"), z.alias("z")))
    first = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["p"] * x["z"])
    second = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["p"] * x["z"] * x["z"])
    return first - F.element_at(logits, gold.cast("int") + 1), second - first * first


def _slope_and_curve_multilabel(logits: Column, truth: Column, beta: Column) -> tuple[Column, Column]:
    rows = F.transform(
        logits,
        lambda z, c: F.struct(
            z.alias("z"),
            (F.lit(1.0) / (F.lit(1.0) + F.exp(-z * beta))).alias("s"),
            F.array_contains(truth, c).cast("double").alias("y"),
        ),
    )
    slope = F.aggregate(rows, F.lit(0.0), lambda a, x: a + (x["s"] - x["y"]) * x["z"])
    curve = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["s"] * (1.0 - x["s"]) * x["z"] * x["z"])
    return slope / F.size(logits), curve / F.size(logits)


def fit_temperature(
    df: DataFrame,
    logits: str,
    gold: str,
    multilabel: bool = False,
    max_iter: int = 50,
    tolerance: float = 1e-9,
    bounds: tuple[float, float] = (1e-3, 1e3),
) -> float:
    """Temperature that minimises the mean loss.

    The loss is convex in beta = 1/T, so a safeguarded Newton iteration on its slope finds the minimum.
    Each step is one aggregate that returns two numbers; the two input columns are kept between steps
    and recomputed if an executor is lost. A loss without a minimum inside ``bounds`` gives the bound. ``gold`` is a class index, or the array of true classes.
    """
    derive = _slope_and_curve_multilabel if multilabel else _slope_and_curve
    data = df.select(F.col(logits).alias("z"), F.col(gold).alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lo, hi = 1.0 / bounds[1], 1.0 / bounds[0]

        def means(*betas: float) -> list[float]:
            wanted = [F.avg(c) for b in betas for c in derive(F.col("z"), F.col("y"), F.lit(b))]
            return list(data.agg(*wanted).first())

        low, _, high, _ = means(lo, hi)
        if low is None:
            raise ValueError("fit_temperature needs at least one row")
        if low >= 0 or high <= 0:  # the loss only rises or only falls between the bounds
            return bounds[1] if low >= 0 else bounds[0]
        beta = 1.0
        for _ in range(max_iter):
            g, h = means(beta)
            lo, hi = (lo, beta) if g > 0 else (beta, hi)
            step = beta - g / h if h and h > 0 else None
            # A Newton step that leaves the bracket is replaced by the bracket's geometric middle.
            nxt = step if step is not None and lo < step < hi else (lo * hi) ** 0.5
            if abs(nxt - beta) <= tolerance * beta:
                beta = nxt
                break
            beta = nxt
        return 1.0 / beta
    finally:
        data.unpersist()
