"""Array expressions on logits and probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .fixed import PROB_FLOOR
from .scalar import let


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def tempered(logits: Column, temperature: float = 1.0) -> Column:
    """Logits divided by the temperature."""
    return logits if temperature == 1.0 else F.transform(logits, lambda z: z / F.lit(float(temperature)))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """exp((z - max z) / T), normalised. The maximum, the powers and the sum are each evaluated once."""
    t = F.lit(float(temperature))
    return let(
        F.array_max(logits),
        lambda top: let(
            F.transform(logits, lambda z: F.exp((z - top) / t)),
            lambda e: let(array_sum(e), lambda s: F.transform(e, lambda x: x / s)),
        ),
    )


def sigmoid_probs(logits: Column, temperature: float = 1.0) -> Column:
    t = F.lit(float(temperature))
    return F.transform(logits, lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z / t)))


def log_sum_exp(logits: Column, beta: Column) -> Column:
    """log(sum(exp(beta * z))), shifted by the maximum."""
    return let(
        F.array_max(logits) * beta,
        lambda top: top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z * beta - top))),
    )


def _clip(p: Column, hi: float) -> Column:
    return F.least(F.greatest(p, F.lit(PROB_FLOOR)), F.lit(hi))


def categorical_entropy(probs: Column) -> Column:
    return -F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + _clip(p, 1.0) * F.log(_clip(p, 1.0)))


def binary_entropy_mean(probs: Column) -> Column:
    """Mean Bernoulli entropy over the classes."""
    hi = 1.0 - PROB_FLOOR

    def one(p: Column) -> Column:
        q = _clip(p, hi)
        return -(q * F.log(q) + (1.0 - q) * F.log(1.0 - q))

    return F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + one(p)) / F.size(probs)


def argmax_label(probs: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def max_prob(probs: Column) -> Column:
    return F.array_max(probs)


def multilabel_predict(probs: Column, thresholds: Sequence[float] | float = 0.5) -> Column:
    """Zero-based indices whose probability reaches the (per-class) threshold."""
    if isinstance(thresholds, (int, float)):
        limit = lambda i: F.lit(float(thresholds))
    else:
        limits = F.array(*[F.lit(float(t)) for t in thresholds])
        limit = lambda i: F.try_element_at(limits, i + 1)
    marked = F.transform(probs, lambda p, i: F.when(p >= limit(i), i))
    return F.filter(marked, lambda i: i.isNotNull())


def multilabel_confidence(probs: Column, predicted: Column) -> Column:
    """Largest probability among the predicted classes; 1 - max probability if none is predicted."""
    best = F.array_max(F.transform(predicted, lambda i: F.element_at(probs, i + 1)))
    return F.when(F.size(predicted) > 0, best).otherwise(1.0 - F.array_max(probs))


def squared_error(probs: Column, gold: Column) -> Column:
    """Mean over classes of (p_c - [c = gold])^2 without building the one-hot vector.

    sum (p - y)^2 = sum p^2 - 2 p_gold + 1; a gold class outside the vector contributes only sum p^2.
    """
    squares = F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + p * p)
    hit = F.when(gold >= 0, F.try_element_at(probs, gold.cast("int") + 1))
    return (squares + F.coalesce(F.lit(1.0) - 2.0 * hit, F.lit(0.0))) / F.size(probs)
