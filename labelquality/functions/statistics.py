"""Chi-square tail probability as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .scalar import let

_LN_SQRT_PI = 0.5 * math.log(math.pi)


def _ln_gamma_next(dof: Column) -> Column:
    """ln Gamma(dof/2 + 1) by the recurrence from Gamma(1) or Gamma(1/2)."""
    odd = (dof % 2) == 1
    steps = F.sequence(F.lit(1), F.when(odd, (dof + 1) / 2).otherwise(F.greatest(dof / 2, F.lit(1))).cast("int"))
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    start = F.when(odd, F.lit(_LN_SQRT_PI)).otherwise(F.lit(0.0))
    return F.aggregate(steps, start, lambda acc, j: acc + F.log(j - shift))


def chi2_ln_sf(stat: Column, dof: Column) -> Column:
    """ln P(X > stat) for a chi-square variable with ``dof`` degrees of freedom; 0 if either is not positive.

    With a = dof/2 and x = stat/2: below a + 1 from the series of the lower tail, where the upper tail is large;
    from there on from the continued fraction of the upper tail itself, in log space. The number of terms follows
    from dof alone, so the answer does not change its nature with the size of the statistic.
    """
    a, x = dof / F.lit(2.0), stat / F.lit(2.0)
    n = (F.lit(300) + 4 * dof).cast("int")
    scale = a * F.log(x) - x - _ln_gamma_next(dof)  # ln(x^a e^-x / Gamma(a + 1))

    def lower(scale: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            t = acc["t"] * x / (a + k)
            return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

        terms = F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda acc: acc["s"])
        return F.log1p(-F.least(F.exp(scale) * terms, F.lit(1.0)))

    def upper(scale: Column) -> Column:
        fraction = F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), x + 2 * n + 1 - a, lambda h, k: x + 2 * k - 1 - a - k * (k - a) / h)
        return scale + F.log(a) - F.log(fraction)

    tail = let(scale, lambda s: F.when(x < a + 1, lower(s)).otherwise(upper(s)))
    return F.when((stat <= 0) | (dof <= 0), F.lit(0.0)).otherwise(tail)


def chi2_sf(stat: Column, dof: Column) -> Column:
    """P(X > stat); 0.0 where it is below the smallest double, see ``chi2_ln_sf`` for such cases."""
    return F.exp(chi2_ln_sf(stat, dof))
