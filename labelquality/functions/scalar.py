"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .fixed import WHITESPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stage(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns, given as SQL expressions, that are computed once per row whatever is built on them.

    The columns come out of ``inline`` over a one-element array. The optimizer does not substitute such
    columns into the filters and projections above, which with plain aliases would repeat (and over
    several stages multiply) the expressions. Still a narrow step without a shuffle.
    """
    fields = ", ".join(f"'{name}', {sql}" for name, sql in columns.items())
    return df.select("*", F.expr(f"inline(array(named_struct({fields})))"))


def sql_text(value: str) -> str:
    """A string as SQL literal."""
    plain = all(" " <= c <= "~" and c not in "'\\" for c in value)
    return f"'{value}'" if plain else "'" + "".join(f"\\u{ord(c):04x}" for c in value) + "'"


def sql_strip(sql: str) -> str:
    """``strip`` as SQL."""
    return f"btrim({sql}, {sql_text(WHITESPACE)})"


def sql_lookup(mapping: Mapping, key: str, default: str = "NULL") -> str:
    """``lookup`` as SQL, for string dictionaries."""
    cases = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in mapping.items())
    return f"CASE {key} {cases} ELSE {default} END"


def lookup(mapping: Mapping, key: Column) -> Column:
    """Literal dictionary lookup as a CASE expression (stays inside generated code); NULL if absent."""
    pairs = list(mapping.items())
    out = F.when(key == F.lit(pairs[0][0]), F.lit(pairs[0][1]))
    for k, v in pairs[1:]:
        out = out.when(key == F.lit(k), F.lit(v))
    return out


def strip(c: Column) -> Column:
    """Strip every kind of white space, not only blanks, at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def upper_bound_index(value: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending literal ``bounds`` are strictly below ``value``.

    A balanced tree of comparisons: log2(n) tests per row and no lambda, so it compiles.
    """

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > F.lit(float(bounds[mid])), node(mid + 1, hi)).otherwise(node(lo, mid))

    return F.when(value.isNotNull(), node(0, len(bounds)))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 where the denominator is zero or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
