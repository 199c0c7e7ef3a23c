"""Where the dialect's semantics differ from Spark's defaults.

Everything here stays in generated JVM code; none of it is a Python function at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """Quotient of two numbers as a double; null if the divisor is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def int_divide(a: Column, b: Column) -> Column:
    """Quotient of two integers, cut off towards zero; null if the divisor is zero."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))


def like(value: Column, pattern: Column | str, negated: bool = False) -> Column:
    """Case-insensitive match of ``%`` and ``_``; no escape character, so a backslash is itself. Numbers match as text."""
    if isinstance(pattern, str):
        pattern = F.lit(pattern)
    # ILIKE always has an escape character: double it wherever it occurs
    pattern = F.replace(pattern.cast("string"), F.lit("\\"), F.lit("\\\\"))
    hit = F.ilike(value.cast("string"), pattern)
    return ~hit if negated else hit


def equals(a: Column, b: Column, comparable: bool = True) -> Column:
    """Equality; operands of types that never equal give false, and null where either is null."""
    if comparable:
        return a == b
    return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))


def not_equals(a: Column, b: Column, comparable: bool = True) -> Column:
    if comparable:
        return a != b
    return F.when(a.isNotNull() & b.isNotNull(), F.lit(True))


def between(value: Column, low: Column, high: Column, negated: bool = False) -> Column:
    inside = (value >= low) & (value <= high)
    return ~inside if negated else inside


def is_in(value: Column, options: list[tuple[Column, bool]], negated: bool = False) -> Column:
    """Membership among (option, comparable) pairs, unknown where only a null could have matched."""
    hit = reduce(lambda x, y: x | y, [equals(value, o, c) for o, c in options])
    return ~hit if negated else hit


def first_of_group(value: Column, *order: Column) -> Column:
    """Aggregate: the value, null or not, of a group's first row by ``order``."""
    return F.min_by(value, F.struct(*order))
