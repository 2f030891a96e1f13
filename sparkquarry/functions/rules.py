"""Rule ladders as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def above(x: Column, *steps: tuple[float, object], default: object = None) -> Column:
    """The value of the first step whose threshold x exceeds."""
    out = None
    for threshold, value in steps:
        out = F.when(x > threshold, F.lit(value)) if out is None else out.when(x > threshold, F.lit(value))
    return out.otherwise(F.lit(default))


def at_least(x: Column, *steps: tuple[float, object], default: object = None) -> Column:
    """The value of the first step whose threshold x reaches."""
    out = None
    for threshold, value in steps:
        out = F.when(x >= threshold, F.lit(value)) if out is None else out.when(x >= threshold, F.lit(value))
    return out.otherwise(F.lit(default))


def first_of(*rules: tuple[Column, object], default: object = None) -> Column:
    """The value of the first rule that holds."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def contains_any(x: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def occurrences(x: Column, word: str) -> Column:
    """How often word occurs in x, without overlaps."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(word), F.lit("")))) / len(word)).cast("long")


def six(x: Column) -> Column:
    return F.round(x.cast("double"), 6)
