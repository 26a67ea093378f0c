"""Grading of observed values and the error taxonomy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT = "decimal(38,10)"

EXPECTATION_TYPES = ("zero_violations", "min_threshold", "max_threshold", "equals")


def exact_number(value: Column, kind: T.DataType) -> Column:
    """The value as an exact decimal; NULL where it is not a usable number.

    A double goes through its printed form, so that 0.1 equals the decimal 0.1.
    Booleans are not numbers here.
    """
    if isinstance(kind, T.BooleanType) or not isinstance(kind, T.NumericType):
        return F.lit(None).cast(EXACT)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value.cast("string").try_cast(EXACT)
    return value.cast(EXACT)


def passes(observed: Column, kind: Column, limit: Column) -> Column:
    return (
        F.when(kind == "zero_violations", observed == 0)
        .when(kind == "min_threshold", observed >= limit)
        .when(kind == "max_threshold", observed <= limit)
        .when(kind == "equals", observed == limit)
    )


def grade(observed: Column, kind: Column, limit: Column) -> Column:
    """PASS or FAIL for a known value, ERROR where the value or the verdict is unknown."""
    verdict = passes(observed, kind, limit)
    return F.when(verdict, "PASS").when(~verdict, "FAIL").otherwise("ERROR")


def error_type(observed: Column, kind: Column, limit: Column) -> Column:
    return F.when(passes(observed, kind, limit).isNull(), "SQL_RESULT_TYPE_ERROR")
