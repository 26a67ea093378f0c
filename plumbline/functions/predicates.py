"""Predicates that select *violating* rows.

A comparison with NULL is unknown, so a NULL never violates (except where NULL itself is the
violation). Keeping predicates as ``Column`` lets the count and the row preview share them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(column: ColumnOrName) -> Column:
    return F.col(column) if isinstance(column, str) else column


def null_check(column: ColumnOrName) -> Column:
    return _col(column).isNull()


def not_null_required(column: ColumnOrName) -> Column:
    return _col(column).isNull()


def min_value(column: ColumnOrName, minimum) -> Column:
    return _col(column) < F.lit(minimum)


def max_value(column: ColumnOrName, maximum) -> Column:
    return _col(column) > F.lit(maximum)


def range_check(column: ColumnOrName, low, high) -> Column:
    return min_value(column, low) | max_value(column, high)


def excluded_range(column: ColumnOrName, low, high) -> Column:
    return _col(column).between(F.lit(low), F.lit(high))


def expected_value(column: ColumnOrName, value) -> Column:
    return _col(column) != F.lit(value)


def forbidden_value(column: ColumnOrName, value) -> Column:
    return _col(column) == F.lit(value)


def threshold(column: ColumnOrName, op: str, value) -> Column:
    """``column op value`` violates, for op in < > <= >=."""
    left, right = _col(column), F.lit(value)
    if op == "<":
        return left < right
    if op == ">":
        return left > right
    if op == "<=":
        return left <= right
    if op == ">=":
        return left >= right
    raise ValueError(f"unsupported comparison: {op}")


def future_date(column: ColumnOrName, as_of=None) -> Column:
    """Later than *as_of*; pass a fixed date to make a run repeatable."""
    limit = F.current_date() if as_of is None else F.lit(as_of)
    return _col(column) > limit


def category_check(column: ColumnOrName, values) -> Column:
    return ~_col(column).isin(*values)


def blank_check(column: ColumnOrName) -> Column:
    return _col(column).isNull() | (F.trim(_col(column)) == "")
