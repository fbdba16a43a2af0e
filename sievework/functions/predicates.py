"""Boolean algebra over columns, with SQL's three values kept, and tests on related rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*tests: Column) -> Column:
    """True if every test is; true without tests."""
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(*tests: Column) -> Column:
    """True if some test is; false without tests."""
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def related(test: Column) -> Column:
    """A test on a to-one relation: where it is unknown there is no such related row, so it is false."""
    return F.coalesce(test, F.lit(False))


def exists_child(children: DataFrame, key: str, parent_key: str, test: Column) -> Column:
    """A condition, for use anywhere in a filter, that some child row of the parent passes the test.

    Catalyst plans it as a semi-join, an anti-join or an existence join, as the filter around it asks.
    """
    return children.where(test & (F.col(key) == F.col(parent_key).outer())).exists()


def in_range(col: Column, low=None, high=None) -> Column:
    """Inclusive bounds, each optional."""
    tests = ([col >= low] if low is not None else []) + ([col <= high] if high is not None else [])
    return all_of(*tests)
