"""A local name inside a column expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    Inside lambdas Spark does not share repeated sub-expressions; a one-item array does.
    """
    return F.get(F.transform(F.array(value), body), 0)
