"""Names for intermediate values inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it. Without it an optimiser that merges
    projections copies the value's whole tree to each mention, and deep formulas outgrow what a method may hold."""
    return F.element_at(F.transform(F.array(value), body), 1)
