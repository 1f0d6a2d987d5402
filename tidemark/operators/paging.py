"""Pages of an ordered result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 100


def total_pages(rows: Column, size: int = PAGE) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / size))


def page(rows: DataFrame, order: list[Column], number: int, size: int = PAGE) -> DataFrame:
    """Page `number` from 1, or the last page if there are fewer. A top-k sort, not a numbering of all rows."""
    last = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(number, 1), last) - 1) * size).limit(size)
