"""Number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Round at a binary scale: the scaled value is rounded to a whole number and scaled back.

    A price level such as 79.41665 has no exact binary form. This rounds the product that the
    processor computes, as other engines do, and not the shortest decimal text of the value.
    """
    scale = float(10 ** digits)
    return F.round(value * scale, 0) / scale
