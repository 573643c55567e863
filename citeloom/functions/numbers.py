"""Numbers that do not depend on the order of summation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimal places to which a computed double is compared: sums of the same rows in another order differ far behind them.
PLACES = 9


def steady(df: DataFrame, column: str) -> Column:
    """``column`` as it is ranked and compared: doubles to ``PLACES`` places, so that values equal on paper are ties."""
    return F.round(column, PLACES) if df.schema[column].dataType.simpleString() in ("double", "float") else F.col(column)
