"""The result convention: a value, or NULL with a reason. Unavailable is never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTIFIED, UNAVAILABLE = "quantified", "unavailable"


def columns(value: Column, *reasons: tuple[str, Column]) -> list[Column]:
    """value, status, unavailable_reason. reasons: (name, when it holds), the first that holds wins."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(reasons):
        reason = F.when(holds, F.lit(name)).otherwise(reason)
    return [F.when(reason.isNull(), value).alias("value"), F.when(reason.isNull(), QUANTIFIED).otherwise(UNAVAILABLE).alias("status"), reason.alias("unavailable_reason")]


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
