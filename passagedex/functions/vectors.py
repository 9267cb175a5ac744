"""Vector arithmetic on array columns, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, the value a flat L2 index reports."""

    def squared(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.aggregate(F.zip_with(a, b, squared), F.lit(0.0), lambda total, x: total + x)
