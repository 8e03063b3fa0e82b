"""Differences between two tables as multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with side (left or right) and how often:
    one aggregation over both, rather than two set differences."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).cast("long").alias("__n")).unionByName(b.select(*columns, F.lit(-1).cast("long").alias("__n")))
    sums = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return sums.select(F.when(F.col("__n") > 0, "left").otherwise("right").alias("side"), *columns, F.abs("__n").alias("times"))
