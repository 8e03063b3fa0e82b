"""Joins by order and by range of keys, without a product of the two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, marks: DataFrame, key: str, mark: str, band: int) -> DataFrame:
    """``rows`` (integer column ``key``) with the largest ``mark`` at or before it; rows without one are left
    out. Both sides are dealt out by bands of ``band`` keys and go through their band in order; what comes
    from earlier bands is each band's largest mark, carried on over one row a band."""
    both = rows.select("*", F.col(key).cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__m"))
    both = both.unionByName(marks.select(F.col(mark).cast("long").alias("__at"), F.lit(0).alias("__kind"), F.col(mark).cast("long").alias("__m")), allowMissingColumns=True)
    both = both.withColumn("__band", F.floor(F.col("__at") / band))
    tops = both.groupBy("__band").agg(F.max("__m").alias("__top"))  # a row a band
    tops = tops.select("__band", F.max("__top").over(Window.orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = F.max("__m").over(Window.partitionBy("__band").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__in", inside).where("__kind = 1").join(tops, "__band")
    return out.withColumn(mark, F.coalesce("__in", "__before")).where(F.col(mark).isNotNull()).select(*rows.columns, mark)
