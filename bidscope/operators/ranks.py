"""Places in the order of a whole table, without one task that holds it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.workspace import materialize


def with_place(df: DataFrame, order: list[Column], name: str = "place", *, rows_each: int = 50_000) -> DataFrame:
    """Add each row's number, from 1, in an order without ties: rows are dealt out by range and numbered there, and the sizes
    of the ranges before are added (a row for each range)."""
    df = materialize(df, "rank-rows")
    parts = max(1, math.ceil(df.count() / rows_each))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "rank-ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__own", own).join(materialize(sizes, "rank-sizes"), "__range").withColumn(name, (F.col("__own") + F.col("__before")).cast("int")).drop("__own", "__before", "__range")


def with_rank(df: DataFrame, value: str, name: str = "place", *, descending: bool = True, rows_each: int = 50_000) -> DataFrame:
    """Add 1 + how many rows have a better value; equal values share a rank.  Distinct values are counted before they are ordered."""
    df = materialize(df, "rank-rows")
    values = df.groupBy(value).agg(F.count(F.lit(1)).alias("__rows"))
    values = materialize(values, "rank-values")
    parts = max(1, math.ceil(values.count() / rows_each))
    order = F.col(value).desc() if descending else F.col(value).asc()
    dealt = materialize(values.repartitionByRange(parts, order).withColumn("__range", F.spark_partition_id()), "rank-ranges")
    up_to = Window.unboundedPreceding
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(up_to, -1)  # a row for each range
    sizes = dealt.groupBy("__range").agg(F.sum("__rows").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum("__rows").over(Window.partitionBy("__range").orderBy(order).rowsBetween(up_to, -1)), F.lit(0))
    placed = dealt.withColumn("__own", own).join(sizes, "__range").select(value, (1 + F.col("__own") + F.col("__before")).cast("int").alias(name))
    return df.join(materialize(placed, "rank-places"), value)
