"""Places and running sums in a global order, without a window over all rows.

Rows are dealt in ranges of the order; each range is numbered or summed by itself, and what stands before it is added from a
table of one row a range. Tables of at most FEW rows take one window. Either way the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tropelens.operators.repositories import settled

FEW = 200_000


def in_ranges(rows: DataFrame, by: list[str], order: list[str | Column], few: int = FEW) -> DataFrame:
    """rows, computed once, with `__piece`: a number that grows with (by, order). Rows equal in both are in one piece."""
    rows = settled(rows)
    if rows.count() <= few:
        return rows.withColumn("__piece", F.lit(0))
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(rows.repartitionByRange(pieces, *by, *order).withColumn("__piece", F.spark_partition_id()))


def with_pieces(rows: DataFrame, by: list[str], value: Column, fold, before: bool) -> DataFrame:
    """rows with `__other`: value folded over the pieces before (or after) a row's own, of its group."""
    sums = rows.groupBy(*by, "__piece").agg(value.alias("__t"))
    span = (Window.unboundedPreceding, -1) if before else (1, Window.unboundedFollowing)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__piece").rowsBetween(*span)  # a row a piece
    keys = [*by, "__piece"]
    sums = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), fold(F.col("__t")).over(w).alias("__other"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return rows.join(sums if by else F.broadcast(sums), on).drop(*(f"__k{i}" for i in range(len(keys))))


def running_sum(rows: DataFrame, by: list[str], order: list[str | Column], value: str, name: str, few: int = FEW) -> DataFrame:
    """rows with `name`: the sum of value over the group's rows that come before in the order, which has to tell all apart."""
    rows = in_ranges(rows, by, order, few)
    w = Window.partitionBy(*by, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = with_pieces(rows.withColumn("__in", F.coalesce(F.sum(value).over(w), F.lit(0))), by, F.sum(value), F.sum, True)
    return rows.withColumn(name, F.col("__in") + F.coalesce("__other", F.lit(0))).drop("__in", "__other", "__piece")


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str, few: int = FEW) -> DataFrame:
    """rows with their place from 1 in their group, by an order that tells all apart."""
    rows = in_ranges(rows, by, order, few)
    w = Window.partitionBy(*by, "__piece").orderBy(*order)
    rows = with_pieces(rows.withColumn("__in", F.row_number().over(w)), by, F.count(F.lit(1)), F.sum, True)
    return rows.withColumn(name, F.col("__in") + F.coalesce("__other", F.lit(0))).drop("__in", "__other", "__piece")


def least_from(rows: DataFrame, by: list[str], order: list[str | Column], value: Column, name: str, few: int = FEW) -> DataFrame:
    """rows with the least value of their own and all later rows of their group."""
    rows = in_ranges(rows.withColumn("__v", value), by, order, few)
    w = Window.partitionBy(*by, "__piece").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    rows = with_pieces(rows.withColumn("__in", F.min("__v").over(w)), by, F.min("__v"), F.min, False)
    return rows.withColumn(name, F.least("__in", "__other")).drop("__in", "__other", "__piece", "__v")
