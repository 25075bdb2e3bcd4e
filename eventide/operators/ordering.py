"""Orders of whole relations without a task that sorts them all: range partitions, and what passes from one to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import settled


def numbered(rows: DataFrame, existing: DataFrame | int, by: str) -> DataFrame:
    """``rows`` with dense ``id`` after the largest existing one (or after a number), in order of ``by``.

    Ranks come from range partitions and their sizes, so no task sorts all rows.  The partitions are kept before
    they are counted: read twice, their bounds and numbers could differ.
    """
    ordered = settled(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    ordered = ordered.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(by)))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).select("_part", "_before")
    top = rows.sparkSession.range(1).select(F.lit(existing).alias("_top")) if isinstance(existing, int) else existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return ordered.join(F.broadcast(before), "_part").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_before") + F.col("_n")).drop("_part", "_n", "_before", "_top")


def running_sum(rows: DataFrame, value: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row: within range partitions, plus the sums of those before."""
    ordered = settled(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ordered = ordered.withColumn("_own", F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = ordered.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).select("_part", "_before")
    return ordered.join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def carried(rows: DataFrame, group: str, by: str, value: str) -> DataFrame:
    """``rows`` with nulls of ``value`` replaced by the last value before them in their group.

    A group of any size is spread over range partitions; only the last value of each passes to the next.
    """
    parts = settled(rows.repartitionByRange(group, by).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", group).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.groupBy("_part", group).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(by))).alias("_last"))
    before = ends.withColumn("_before", F.last("_last", True).over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    filled = parts.withColumn("_own", F.last(value, True).over(inside)).join(before.drop("_last"), ["_part", group])
    return filled.withColumn(value, F.coalesce("_own", "_before")).drop("_part", "_own", "_before")


def ranked_within(rows: DataFrame, group: list[str], by: str, name: str) -> DataFrame:
    """``rows`` with their place in their group, from 0, in order of ``by``; a group of any size is spread over range partitions."""
    ordered = settled(rows.repartitionByRange(*group, by).withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy("_part", *group).agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ordered.withColumn("_n", F.row_number().over(Window.partitionBy("_part", *group).orderBy(by)) - 1)
    return placed.join(before.drop("_size"), ["_part", *group]).withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")
