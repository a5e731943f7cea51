"""Exact order statistics of groups of any size, from counts of values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Tables


def value_at(rows: DataFrame, value: str, by: Sequence[str], index: Callable[[Column], Column], out: str = "value") -> DataFrame:
    """Rows (by, out): the value at place `index(n)` (from 0) of each group's n values in ascending order; nulls don't count.

    Equal values are counted first, before anything is sorted, so a common value is one row. The counts go to sampled
    ranges; a sum for each range and group tells which range holds the place, and only that
    range's counts are added up one by one. No task holds a group, and a group's hot value costs nothing extra.
    """
    tables = Tables()
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    ranged = tables.stored(counts.repartitionByRange(*names, "__v").withColumn("__part", F.spark_partition_id()), "value-counts")
    # A row for each range and the groups in it, which follow each other.
    whole = Window.partitionBy(*names)
    sums = ranged.groupBy(*names, "__part").agg(F.sum("__c").alias("__s"))
    sums = sums.withColumns({"__n": F.sum("__s").over(whole), "__upto": F.sum("__s").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))})
    place = index(F.col("__n"))
    holder = sums.filter((place >= F.col("__upto") - F.col("__s")) & (place < F.col("__upto"))).select(*names, "__part", (place - F.col("__upto") + F.col("__s")).alias("__left"))
    inside = ranged.join(tables.stored(holder, "value-ranges"), [*names, "__part"])
    reached = F.sum("__c").over(whole.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("__r", reached).filter((F.col("__r") > F.col("__left")) & (F.col("__r") - F.col("__c") <= F.col("__left")))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, by)], F.col("__v").alias(out))


def upper_median(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rows (by, median): the value at index n // 2 of each group's sorted values."""
    return value_at(rows, value, by, lambda n: F.floor(n / 2), "median")
