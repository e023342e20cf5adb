"""Ranks and running sums over a whole table without one task that gets it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specmint.storage import materialize

_PLACES = 33


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add `name`, the 0-based place of each row in a total order.

    Range partitions are ordered by their id, so a row's rank is its place in its
    partition plus the sizes of the partitions before; only those sizes pass the driver.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id counts up from 2^33 times the partition's id.
    parts = materialize(parts.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    sizes = sorted(parts.groupBy(F.shiftright("_place", _PLACES).alias("p")).count().collect())
    before, sums = 0, []
    for p, n in sizes:
        sums += [F.lit(p), F.lit(before)]
        before += n
    base = F.element_at(F.create_map(*sums), F.shiftright("_place", _PLACES)) if sums else F.lit(0)
    return parts.withColumn(name, (base + F.col("_place").bitwiseAND(F.lit((1 << _PLACES) - 1))).cast("long")).drop("_place")


def cumulative(counts: DataFrame, value: str, n: str = "n", descending: bool = False) -> DataFrame:
    """Add `upto` (the sum of `n` up to and including each distinct value, in order) and `all` (the whole sum).

    Values are range-partitioned and summed inside their partitions; the partitions' own sums,
    one row each, are ordered in one place and come back by a broadcast.
    """
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_first(value)
    parts = materialize(counts.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "cumulative")
    totals = parts.groupBy("_part").agg(F.sum(n).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(whole).alias("all"))
    inside = F.sum(n).over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn("upto", inside).join(F.broadcast(totals), "_part").withColumn("upto", F.col("upto") + F.col("_before")).drop("_part", "_before")
