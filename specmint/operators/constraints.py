"""Constraints that carry meaning, checked as queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n): per rule the rows that break it (false or null), all in one pass."""
    counts = df.agg(*(F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n")) for name in rules))))
