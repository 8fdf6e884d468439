"""Ranks and running sums over a whole table in an order, by range partitions and prefix sums.

The rows are cut into ranges of the order; each range numbers and adds up its own, and takes
what all ranges before it have. No task sees more than its range and one row for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.operators.stored import stored


def with_running(df: DataFrame, order: list[Column], sums: dict[str, str], rank: str | None = None) -> DataFrame:
    """df with, for each (new column: column), the sum of the column over all rows before; and the rank from 1.

    The order should tell all rows apart, or those it doesn't are placed in any order. Nulls add nothing.
    """
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    ranged = stored(ranged.withColumn("_part", F.shiftright("_at", 33)), "ranges")
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{k}") for k, c in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    whole = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c)
    parts = parts.select("_part", whole("_n"), *(whole(f"_sum_{k}") for k in sums))
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    met = ranged.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_own_{k}") for k, c in sums.items())).join(parts, "_part")
    place = [(F.col("_n") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias(rank)] if rank else []
    return met.select(*df.columns, *((F.col(f"_sum_{k}") + F.col(f"_own_{k}")).alias(k) for k in sums), *place)
