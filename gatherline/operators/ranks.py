"""Places in a global order, found range by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import saved


def numbered(df: DataFrame, order: dict[str, Column], name: str) -> DataFrame:
    """df with a column (long, from 1) that tells each row's place by order (ascending, nulls first): rows are dealt out and sorted by ranges, then each range is moved by the rows of those before it, so no task sees all rows.

    Rows that are equal in order have some places or other, so order should tell rows apart."""
    keys = [f"_{k}" for k in order]
    ranged = df.withColumns({f"_{k}": c for k, c in order.items()}).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    placed = saved(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    here = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return placed.join(F.broadcast(before), "_part").withColumn(name, here + F.col("_before") + 1).drop("_at", "_part", "_before")
