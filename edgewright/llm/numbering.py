"""Places of rows within ordered groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def positions(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with pos (from 0, in the order of ``order``, nulls first) and n (rows) within each value of ``key``,
    which is never null.

    Rows are sorted by ranges over all tasks and written; a row's place in its part, and how many rows of its key the
    parts before hold (one row for each key and part), give its position. No window spans a group. Rows that tie in all
    of ``order`` are numbered as they come; an empty table stays empty.
    """
    placed = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_at", 33)), name)
    parts = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy(key)
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = cut(parts.select(key, "_part", "_first", before.alias("_before"), F.sum("_rows").over(group).alias("n")), f"{name}_parts")
    return placed.join(parts, [key, "_part"]).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "n")
