"""Windows over a whole table in one order, spread over tasks.

The rows are range-sorted and written to the shared folder, so that each part of the order is one task's and stays so when an executor is
lost. A window then runs within each part, and what the other parts add is one row a part, which is broadcast: as many rows as tasks. The
order should tell rows apart; where it does not, places of equal rows are any. Rows that are equal in all of it stand in one part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir

HELPERS = ("_at", "_part", "_other", "_here", "_value")


def in_order(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Adds _part, the number of a row's part, and _at, which rises with the order within it."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint()
    at = F.monotonically_increasing_id()
    return placed.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33).cast("int"))


def _with_others(placed: DataFrame, total: Column, fold: Column) -> DataFrame:
    """Adds _other: a fold (a window over `_total` of the parts) of what each part gives."""
    edges = placed.groupBy("_part").agg(total.alias("_total")).select("_part", fold.alias("_other"))  # a row a task
    return placed.join(F.broadcast(edges), "_part")


def places(rows: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """Adds the place of each row in the order, from 1."""
    before = F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = _with_others(in_order(rows, order), F.count(F.lit(1)), before)
    within = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33) + 1
    return placed.withColumn(name, F.col("_other") + within).drop(*HELPERS)


def least_after(rows: DataFrame, order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """Adds the least value of all later rows; null for the last one, nulls do not count."""
    earlier_rows = (Window.unboundedPreceding, -1)
    placed = in_order(rows.withColumn("_value", value), order)
    placed = _with_others(placed, F.min("_value"), F.min("_total").over(Window.orderBy(F.desc("_part")).rowsBetween(*earlier_rows)))
    here = F.min("_value").over(Window.partitionBy("_part").orderBy(F.desc("_at")).rowsBetween(*earlier_rows))
    return placed.withColumn("_here", here).withColumn(name, F.least("_here", "_other")).drop(*HELPERS)
