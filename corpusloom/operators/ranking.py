"""Ordered folds: budgets, last rows, orders that depend on the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key; tasks keep n a key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


def last_rows(rows: DataFrame, key: str, order: str, n: int = 3) -> DataFrame:
    return first_rows(rows, [key], [F.desc(order)], n)


def within_budget(rows: DataFrame, key: str, order: str, size: Column, most_rows: int, budget: int, each: int) -> DataFrame:
    """Rows of each key up to the first overflow of the running sum of min(size, each), at most `most_rows` and at least one."""
    window = Window.partitionBy(key).orderBy(order)
    running = F.sum(F.least(size, F.lit(each))).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.withColumn("place", F.row_number().over(window)).withColumn("used", running.cast("long"))
    return marked.where((F.col("place") == 1) | ((F.col("place") <= most_rows) & (F.col("used") <= budget)))


def shared_budget(rows: DataFrame, key: str, order: str, length: str, budget: int = 8000, most: int = 2800, groups: int = 4) -> DataFrame:
    """Adds `granted`: the first `groups` rows of a key share the budget in order, at most `most` each; a row always shows something, so 0 stays 0."""
    window = Window.partitionBy(key).orderBy(order)
    want = F.least(F.col(length), F.lit(most))
    before = F.coalesce(F.sum(want).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(window)
    granted = F.when(F.col("_place") <= groups, F.greatest(F.lit(0), F.least(want, F.lit(budget) - F.col("_before")))).otherwise(0)
    return rows.withColumn("_place", place).withColumn("_before", before).withColumn("granted", granted.cast("long")).drop("_place", "_before")


def since_last(rows: DataFrame, key: str, order: str, marker: Column) -> DataFrame:
    """Rows after the last marked row of their key; all of them where no row is marked."""
    window = Window.partitionBy(key)
    last = F.max(F.when(marker, F.col(order))).over(window)
    return rows.withColumn("_last", last).where(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")


def trailing_run(rows: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """key, run: how many of the last rows in a row are failures."""
    marked = rows.select(key, F.col(order), failed.cast("int").alias("_failed"))
    last_good = F.max(F.when(F.col("_failed") == 0, F.col(order))).over(Window.partitionBy(key))
    late = marked.withColumn("_good", last_good)
    return late.groupBy(key).agg(F.count_if((F.col("_failed") == 1) & (F.col("_good").isNull() | (F.col(order) > F.col("_good")))).alias("run"))


def assigned_order(records: DataFrame, entry: str, title_order: str, stamp: str, position: str) -> DataFrame:
    """Adds `method` and `place`: by title ordinals if all rows of the entry have one, else by distinct time stamps, else as given."""
    window = Window.partitionBy(entry)
    n = F.count(F.lit(1)).over(window)
    by_title = F.count(title_order).over(window) == n
    by_time = (F.count(stamp).over(window) == n) & (F.size(F.collect_set(stamp).over(window)) == n)
    marked = records.withColumn("method", F.when(by_title, "title").when(by_time, "time").otherwise("input"))
    key = F.when(F.col("method") == "title", F.col(title_order).cast("double")).when(F.col("method") == "time", F.unix_micros(F.col(stamp).cast("timestamp")).cast("double"))
    return marked.withColumn("place", F.row_number().over(window.orderBy(F.coalesce(key, F.lit(0.0)), position)))
