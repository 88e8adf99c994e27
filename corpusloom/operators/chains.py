"""Greedy folds as chains of successors: sections that fill up, calls that are let in.

A fold that starts anew at some rows (a section is full, a window has passed) is a chain: from each such row the next one follows by a
search, whatever came before. So every row gets its successor; the rows at which the fold really starts are those that a key's first row
reaches. Rows lie in one order by key and place over all tasks, also within a key:

1. Running sums: within each task's rows by a window, and over the tasks before by one small row a task and key.
2. Successors: rows and targets sorted together by value, over as many tasks; a target's successor is the row that stands after it.
3. A task follows its own successors until they leave its rows. What is left has one step a task.
4. Pointer doubling over these steps marks where the chains enter a task, in as many rounds as the logarithm of the tasks.
5. A task walks on from where a chain enters it.

No key is one task's work, and a key of a third of all rows takes no more rounds. What a round needs is written to the shared checkpoint
folder. Rows of equal key and place are put in some order, which then stays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir


def _part(g: str = "g") -> Column:
    """The task of a numbered row."""
    return F.shiftright(g, 33)


def _spread(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows sorted over all tasks, with g, which numbers them in this order and tells the task in its upper bits."""
    ensure_checkpoint_dir(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint().withColumn("g", F.monotonically_increasing_id())


def running_sum(rows: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """Adds the sum of n over the rows of the key up to this one, in the order of g."""
    marked = rows.withColumn("_part", _part())
    within = F.sum(n).over(Window.partitionBy("_part", key).orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1))
    totals = marked.groupBy(F.col("_part").alias("_in"), F.col(key).alias("_key")).agg(F.sum(n).alias("_n"))
    offsets = totals.select("_in", "_key", F.coalesce(before, F.lit(0)).alias("_before")).checkpoint()
    summed = marked.withColumn("_within", within)
    joined = summed.join(offsets, (F.col("_part") == F.col("_in")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.col("_within") + F.col("_before")).select(*rows.columns, name)


def successors(rows: DataFrame, key: str, value: str, target: Column) -> DataFrame:
    """g, next: the first row of the key that stands after the target (struct of value, tie, g), null where there is none; rows
    stand by (value, 0, g)."""
    own = F.struct(F.col(value).alias("value"), F.lit(0).alias("tie"), F.col("g").alias("g"))
    both = rows.select(F.col(key).alias("key"), F.explode(F.array(F.struct(own.alias("at"), F.col("g").alias("row"), F.lit(None).cast("long").alias("of")), F.struct(target.alias("at"), F.lit(None).cast("long").alias("row"), F.col("g").alias("of")))).alias("e"))
    asked = F.col("of").isNotNull()
    placed = _spread(both.select("key", "e.*"), F.col("key"), F.col("at"), asked).withColumn("part", _part())
    back = Window.partitionBy("part", "key").orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = placed.withColumn("next", F.last("row", ignorenulls=True).over(back)).where(asked)
    edges = placed.groupBy(F.col("part").alias("in"), F.col("key").alias("k")).agg(F.min_by("row", F.when(F.col("row").isNotNull(), F.col("g"))).alias("row"))
    later = Window.partitionBy("k").orderBy(F.desc("in")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("in", "k", F.last("row", ignorenulls=True).over(later).alias("far")).checkpoint()
    joined = near.join(edges, (F.col("part") == F.col("in")) & F.col("key").eqNullSafe(F.col("k")))
    return joined.select(F.col("of").alias("g"), F.coalesce("next", "far").alias("next"))


def _exits(rows: pa.Table) -> pa.Table:
    """g, exit: where the chain from each row of a task leaves the task."""
    rows = rows.sort_by("g")
    g, near = rows["g"].to_numpy(), rows["next"].fill_null(-1).to_numpy()
    at = np.searchsorted(g, near)
    inside = (near >= 0) & (at < len(g)) & (g[np.minimum(at, len(g) - 1)] == near)
    out = near.copy()
    for i in range(len(g) - 1, -1, -1):  # a successor stands after its row
        if inside[i]:
            out[i] = out[at[i]]
    return pa.table({"g": g, "exit": pa.array(out, mask=out < 0)})


def _walked(rows: pa.Table, entries: pa.Table) -> pa.Table:
    """g of the rows that the chains entering a task reach in it."""
    rows = rows.sort_by("g")
    g, near = rows["g"].to_numpy(), rows["next"].fill_null(-1).to_numpy()
    at = np.searchsorted(g, near)
    inside = (near >= 0) & (at < len(g)) & (g[np.minimum(at, len(g) - 1)] == near)
    reached = np.zeros(len(g), bool)
    for i in np.searchsorted(g, entries["entry"].to_numpy()):
        while not reached[i]:
            reached[i] = True
            if not inside[i]:
                break
            i = at[i]
    return pa.table({"g": g[reached]})


def reached(rows: DataFrame, key: str, steps: DataFrame) -> DataFrame:
    """g of the rows on the chains that begin at the first row of each key."""
    steps = steps.checkpoint()
    exits = steps.groupBy(_part()).applyInArrow(_exits, "g long, exit long").checkpoint()
    marks = rows.groupBy(key).agg(F.min("g").alias("entry")).select("entry").checkpoint()
    where = exits.where("exit is not null")
    jump = where.join(where.select(F.col("exit").alias("g")).union(marks.select("entry")).distinct(), "g").select("g", "exit").checkpoint()
    while True:
        more = marks.join(jump, F.col("entry") == F.col("g")).select(F.col("exit").alias("entry")).distinct().join(marks, "entry", "left_anti").checkpoint()
        if more.isEmpty():
            break
        marks = marks.union(more).checkpoint()
        jump = jump.join(jump.select(F.col("g").alias("exit"), F.col("exit").alias("far")), "exit").select("g", F.col("far").alias("exit")).checkpoint()
    entries = marks.select("entry", _part("entry").alias("part"))
    return steps.withColumn("part", _part()).groupBy("part").cogroup(entries.groupBy("part")).applyInArrow(_walked_group, "g long")


def _walked_group(rows: pa.Table, entries: pa.Table) -> pa.Table:
    return _walked(rows, entries) if rows.num_rows else pa.table({"g": pa.array([], pa.int64())})


def packed_sections(rows: DataFrame, key: str, order: Sequence[str], length: str, most: int = 60_000) -> DataFrame:
    """Adds `bucket`: rows of a key fill a section, in order, until it would exceed `most`; the sum starts anew with each section.

    A null length is 0, a longer row than `most` is a section of its own. Rows with a null key are a group like any other.
    """
    sized = _spread(rows.withColumn("_n", F.coalesce(F.col(length).cast("long"), F.lit(0))), key, *order)
    summed = running_sum(sized, key, "_n", "_value").checkpoint()
    full = F.struct((F.col("_value") - F.col("_n") + most).alias("value"), F.lit(1).alias("tie"), F.lit(0).cast("long").alias("g"))
    alone = F.struct(F.col("_value").alias("value"), F.lit(0).alias("tie"), F.col("g").alias("g"))
    steps = successors(summed, key, "_value", F.when(F.col("_n") > most, alone).otherwise(full))
    starts = reached(summed, key, steps).select("g", F.lit(1).alias("_start"))
    marked = summed.join(starts, "g", "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    return running_sum(marked, key, "_start", "_count").select(*rows.columns, (F.col("_count") - 1).alias("bucket"))


def spaced(rows: DataFrame, key: str, ts: str, order: Sequence[str], apart: int) -> DataFrame:
    """Adds `accepted`: the first row of a key in time is accepted, and then each that comes at least `apart` seconds (more than 0) after the
    last accepted one; rejected rows do not count. That is a sliding window with a limit of one. Rows without a time are rejected."""
    timed = _spread(rows.where(F.col(ts).isNotNull()), key, ts, *order).withColumn("_value", F.unix_micros(F.col(ts).cast("timestamp"))).checkpoint()
    target = F.struct((F.col("_value") + int(apart * 1_000_000)).alias("value"), F.lit(-1).alias("tie"), F.lit(0).cast("long").alias("g"))
    starts = reached(timed, key, successors(timed, key, "_value", target)).select("g", F.lit(True).alias("accepted"))
    marked = timed.join(starts, "g", "left").select(*rows.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))
    return marked.union(rows.where(F.col(ts).isNull()).withColumn("accepted", F.lit(False)))
