"""Admission by sliding window and daily quota, and suppression of repeated calls; `stateful` has the forms that keep state over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_quota(events: DataFrame, client: str, ts: str, limit: int) -> DataFrame:
    """client, day, accepted, rejected by a quota a day."""
    counts = events.groupBy(client, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(client, "day", F.least("_n", F.lit(limit)).alias("accepted"), F.greatest(F.col("_n") - limit, F.lit(0)).alias("rejected"))


def _admit(times: list, now, window: pd.Timedelta, limit: int) -> bool:
    """Keeps the accepted times of the window in `times`; a rejected call is not recorded."""
    while times and times[0] <= now - window:
        times.pop(0)
    if len(times) >= limit:
        return False
    times.append(now)
    return True


def admitted(events: DataFrame, client: str, ts: str, id_col: str, window_seconds: int, limit: int) -> DataFrame:
    """id, client, ts, accepted. Only accepted calls count, so the decision is a fold in time order (id on a tie).

    Rows of a client are sorted by Spark and stream through; a task holds at most `limit` times, however many calls a client has.
    """
    kinds, span = dict(events.dtypes), pd.Timedelta(seconds=window_seconds)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, times = None, []
        for frame in frames:
            marks = []
            for who, at in zip(frame[client], frame[ts], strict=True):
                if who != now:
                    now, times = who, []
                marks.append(_admit(times, at, span, limit))
            yield frame.assign(accepted=marks)

    ordered = events.select(id_col, client, ts).repartition(client).sortWithinPartitions(client, ts, id_col)
    return ordered.mapInPandas(fold, f"`{id_col}` {kinds[id_col]}, `{client}` {kinds[client]}, `{ts}` {kinds[ts]}, accepted boolean")


def first_of_signature(calls: DataFrame, signature: list[str], order: str) -> DataFrame:
    """Adds reused_from: the first row of equal signature, null for that row itself."""
    window = Window.partitionBy(*signature).orderBy(order)
    return calls.withColumn("_first", F.first(order).over(window)).withColumn("reused_from", F.when(F.col("_first") != F.col(order), F.col("_first"))).drop("_first")


def first_of_signature_stream(calls: DataFrame, signature: list[str], ts: str, delay: str) -> DataFrame:
    """The first row of each signature within the watermark."""
    return calls.withWatermark(ts, delay).dropDuplicatesWithinWatermark(signature)


def daily_counts_stream(events: DataFrame, client: str, ts: str, delay: str) -> DataFrame:
    """client, day, n: tumbling days that close behind the watermark."""
    return events.withWatermark(ts, delay).groupBy(client, F.window(ts, "1 day").alias("_w")).agg(F.count(F.lit(1)).alias("n")).select(client, F.to_date("_w.start").alias("day"), "n")


def circuit(calls: DataFrame, session: str, order: str, failed: str, rejected: str, repeated: str) -> DataFrame:
    """session, stop, reason: two failures in a row at the end without success, two rejects, or two repeats."""
    window = Window.partitionBy(session)
    good = F.max(F.when(~F.col(failed), F.col(order))).over(window)
    marked = calls.withColumn("_good", good)
    sums = marked.groupBy(session).agg(
        F.count_if(F.col(failed) & (F.col("_good").isNull() | (F.col(order) > F.col("_good")))).alias("_f"), F.count_if(rejected).alias("_r"), F.count_if(repeated).alias("_d")
    )
    reason = F.when(F.col("_f") >= 2, "failures").when(F.col("_r") >= 2, "rejects").when(F.col("_d") >= 2, "repeats")
    return sums.select(session, reason.isNotNull().alias("stop"), reason.alias("reason"))
