"""Decisions that depend on what a key did before, over a stream: admission, a cache that expires, a circuit breaker.

Each is a function for `applyInPandasWithState`: Spark keeps one small value a key in its state store, hands it to the worker and takes it
back with the rows of many keys at once, so that no key costs calls of its own, gives it back after a restart, and an event-time timeout
forgets a key that has been silent for longer than its past can matter. Rows of a micro-batch are put in time order
(ties by id) before they are judged; a micro-batch holds what a trigger takes in. Rows behind the watermark are dropped by Spark.
The batch forms are `operators.chains.spaced` for admission with a limit of one and for the cache, and windows for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(times: np.ndarray) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class _Keyed:
    """One value of longs a key; `judge` gives the marks of rows in time order and the value after them."""

    state_schema = "past array<long>"

    def __init__(self, ts: str, id_col: str, name: str, silent: int):
        self.ts, self.id_col, self.name, self.silent = ts, id_col, name, silent

    def judge(self, past: list[int], times: list[int], rows: pd.DataFrame) -> tuple[list[Any], list[int]]:
        raise NotImplementedError

    def __call__(self, key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(frames)
        frame = held[0] if len(held) == 1 else pd.concat(held)
        times = frame[self.ts].to_numpy()
        if len(frame) > 1:
            order = np.lexsort((frame[self.id_col].to_numpy(), times))
            frame, times = frame.take(order), times[order]
        times = _micros(times)
        marks, past = self.judge([int(t) for t in state.get[0]] if state.exists else [], times, frame)
        state.update((past,))
        if self.silent:
            state.setTimeoutTimestamp(max(times) // 1000 + self.silent * 1000)
        yield frame.assign(**{self.name: marks})


class Admission(_Keyed):
    """accepted: fewer than `limit` accepted rows of the key lie in the last `window` seconds; rejected ones do not count."""

    def __init__(self, ts: str, id_col: str, window: int, limit: int):
        super().__init__(ts, id_col, "accepted", window)
        self.window, self.limit = window * 1_000_000, limit

    def judge(self, past, times, rows):
        marks = []
        for now in times:
            past = [t for t in past if t > now - self.window]
            marks.append(len(past) < self.limit)
            if marks[-1]:
                past.append(now)
        return marks, past


class Expiring(_Keyed):
    """rebuilt: the key's cached value was built `ttl` seconds ago or more, or never; so this access builds it."""

    def __init__(self, ts: str, id_col: str, ttl: int):
        super().__init__(ts, id_col, "rebuilt", ttl)
        self.ttl = ttl * 1_000_000

    def judge(self, past, times, rows):
        marks = []
        for now in times:
            marks.append(not past or now - past[0] >= self.ttl)
            if marks[-1]:
                past = [now]
        return marks, past


class Breaker(_Keyed):
    """opened: `threshold` failures in a row have happened by this row; once open it stays open, a success before that starts anew."""

    def __init__(self, ts: str, id_col: str, failed: str, threshold: int):
        super().__init__(ts, id_col, "opened", 0)
        self.failed, self.threshold = failed, threshold

    def judge(self, past, times, rows):
        strikes, marks = past[0] if past else 0, []
        for failed in rows[self.failed].tolist():
            if strikes < self.threshold:
                strikes = strikes + 1 if failed else 0
            marks.append(strikes >= self.threshold)
        return marks, [strikes]


def judged(events: DataFrame, key: str, processor: _Keyed, delay: str = "0 seconds") -> DataFrame:
    """The rows of a stream with the processor's mark."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = StructType([*events.schema.fields, StructType.fromDDL(f"`{processor.name}` boolean").fields[0]])
    return events.withWatermark(processor.ts, delay).groupBy(key).applyInPandasWithState(processor.__call__, schema, processor.state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def landed_in_order(rows: DataFrame, ts: str, folder: str, pieces: int) -> Iterator[int]:
    """Appends rows to a folder piece by piece in time order, for a stream to find; the bounds are approximate quantiles."""
    shares = [at / pieces for at in range(1, pieces)]
    bounds = rows.select(F.percentile_approx(F.unix_micros(F.col(ts).cast("timestamp")), F.array(*map(F.lit, shares))).alias("b")).first()["b"] if shares else []
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    for at, (low, high) in enumerate(zip([None, *(bounds or [])], [*(bounds or []), None], strict=True)):
        piece = rows.where(F.col(ts).isNotNull())
        piece = piece.where(micros >= low) if low is not None else piece
        piece = piece.where(micros < high) if high is not None else piece
        piece.write.mode("append").parquet(folder)
        yield at


def run_over(spark: SparkSession, rows: DataFrame, ts: str, folder: str, plan, pieces: int = 4) -> DataFrame:
    """Runs a stream over a table as it lands in pieces; the query ends after each and starts again from its checkpoint."""
    schema = rows.schema
    for _ in landed_in_order(rows, ts, f"{folder}/in", pieces):
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        sink = plan(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        query = sink.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
