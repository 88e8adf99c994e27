"""Sinks of a stream that may see a batch twice: a log by epoch, and a keyed table that upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.files import exists
from corpusloom.streaming.stateful import landed_in_order


def append_events(batch: DataFrame, epoch: int, path: str) -> None:
    """An epoch writes its own folder anew, so a batch that runs again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


class KeyedTable:
    """A table by key in the shared folder: every epoch leaves its changes in a folder of its own, read as the newest row of each key.

    A batch that runs again overwrites its own folder and nothing else, so the table stays as it was. `compact` folds epochs into a base
    that names the last of them; changes of epochs up to the base's are never read again, whether they were removed or written anew.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str], schema: str):
        self.spark, self.path, self.key, self.order, self.schema = spark, path, list(key), list(order), schema

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        """The newest row of each key of a batch, as the changes of this epoch."""
        self._newest(batch).write.mode("overwrite").parquet(f"{self.path}/changes/epoch={epoch}")

    def _newest(self, rows: DataFrame, *first: str) -> DataFrame:
        """The last row of each key; tasks send one row a key."""
        others = [name for name in rows.columns if name not in self.key]
        rank = F.struct(*first, *self.order, *[name for name in others if name not in (*first, *self.order)])
        newest = rows.groupBy(*self.key).agg(F.max(rank).alias("_row"))
        return newest.select(*[F.col(name) if name in self.key else F.col("_row")[name].alias(name) for name in rows.columns])

    def _read(self, folder: str) -> DataFrame:
        path = f"{self.path}/{folder}"
        if not exists(self.spark, f"{path}/epoch=*"):
            return self.spark.createDataFrame([], f"{self.schema}, epoch long")
        return self.spark.read.schema(f"{self.schema}, epoch long").parquet(path)

    def base_epoch(self) -> int:
        """The epoch up to which changes are in the base; -1 without one."""
        return self._read("base").agg(F.coalesce(F.max("epoch"), F.lit(-1))).first()[0]

    def rows(self) -> DataFrame:
        """The table as it stands: by order within a key, the later epoch on a tie."""
        last = self.base_epoch()
        both = self._read("base").where(F.col("epoch") == last).unionByName(self._read("changes").where(F.col("epoch") > last))
        columns = [name for name in both.columns if name != "epoch"]
        ordered = Window.partitionBy(*self.key).orderBy(*[F.desc(name) for name in (*self.order, "epoch")])
        return both.withColumn("_rn", F.row_number().over(ordered)).where("_rn = 1").select(*columns)

    def compact(self, epoch: int) -> None:
        """Writes the base of all changes up to an epoch; a base that is there stays until the new one is whole."""
        last = self.base_epoch()
        changes = self._read("changes").where((F.col("epoch") > last) & (F.col("epoch") <= epoch))
        both = self._read("base").where(F.col("epoch") == last).unionByName(changes)
        self._newest(both.drop("epoch")).write.mode("overwrite").parquet(f"{self.path}/base/epoch={epoch}")


def pending(table: KeyedTable, valid: str) -> DataFrame:
    """Items whose newest row is not valid yet; one that became valid has left."""
    return table.rows().where(~F.coalesce(F.col(valid), F.lit(False)))


def run_into(spark: SparkSession, rows: DataFrame, ts: str, folder: str, write: Callable[[DataFrame, int], None], pieces: int = 3) -> None:
    """Runs a foreachBatch stream over a table as it lands in pieces in time order; it ends after each and starts again from its checkpoint."""
    for _ in landed_in_order(rows, ts, f"{folder}/in", pieces):
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
