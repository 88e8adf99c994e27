"""Vector collections as Parquet, partitioned by collection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import unit
from corpusloom.sources.files import exists

SCHEMA = "id string, document string, embedding array<float>, collection string"


def add(rows: DataFrame, path: str) -> None:
    """Appends unit vectors (a zero vector stays); ids are not replaced, duplicates stay until `latest` drops them."""
    scaled = F.transform(unit(F.col("embedding")), lambda x: x.cast("float"))
    rows.select(F.col("id").cast("string").alias("id"), "document", scaled.alias("embedding"), "collection").write.mode("append").partitionBy("collection").parquet(path)


def collections(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """All rows, or those of some collections by partition pruning; empty if nothing has been written."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.parquet(path)
    return rows.where(F.col("collection").isin(*names)) if names else rows


def drop(spark: SparkSession, path: str, collection: str) -> None:
    """Deletes one collection's folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/collection={collection}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def counts(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of each named collection, 0 for an absent one."""
    asked = rows.sparkSession.createDataFrame([(n,) for n in names], "collection string")
    found = rows.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(found, "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n"))


def embedded(rows: DataFrame, text_col: str, embed: Callable[[list[str]], np.ndarray | None], batch: int = 256) -> DataFrame:
    """Adds embedding by an injected model, batch by batch; a batch that the model does not answer in full stays null."""
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list = []
            for at in range(0, len(frame), batch):
                texts = frame[text_col].iloc[at : at + batch].fillna("").tolist()
                found = embed(texts)
                out += [None] * len(texts) if found is None or len(found) != len(texts) else [np.asarray(v, np.float32) for v in found]
            yield frame.assign(embedding=out)

    return rows.mapInPandas(run, f"{kinds}, embedding array<float>")
