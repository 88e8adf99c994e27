"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A cluster names it in spark.checkpoint.dir; a temporary one serves only where that is unset, as in tests."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="corpusloom-"))
    return configured or context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder, in compressed columns; a checkpoint takes several times the room of texts and arrays."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
