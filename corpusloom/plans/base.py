"""The register of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    rows: tuple[str, ...]  # of the operator inventory
    run: Query
    sql: str | None


REGISTER: dict[str, Registered] = {}


def query(rows: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) under its own name, with the inventory rows that it covers and its SQL oracle."""

    def add(run: Query) -> Query:
        if run.__name__ in REGISTER:
            raise ValueError(f"two queries are named {run.__name__}")
        REGISTER[run.__name__] = Registered(run.__name__, tuple(rows.split()), run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
