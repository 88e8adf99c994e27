"""A batch and streaming source over landed API responses: JSON lines with a page title, revision and content.

The pages of a remote API arrive as files (there is no network in a job); a folder is a table `landed`. Each file is one input
partition, so a wide folder is read in parallel, and continuation tokens are the file names in order.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "pageid long, title string, lastrevid long, content string, error string"


class LandedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [InputPartition(name) for name in sorted(info.path for info in found if info.path.endswith((".json", ".jsonl")))]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:
            return
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.value) as data:
            for line in io.TextIOWrapper(data, encoding="utf-8"):
                if not line.strip():
                    continue
                try:
                    page = json.loads(line)
                    yield (page.get("pageid"), page.get("title"), page.get("lastrevid"), page.get("content"), None)
                except (ValueError, AttributeError) as problem:
                    yield (None, None, None, None, str(problem)[:200])


class Landed(DataSource):
    """Registered as `landed`; read from any store that Arrow can open. `landed_pages` is for all others."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options["path"])


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """The same rows by Spark's own reader, from any store."""
    schema = "pageid long, title string, lastrevid long, content string, error string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "error").json(path)
