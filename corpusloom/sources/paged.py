"""Paged API responses as a data source, for batches and for streams.

A response holds some pages and the token of the next response, as paged listings of an API do. Responses land in a folder, one folder
`token=...` each, in any store that Arrow can open (there is no network in a job). The offset of a stream is the token of
the response that comes next, so a stream that starts again goes on where it ended; a response is one input partition, read in
its task. In a batch, filters on pageid and lastrevid are taken over and applied before rows are made, filters on the token leave
responses unread. Responses that are no JSON give a row with their error.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "token string, pageid long, title string, lastrevid long, content string, error string"
COMPARED = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


class Store:
    """A folder of responses by token."""

    def __init__(self, path: str):
        self.path = path

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def tokens(self) -> list[str]:
        """All tokens that have landed, in order."""
        from pyarrow import fs

        system, path = self._open()
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(info.base_name.removeprefix("token=") for info in found if info.base_name.startswith("token="))

    def rows(self, token: str) -> Iterator[tuple]:
        """The pages of a response."""
        from pyarrow import fs

        system, path = self._open()
        for info in sorted(system.get_file_info(fs.FileSelector(f"{path}/token={token}")), key=lambda x: x.path):
            if info.base_name.startswith(("_", ".")):
                continue
            with system.open_input_stream(info.path) as data:
                body = data.read()
            for line in filter(bytes.strip, body.split(b"\n")):
                try:
                    for page in json.loads(line)["pages"]:
                        yield (token, page.get("pageid"), page.get("title"), page.get("lastrevid"), page.get("content"), None)
                except (ValueError, KeyError, TypeError, AttributeError) as problem:
                    yield (token, None, None, None, None, f"{type(problem).__name__}: {problem}"[:200])


class PagedReader(DataSourceReader):
    def __init__(self, path: str):
        self.store, self.kept = Store(path), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes over comparisons of one column of the first four with a value."""
        names = ("token", "pageid", "title", "lastrevid")
        for found in filters:
            if type(found) in COMPARED and len(found.attribute) == 1 and found.attribute[0] in names:
                self.kept.append((names.index(found.attribute[0]), COMPARED[type(found)], found.value))
            else:
                yield found

    def _holds(self, row: tuple, only: int | None = None) -> bool:
        return all(row[at] is not None and getattr(row[at], test)(value) is True for at, test, value in self.kept if only is None or at == only)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(token) for token in self.store.tokens() if self._holds((token,), 0)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        return iter(()) if partition is None else (row for row in self.store.rows(partition.value) if self._holds(row))


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.store = Store(path)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max(self.store.tokens(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(token) for token in self.store.tokens() if start["after"] < token <= end["after"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.store.rows(partition.value)


class Paged(DataSource):
    """`spark.dataSource.register(Paged)`, then format `paged` with the option `path`."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options["path"])

    def streamReader(self, schema) -> PagedStreamReader:  # noqa: N802
        return PagedStreamReader(self.options["path"])


def land(pages: DataFrame, folder: str, size: int = 25) -> None:
    """Writes pages (pageid, title, lastrevid, content) as responses of `size` ids each, with the token of the next; more may be appended."""
    number = F.floor(F.col("pageid") / size)
    token = lambda n: F.lpad(n.cast("string"), 12, "0")
    grouped = pages.groupBy(number.alias("n")).agg(F.sort_array(F.collect_list(F.struct("pageid", "title", "lastrevid", "content"))).alias("pages"))  # `size` rows at most
    body = F.to_json(F.struct("pages", F.struct(token(F.col("n") + 1).alias("token")).alias("continue")))
    grouped.select(body.alias("value"), token(F.col("n")).alias("token")).write.mode("append").partitionBy("token").text(folder)
