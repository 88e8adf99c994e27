"""Operators that SQL can call as table functions.

`register` makes them known to a session. Those that are a plan over views become SQL functions, which Catalyst takes apart and plans together
with the query around them: filters and column pruning reach the scans. Those that fold over rows take a TABLE argument; its
PARTITION BY and ORDER BY say which rows come together and how, and `analyze` derives the columns from the argument's.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: name, the view that it reads, parameters, columns, query.
PLANS = (
    ("entries_of_type", "part", "kind STRING", "p_partkey BIGINT, p_name STRING, n BIGINT", "SELECT p_partkey, p_name, count(*) OVER () AS n FROM part WHERE p_type = kind"),
    ("mentions_of", "documents", "name STRING", "doc_id BIGINT, n BIGINT", "SELECT doc_id, n FROM (SELECT doc_id, CAST((length(text) - length(replace(text, name, ''))) / length(name) AS BIGINT) AS n FROM documents) WHERE n > 0"),
    (
        "shared_mentions",
        "documents",
        "a STRING, b STRING",
        "doc_id BIGINT, weight BIGINT, heavier STRING",
        "SELECT x.doc_id, least(x.n, y.n), CASE WHEN x.n >= y.n THEN 'a' ELSE 'b' END FROM mentions_of(a) AS x JOIN mentions_of(b) AS y ON x.doc_id = y.doc_id",
    ),
)


def _argument(given: AnalyzeArgument, kind: type, what: str):
    """The constant value of an argument; anything else is refused before a job runs."""
    if given.isTable or not given.isConstantExpression or not isinstance(given.value, kind) or not given.value:
        raise ValueError(f"{what} is a constant {kind.__name__} that is not empty or 0")
    return given.value


class Contexts:
    """rows' columns, start and context: every place of a word in a text column, with so many characters around it."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, word: AnalyzeArgument, radius: AnalyzeArgument) -> AnalyzeResult:
        name = _argument(column, str, "column")
        _argument(word, str, "word")
        _argument(radius, int, "radius")
        if not rows.isTable or name not in rows.dataType.fieldNames():
            raise ValueError(f"the table has no column {name}")
        kept = [field for field in rows.dataType.fields if field.name != name]
        return AnalyzeResult(StructType([*kept, StructField("start", IntegerType()), StructField("context", StringType())]))

    def eval(self, row, column: str, word: str, radius: int) -> Iterator[tuple]:
        text = row[column] or ""
        others = [value for name, value in row.asDict().items() if name != column]
        at = text.find(word)
        while at >= 0:
            yield (*others, at, text[max(0, at - radius) : at + len(word) + radius])
            at = text.find(word, at + len(word))


class Sections:
    """rows' columns and bucket: rows of a partition, in its order, fill sections of `most`; the sum starts anew with each."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, length: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        name = _argument(length, str, "length")
        _argument(most, int, "most")
        if not rows.isTable or name not in rows.dataType.fieldNames():
            raise ValueError(f"the table has no column {name}")
        return AnalyzeResult(StructType([*rows.dataType.fields, StructField("bucket", LongType())]))

    def __init__(self):
        self.used = self.bucket = None

    def eval(self, row, length: str, most: int) -> Iterator[tuple]:
        n = row[length] or 0
        if self.used is None:
            self.used = self.bucket = 0
        elif self.used + n > most:
            self.used, self.bucket = 0, self.bucket + 1
        self.used += n
        yield (*row, self.bucket)


class Changes:
    """rows' columns and changed: whether a column differs from the row before it in its partition; the first row is a change."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        name = _argument(column, str, "column")
        if not rows.isTable or name not in rows.dataType.fieldNames():
            raise ValueError(f"the table has no column {name}")
        return AnalyzeResult(StructType([*rows.dataType.fields, StructField("changed", BooleanType())]))

    def __init__(self):
        self.last = self

    def eval(self, row, column: str) -> Iterator[tuple]:
        changed, self.last = self.last is self or self.last != row[column], row[column]
        yield (*row, changed)


def register(spark: SparkSession) -> None:
    """Makes the functions known, and of the plans those whose view is there."""
    from pyspark.sql.functions import udtf

    for name, kind in (("contexts", Contexts), ("sections", Sections), ("changes", Changes)):
        spark.udtf.register(name, udtf(kind))
    for name, view, parameters, columns, plan in PLANS:
        if spark.catalog.tableExists(view):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {plan}")
