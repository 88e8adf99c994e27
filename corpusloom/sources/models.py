"""Models that answer row by row: loaded once a worker, asked batch by batch, asked again for what is missing."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Model = Callable[[list[tuple]], Sequence[Any] | None]
#: Of this worker: a model for each name that it was given.
_loaded: dict[str, Model] = {}


def _asked(model: Model, rows: list[tuple], tries: int, wait: float) -> list[Any]:
    """Answers to rows: what a try leaves open (an error, no answer, fewer answers, nulls among them) is asked again, and null in the end."""
    found: list[Any] = [None] * len(rows)
    open_ = list(range(len(rows)))
    for attempt in range(tries):
        if attempt and wait:
            time.sleep(wait * 2 ** (attempt - 1))
        try:
            answers = model([rows[at] for at in open_]) or []
        except Exception:  # noqa: BLE001  a model may fail in any way; its rows stay open
            answers = []
        for at, answer in zip(list(open_), answers, strict=False):
            found[at] = answer
        open_ = [at for at in open_ if found[at] is None]
        if not open_:
            break
    return found


def answered(rows: DataFrame, inputs: Sequence[str], load: Callable[[], Model], kind: str, name: str = "answer", batch: int = 256, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """Adds a column with a model's answers to some columns; `kind` is its type.

    `load` makes the model, once a worker and not once a task. Rows keep their order and number; unanswered ones are null.
    """
    key, names = uuid.uuid4().hex, rows.columns
    kinds = ", ".join(f"`{column}` {of}" for column, of in rows.dtypes)
    arrow = to_arrow_schema(StructType.fromDDL(f"a {kind}")).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded[key] = load()
        for part in batches:
            asked = list(zip(*(part.column(column).to_pylist() for column in inputs), strict=True))
            found = [answer for at in range(0, len(asked), batch) for answer in _asked(_loaded[key], asked[at : at + batch], tries, wait)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, arrow)], [*names, name])

    return rows.mapInArrow(run, f"{kinds}, `{name}` {kind}")
