"""Nested markup and cut JSON, read by counting what is open. Each is a small helper of a row, run over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRACES = re.compile(r"\{\{|\}\}")
NESTING = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
TOKEN = re.compile(r'\s*(?:(?P<open>[{\[])|(?P<close>[}\]])|(?P<comma>,)|(?P<colon>:)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<word>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


def parameters(body: str) -> tuple[str, dict[str, str]]:
    """Name and parameters of what stands between a template's braces; a bar within an inner template or link separates nothing, a
    parameter without a name gets its number, the first value of a name wins."""
    parts, depth, last = [], 0, 0
    for found in NESTING.finditer(body):
        if found[0] in ("{{", "[["):
            depth += 1
        elif found[0] in ("}}", "]]"):
            depth -= 1
        elif depth == 0:
            parts.append(body[last : found.start()])
            last = found.end()
    parts.append(body[last:])
    named: dict[str, str] = {}
    for number, part in enumerate(parts[1:], 1):
        key, sign, value = part.partition("=")
        if not sign or "{{" in key or "[[" in key:
            key, value = str(number), part
        named.setdefault(key.strip(), value.strip())
    return parts[0].strip(), named


def templates(text: str | None) -> list[dict]:
    """Every closed template: depth (closed ones around it), name, parameters, start and end. An unclosed one is refused, what it holds is not."""
    stack, found = [], []
    for brace in BRACES.finditer(text or ""):
        if brace[0] == "{{":
            stack.append(brace.start())
        elif stack:
            start = stack.pop()
            name, named = parameters(text[start + 2 : brace.start()])
            found.append({"start": start, "end": brace.end(), "name": name, "parameters": list(named.items())})
    found.sort(key=lambda x: x["start"])
    around: list[int] = []
    for one in found:
        while around and around[-1] <= one["start"]:
            around.pop()
        one["depth"] = len(around)
        around.append(one["end"])
    return found


def repaired(text: str | None) -> str | None:
    """The longest beginning of a cut JSON text that is whole once its open brackets are closed; null if there is none."""
    at, state, stack, best = 0, "value", [], None
    while found := TOKEN.match(text or "", at):
        kind, mark = found.lastgroup, found[found.lastgroup]
        if kind == "open" and state in ("value", "item"):
            stack.append("}" if mark == "{" else "]")
            state = "field" if mark == "{" else "item"
        elif kind == "close" and stack and stack[-1] == mark and (state == "after" or state == ("field" if mark == "}" else "item")):
            stack.pop()
            state = "after"
        elif kind in ("text", "word") and state in ("value", "item"):
            state = "after"
        elif kind == "text" and state in ("field", "key"):
            at, state = found.end(), "colon"
            continue
        elif kind == "colon" and state == "colon":
            at, state = found.end(), "value"
            continue
        elif kind == "comma" and state == "after" and stack:
            at, state = found.end(), "key" if stack[-1] == "}" else "value"
            continue
        else:
            break
        at = found.end()
        best = text[:at] + "".join(reversed(stack))
        if state == "after" and not stack:
            break
    return best


def _mapped(rows: DataFrame, ids: list[str], text: str, read: Callable, kind: str, arrow: pa.DataType) -> DataFrame:
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([read(x) for x in batch.column(len(ids)).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], made], [*ids, "made"])

    return rows.select(*ids, text).mapInArrow(run, ", ".join(f"`{name}` {kinds[name]}" for name in ids) + f", made {kind}")


def with_templates(rows: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, start, end, depth, name, parameters (a map): a row for each closed template."""
    fields = [("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("parameters", pa.map_(pa.string(), pa.string()))]
    kind = "array<struct<start:int,end:int,depth:int,name:string,parameters:map<string,string>>>"
    return _mapped(rows, ids, text, templates, kind, pa.list_(pa.struct(fields))).select(*ids, F.explode("made").alias("made")).select(*ids, "made.*")


def with_repaired(rows: DataFrame, ids: list[str], text: str, name: str = "repaired") -> DataFrame:
    """ids and the repaired text."""
    return _mapped(rows, ids, text, repaired, "string", pa.string()).withColumnRenamed("made", name)
