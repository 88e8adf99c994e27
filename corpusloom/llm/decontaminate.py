"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. A pattern is `window` consecutive words
of a benchmark item; an item of fewer words, but not none, is one pattern. Patterns of one length form a set with its own
tables. The block is the last two words under the search position: the shift table says how far the position may safely move,
the bucket of a zero shift holds the patterns that end with this block, and direct comparison confirms an occurrence. With no
common block the search jumps a whole window, so most words are never looked at.

Null and empty texts have no words. Repeated rows give equal results. Equal patterns of several items count for each of them. Texts
are searched whole, however long; without documents there are no rows, without items no hits; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ALNUM_WORD, doc_bytes, parts

#: Items are searched for in blocks whose texts have this many bytes in all. A worker's tables take some hundred times as much, as
#: every word starts a window of its own.
BLOCK_BYTES = 2 << 20


def words_of(text: str | None) -> list[bytes]:
    return ALNUM_WORD.findall(doc_bytes(text).lower())


class PatternSet:
    """Shift and bucket tables for patterns that all have `length` words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])
                distance = length - end
                self.shift[key] = min(self.shift.get(key, self.default), distance)
                if not distance:
                    self.buckets[key].append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, items) of every occurrence, in order."""
        n, length, default = len(words), self.length, self.default
        shift_of = self.shift.get
        at = length - 1
        if self.block == 1:
            for at, word in enumerate(words):
                if word in self.buckets:
                    yield at, self.buckets[word][0][1]
            return
        while at < n:
            key = (words[at - 1], words[at])
            distance = shift_of(key, default)
            if distance:
                at += distance
                continue
            start = at - length + 1
            window = words[start : at + 1]
            for pattern, items in self.buckets[key]:
                if pattern == window:
                    yield start, items
            at += 1


def compile_patterns(items: Iterable[tuple[object, str | None]], window: int) -> list[PatternSet]:
    by_length: dict[int, dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for start in range(len(words) - length + 1 if words else 0):
            holders = by_length[length][tuple(words[start : start + length])]
            if item not in holders:
                holders.append(item)
    return [PatternSet(length, patterns) for length, patterns in sorted(by_length.items())]


def spans_of(words: list[bytes], sets: list[PatternSet]) -> tuple[list[tuple[int, int]], set]:
    """Merged spans of hit words, and the items found."""
    found, items = [], set()
    for patterns in sets:
        for start, holders in patterns.search(words):
            found.append((start, start + patterns.length))
            items.update(holders)
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged, items


_compiled: dict[str, list[PatternSet]] = {}


def _tables(block: bytes, window: int) -> list[PatternSet]:
    """The tables of a block of items; a worker keeps those of one block."""
    key = f"{window}:{hashlib.sha256(block).hexdigest()}"
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = compile_patterns(pickle.loads(block), window)
    return _compiled[key]


def _scan(docs: DataFrame, items: list, window: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_words, spans and items; the items go to the workers as they are and are compiled there."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(items))
    field = text_col.removeprefix(f"{id_col}.") if text_col.startswith(f"{id_col}.") else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _tables(shared.value, window)
        for batch in parts(batches):
            counts, spans, found = [], [], []
            for text in batch.column(0).field(field) if field else batch.column(1):
                words = words_of(text.as_py())
                hit, items = spans_of(words, sets)
                counts.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in hit])
                found.append(sorted(map(str, items)))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "spans", "items"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    schema = f"{id_col} {kind}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    return docs.select(id_col, *([] if field else [text_col])).mapInArrow(run, schema)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """Items in blocks of bounded size, one partition of the table at a time on the driver."""
    block, size = [], 0
    for row in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(doc_bytes(row[1]))
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row a document: its id, n_words, spans of hit words, and items (sorted as strings) with occurring windows.

    A benchmark of one block costs one scan of the documents and no shuffle. A larger one is searched for block by block, the texts are
    then read once a block; the driver and a worker hold one block at a time. What the blocks find is merged for each distinct text,
    by 128 bits of its hash, and joined to the rows.
    """
    blocks = _blocks(benchmark, item_col, "text", block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _scan(docs, first, window, id_col, text_col)
    keys = [F.xxhash64(text_col).alias("_key"), F.xxhash64(F.lit(7), text_col).alias("_check")]
    texts = docs.select(F.struct(*keys).alias("_who"), F.col(text_col).alias("_text"))
    hits = _scan(texts, first, window, "_who", "_text").unionByName(_scan(texts, second, window, "_who", "_text"))
    for block in blocks:
        hits = hits.unionByName(_scan(texts, block, window, "_who", "_text"))
    merged = hits.groupBy("_who").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("_spans"),  # sets: copies add nothing
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    spans = F.aggregate(
        "_spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    found = merged.select("_who._key", "_who._check", "n_words", spans.alias("spans"), "items")
    return docs.select(id_col, *keys).join(found, ["_key", "_check"]).select(id_col, "n_words", "spans", "items")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, **columns) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: at least `percent` of the words are hit."""
    found = find_contamination(docs, benchmark, window, **columns)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).select(
        columns.get("id_col", "doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, **columns) -> DataFrame:
    """The documents that are not contaminated, with all their columns; searched in one pass with the rows themselves."""
    everything = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row")
    verdict = contamination_report(docs.select(everything), benchmark, window, percent, id_col="_row", text_col="_row.text", **columns)
    return verdict.where(~F.col("contaminated")).select("_row.*")


def digest_of(items: Iterable[object]) -> str:
    """items_sha256 of a plain list of items."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
