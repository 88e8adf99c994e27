"""Texts in pieces: natural chunks with stable ids, pages of volumes, best windows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Target, back-track and overlap of chunks, in characters.
TARGET, BACK, OVERLAP = 1500, 200, 150
SENTENCE_END = "。！？!?.\n"


def natural_chunks(text: str | None, target: int = TARGET, back: int = BACK, overlap: int = OVERLAP) -> list[str]:
    """Blocks between blank lines or rules, packed up to the target; a longer block is cut at the last sentence end within the back-track, and its pieces overlap."""
    blocks = [b.strip() for b in re.split(r"\n\s*\n|\n[-=*_]{3,}\n", text or "") if b.strip()]
    out: list[str] = []
    held = ""
    for block in blocks:
        if held and len(held) + 2 + len(block) > target:
            out.append(held)
            held = ""
        if len(block) <= target:
            held = f"{held}\n\n{block}" if held else block
            continue
        at = 0
        while len(block) - at > target:
            tail = max((block.rfind(mark, at + target - back, at + target) for mark in SENTENCE_END), default=-1)
            end = tail + 1 if tail > at else at + target
            out.append(block[at:end])
            at = max(at + 1, end - overlap)
        held = block[at:]
    return [*out, held] if held else out


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, back: int = BACK, overlap: int = OVERLAP) -> DataFrame:
    """id, chunk_index, total_chunks, chunk of every whole text; blank texts give no row."""
    kind = dict(docs.dtypes)[id_col]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text in zip(frame[id_col], frame[text_col], strict=True):
                parts = natural_chunks(text, target, back, overlap)
                rows += [(key, i, len(parts), part) for i, part in enumerate(parts)]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "total_chunks", "chunk"])

    return docs.select(id_col, text_col).mapInPandas(cut, f"`{id_col}` {kind}, chunk_index int, total_chunks int, chunk string")


def unique_chunk_ids(chunks: DataFrame, base: str, source: str, priority: str, position: str) -> DataFrame:
    """Adds chunk_id: the bare base for the first source by priority, base@source for others, with #2, #3 .. for repeats within a source."""
    by_source = Window.partitionBy(base, source).orderBy(position)
    ranked = chunks.withColumn("_again", F.row_number().over(by_source)).withColumn("_place", F.dense_rank().over(Window.partitionBy(base).orderBy(priority, source)))
    name = F.when(F.col("_place") == 1, F.col(base)).otherwise(F.concat(base, F.lit("@"), source))
    return ranked.withColumn("chunk_id", F.when(F.col("_again") > 1, F.concat(name, F.lit("#"), F.col("_again"))).otherwise(name)).drop("_again", "_place")


def paged(texts: DataFrame, id_col: str, text_col: str, size: int = 13000) -> DataFrame:
    """Adds pages (how many) and a column page as asked, clamped to what exists; body is that page."""
    pages = F.greatest(F.lit(1), F.ceil(F.length(text_col) / size).cast("int"))
    page = F.least(F.greatest("page", F.lit(1)), pages)
    return texts.select(id_col, page.alias("page"), pages.alias("pages"), F.substring(F.col(text_col), (page - 1) * size + 1, F.lit(size)).alias("body"))


def best_windows(docs: DataFrame, words: Sequence[str], width: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, found, snippet: the window from a word's place that covers most distinct words, the earliest on a tie; texts without any word are left out."""
    kind = dict(docs.dtypes)[id_col]
    wanted = [w for w in words if w]

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text in zip(frame[id_col], frame[text_col], strict=True):
                places = sorted((m.start(), w) for w in wanted for m in re.finditer(re.escape(w), text or ""))
                best, right, inside = (0, 0), 0, {}
                for left, (start, word) in enumerate(places):
                    while right < len(places) and places[right][0] + len(places[right][1]) <= start + width:
                        inside[places[right][1]] = inside.get(places[right][1], 0) + 1
                        right += 1
                    found = sum(n > 0 for n in inside.values())
                    if found > best[0]:
                        best = (found, start)
                    if left < right:
                        inside[word] -= 1
                if best[0]:
                    rows.append((key, best[1], best[0], text[best[1] : best[1] + width].replace("\n", " ")))
            yield pd.DataFrame(rows, columns=[id_col, "start", "found", "snippet"])

    return docs.select(id_col, text_col).mapInPandas(pick, f"`{id_col}` {kind}, start long, found long, snippet string")


def segmentations(names: DataFrame, name_col: str, aliases: dict[str, str]) -> DataFrame:
    """Adds parts: the canonical names if the whole string splits into aliases in exactly one way, else null."""
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in names.dtypes)
    longest = max(map(len, aliases), default=0)

    def parse(subject: str) -> list[str] | None:
        ways: list[list[tuple[str, ...]]] = [[()]] + [[] for _ in subject]
        for end in range(1, len(subject) + 1):
            for start in range(max(0, end - longest), end):
                if (name := aliases.get(subject[start:end])) is not None:
                    ways[end] += [w + (name,) for w in ways[start]]
            ways[end] = list(dict.fromkeys(ways[end]))[:2]  # two are enough to tell that it is ambiguous
        return list(ways[-1][0]) if subject and len(ways[-1]) == 1 else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(parts=[parse(x or "") for x in frame[name_col]])

    return names.mapInPandas(run, f"{kinds}, parts array<string>")
