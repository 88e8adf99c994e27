"""Line de-duplication with a suffix array over line-ID sequences.

A document is the sequence of its lines (cut at line feeds); a suffix is a line and all that follow it. A run of lines that also
occurs earlier (by doc_id, then position, the same document included) is a later copy; maximal copies of at least `min_words` words in all
are deleted. So one long line counts by itself, short ones together, and blank ones never alone.

Every line of such a run lies in a least window of it: the shortest one with so many words that starts at the run's first line, or
the shortest that ends at the line itself. So each line opens one window and closes one, and it is enough to know which windows
occur earlier. Only lines that occur again can take part; the others leave first, by 128 bits of their hash.

Distributed prefix doubling sorts the suffixes: ranks by the first w lines, paired with the ranks w lines further on, give ranks by
the first 2w, until the longest window is reached. Each round is one range sort; ties are broken by document and position, so even a
line that a third of all rows share is spread over many tasks. Ranks are dense: a task numbers its own keys, and the driver adds up
one small row a task. A window of w lines is told by two ranks that overlap, those of its first and of its last 2^k lines. In the
sorted order the suffixes whose longest common prefix reaches over a window stand together, as one interval; all but its first are later copies.

Null and empty texts have no lines. Rows that repeat an id and a text are one document: not a copy of itself, equal results. A null
id comes first. Runs are judged on the input and may overlap within a document. Texts are read whole; a document's repeated lines are
held by one task, as its row is. An empty table gives no rows; extra columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import keyed, row_keys
from corpusloom.session import ensure_checkpoint_dir

#: Words that a repeated run has at least.
MIN_WORDS = 8
WORD = r"[^\x20\x09-\x0D]+"
DOC = ["doc_id", "doc_key", "doc_check"]


def line_ids(docs: DataFrame, count_words: bool = False) -> DataFrame:
    """doc_id, doc_key, doc_check, pos, high, low (128 bits of the line) and, if asked for, words: one row a line of a keyed table."""

    def parts(line):
        words = [F.regexp_count(line, F.lit(WORD)).alias("words")] if count_words else []
        return F.struct(F.xxhash64(line).alias("high"), F.xxhash64(F.lit(7), line).alias("low"), *words)

    filled = docs.where(F.length("text") > 0)
    return filled.select(*DOC, F.posexplode(F.transform(F.split("text", "\n", -1), parts)).alias("pos", "line")).select(*DOC, "pos", "line.*")


def _sorted(suffixes: DataFrame, key: list[str]) -> DataFrame:
    """Suffixes in global order of key, then document and position; written to the shared folder so that the order stays."""
    order = [*key, *DOC, "pos"]
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.withColumn("part", F.spark_partition_id()).checkpoint()


def _numbered(ordered: DataFrame, key: list[str]) -> DataFrame:
    """Adds `new` (this row's key differs from the row before it in its part) and `seen` (distinct keys so far in its part)."""
    names = ordered.columns
    at = [names.index(k) for k in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in at]
            new = np.zeros(batch.num_rows, bool)
            for column in keys:
                new[1:] |= column[1:] != column[:-1]
            new[0] = before != tuple(column[0] for column in keys)
            count = seen + np.cumsum(new)
            before, seen = tuple(column[-1] for column in keys), int(count[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new.astype(np.int32)), pa.array(count)], [*names, "new", "seen"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in ordered.dtypes)
    return ordered.mapInArrow(run, f"{kinds}, new int, seen long")


def _offsets(numbered: DataFrame, key: list[str]) -> DataFrame:
    """A row for each part: what to add to `seen` for a dense rank over all parts, and whether its first key continues the part before."""
    struct = F.struct(*key)
    edges = numbered.groupBy("part").agg(F.min(struct).alias("first"), F.max(struct).alias("last"), F.sum("new").alias("n")).orderBy("part").collect()
    rows, total, last = [], 0, None
    for edge in edges:
        joins = int(edge["first"] == last)
        rows.append((edge["part"], total - joins, joins))
        total, last = total - joins + edge["n"], edge["last"]
    return F.broadcast(numbered.sparkSession.createDataFrame(rows, "part int, add long, joins int"))  # as many rows as tasks


def _doubled(ranks: DataFrame, width: int) -> DataFrame:
    """From the ranks (DOC, pos, rank) by `width` lines those by twice as many; positions nearer to the end of their stretch leave."""
    ahead = ranks.select(*DOC[1:], (F.col("pos") - width).alias("pos"), F.col("rank").alias("next"))
    numbered = _numbered(_sorted(ranks.join(ahead, [*DOC[1:], "pos"]), ["rank", "next"]), ["rank", "next"])
    return numbered.join(_offsets(numbered, ["rank", "next"]), "part").select(*DOC, "pos", (F.col("seen") + F.col("add")).alias("rank"))


def least_windows(doc: np.ndarray, pos: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first line and number of lines of the shortest windows with `least` words that open or close at a line.

    Lines come by document and position; windows stay within stretches of consecutive lines of a document.
    """
    new = np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1))
    stretch, n = np.cumsum(new) - 1, len(doc)
    total = np.append(0, np.cumsum(words))
    lift = stretch * (int(total[-1]) + least + 1)  # so that the sums of stretches lie apart
    at = np.arange(n) + stretch  # a stretch has one more sum than lines
    last = np.append(np.flatnonzero(new)[1:], n) - 1
    sums, of = np.zeros(n + len(last), np.int64), np.zeros(n + len(last), np.int64)
    sums[at], of[at] = total[:-1] + lift, stretch
    sums[at[last] + 1], of[at[last] + 1] = total[last + 1] + lift[last], stretch[last]
    end = np.searchsorted(sums, sums[at] + least)
    opens = np.flatnonzero((end < len(sums)) & (of[np.minimum(end, len(sums) - 1)] == stretch))
    begin = np.searchsorted(sums, sums[at + 1] - least, side="right") - 1
    closes = np.flatnonzero((begin >= 0) & (of[np.maximum(begin, 0)] == stretch))
    start = np.append(opens, closes + 1 - (at[closes] + 1 - begin[closes]))
    width = np.append(end[opens] - at[opens], at[closes] + 1 - begin[closes])
    both = np.unique(start * (n + 1) + width)
    return both // (n + 1), both % (n + 1)


def _windows(lines: DataFrame, least: int) -> DataFrame:
    """DOC, pos, width, rank: one row a least window (rank: that of its line, if it has one line only), and with width 0 one for each line that a longer one needs."""
    kinds = dict(lines.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(3).flatten()
            pos, rank, words = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            doc = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
            own = np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]))  # a repeated row has its lines again
            pos, rank, words, doc = pos[own], rank[own], words[own], doc[own]
            start, width = least_windows(doc, pos, words, least)
            cover = np.zeros(len(doc) + 1, np.int64)
            np.add.at(cover, start[width > 1], 1)
            np.add.at(cover, (start + width)[width > 1], -1)
            needed = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            every = np.append(start, needed)
            columns = [batch.column(i).take(pa.array(doc[every])) for i in range(3)]
            more = [pa.array(x.astype(kind)) for x, kind in ((pos[every], np.int32), (np.append(width, np.zeros(len(needed), np.int64)), np.int32), (rank[every], np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*DOC, "pos", "width", "rank"])

    return lines.mapInArrow(run, f"doc_id {kinds['doc_id']}, doc_key long, doc_check long, pos int, width int, rank long")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """DOC, pos, width: the least windows that occur earlier too. docs: keyed()."""
    ensure_checkpoint_dir(docs.sparkSession)
    often = line_ids(docs, count_words=True).groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.first("words").alias("words")).where("n > 1")
    often = often.select("high", "low", "words", F.monotonically_increasing_id().alias("rank")).checkpoint()  # fixes the ranks, and lets Spark split a hot line's join
    lines = line_ids(docs).join(often, ["high", "low"]).groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("pos", "rank", "words"))).alias("lines"))
    found = _windows(lines, min_words).checkpoint()
    ranks, width = found.where("width = 0").select(*DOC, "pos", "rank"), 1
    longest = found.agg(F.coalesce(F.max("width"), F.lit(0)).alias("n")).first()["n"]
    told = found.where("width = 1").select(*DOC, "pos", "width", "rank", F.lit(0).cast("long").alias("next"))
    while 2 * width <= longest:
        ranks, width = _doubled(ranks, width), 2 * width
        if 2 * width <= longest:
            ranks = ranks.checkpoint()
        own = found.where((F.col("width") >= width) & (F.col("width") < 2 * width)).drop("rank")
        ends = own.join(ranks.drop("doc_id"), [*DOC[1:], "pos"]).withColumn("end", F.col("pos") + F.col("width") - width)
        told = told.union(ends.join(ranks.select(*DOC[1:], F.col("pos").alias("end"), F.col("rank").alias("next")), [*DOC[1:], "end"]).select(*DOC, "pos", "width", "rank", "next"))
    key = ["width", "rank", "next"]
    numbered = _numbered(_sorted(told, key), key)
    first_of_part = (F.col("seen") == 1) & (F.col("new") == 1)
    original = (F.col("new") == 1) & ~(first_of_part & (F.col("joins") == 1))
    return numbered.join(_offsets(numbered, key), "part").where(~original).select(*DOC, "pos", "width")


def _kept(text: str | None, windows: list[dict] | None) -> tuple[list[str], list[tuple[int, int]]]:
    """The lines that stay, and the (first, end) of every deleted maximal run."""
    lines = text.split("\n") if text else []
    runs: list[tuple[int, int]] = []
    for start, end in sorted((x["pos"], x["pos"] + x["width"]) for x in windows or ()):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((start, end))
    kept, at = [], 0
    for start, end in runs:
        kept += lines[at:start]
        at = end
    return kept + lines[at:], runs


RESULT = "n_lines long, n_removed long, runs array<struct<start:int,end:int>>, text string"


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, n_lines, n_removed, runs (deleted lines), text (what is left), and the columns of `keep` as one struct `row`.

    Text that was null stays null. The text goes through one shuffle, with the positions that concern it.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        *row_keys(id_col, text_col),
        *([F.struct(*[F.col(f"`{name}`") for name in keep]).alias("row")] if keep else []),
    )
    copies = later_copies(keyed(docs, id_col, text_col), min_words).groupBy(*DOC[1:]).agg(F.collect_list(F.struct("pos", "width")).alias("copies"))
    joined = base.join(copies, DOC[1:], "left").select("doc_id", "text", "copies", *["row"] * bool(keep))
    kinds = dict(joined.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_removed, all_runs, texts = [], [], [], []
            for text, copies in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, runs = _kept(text, copies)
                gone = sum(end - start for start, end in runs)
                n_lines.append(len(kept) + gone)
                n_removed.append(gone)
                all_runs.append([{"start": start, "end": end} for start, end in runs])
                texts.append(text if text is None or not runs else "\n".join(kept))
            struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(all_runs, struct), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[3:]], ["doc_id", "n_lines", "n_removed", "runs", "text", *["row"] * bool(keep)])

    schema = f"doc_id {kinds['doc_id']}, {RESULT}" + (f", row {kinds['row']}" if keep else "")
    return joined.mapInArrow(run, schema)


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256 (of the text that is left)."""
    done = dedup_lines(docs, min_words)
    return done.select(
        "doc_id", "n_lines", "n_removed", F.size("runs").cast("long").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows with all their columns; text is what is left of it, and n_chars (where there is one) its length."""
    left = dedup_lines(docs, min_words, keep=tuple(docs.columns))
    changed = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("long"), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return left.select(*[changed[name].alias(name) if name in changed else F.col(f"row.`{name}`").alias(name) for name in docs.columns])
