"""Importance resampling towards a target distribution, over hashed n-grams, with an integer word dictionary.

Words are lower-cased (A-Z) runs of ASCII letters, digits and of everything beyond ASCII; features are all runs of 1 to `max_n` words of a
text, repeats counted. A feature's bucket is the crc32 of its words, joined by one space, modulo `buckets`. How much more often a bucket
occurs in the target than in the raw texts is its gain; a text's weight is the floored mean gain of its features. Gumbel noise, fixed by a
seed and doc_id, makes the highest sums a draw without replacement in proportion to the exponential of the weights.

1. Chunks: each task reads its texts chunk by chunk (`CHUNK_BYTES`) and writes, to the shared folder, the chunk's distinct words under local
   numbers, its longer n-grams as tuples of them, each with the texts that hold it and how often (packed), and a row a text. Everything
   below reads these tables, so it doesn't matter how a lost task deals its rows when it runs again.
2. Dictionary: words of both corpora are range-sorted by word and chunk, so that a frequent word spreads over tasks too; equal words in a
   row get one integer id. A word is the tuple of its own id, so here it is hashed as well, once, and its chunks' rows leave it behind.
3. Longer n-grams: a grouping by chunk turns local into dictionary ids. Every distinct tuple is hashed once: its ids are joined to their
   words, the bytes put together again; its bucket joins its chunks' rows.
4. Counts join back: rows give bucket counts and gains, each task adds up what its rows mean for each text, and the sums go to the
   chunk. A frequent tuple is one row a chunk.
5. Ranks come from a range sort; the driver adds up one count a task.

The driver and a broadcast hold one row a bucket and one a task. Null and empty texts have no words, weigh 0 and are not drawn.
Repeated rows are texts of their own with equal weights and scores; ties go to the smaller doc_id, a null one first, whose noise
is that of an empty id. Texts are read whole, however long; no rows give no rows, an empty target has no counts. Other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ALNUM_WORD, parts, scratch_folder, views, window_starts
from corpusloom.session import ensure_checkpoint_dir

#: Bytes of text in a chunk; texts whose sums a task holds before it sends them on.
CHUNK_BYTES, HELD = 8 << 20, 1 << 20
CELLS = "chunk long, word binary, local int, tuple array<int>, total long, cell binary, at int, n_words long, n_features long"
CELL_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("word", pa.binary()), ("local", pa.int32()), ("tuple", pa.list_(pa.int32())), ("total", pa.int64()), ("cell", pa.binary())]
    + [("at", pa.int32()), ("n_words", pa.int64()), ("n_features", pa.int64())]
)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values cut at the ends of the lists."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values, kind))


def _packed(docs: np.ndarray, n: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Cells: pairs of 32-bit numbers, a text and how often it holds the tuple."""
    pairs = np.stack([docs, n], axis=1).astype("<u4")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, 8 * ends).astype(np.int32)), pa.py_buffer(pairs.tobytes())])


def _unpacked(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all cells, and how many each has."""
    pairs = np.frombuffer(b"".join(cells.to_pylist()), "<u4").reshape(-1, 2).astype(np.int64)
    return pairs, pc.binary_length(cells).to_numpy() // 8


def tuples_of(codes: np.ndarray, counts: np.ndarray, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: distinct tuples (a row each), the end of each one's texts, the texts, and the tuple's occurrences in them.

    codes: word numbers of one text after the other; counts: the number of words of each.
    """
    of = np.repeat(np.arange(len(counts)), counts)
    known, above = codes.astype(np.int64), int(codes.max()) + 1 if len(codes) else 1
    for length in range(1, max_n + 1):
        starts = window_starts(counts, length)
        if not len(starts):
            return
        if length > 1:  # a longer tuple is the number of the shorter one at its start and one more word
            pairs = np.zeros(len(codes), np.int64)
            pairs[starts] = np.unique(known[starts] * above + codes[starts + length - 1], return_inverse=True)[1]
            known = pairs
        cells, first, n = np.unique(known[starts] * len(counts) + of[starts], return_index=True, return_counts=True)
        tuples, docs = cells // len(counts), cells % len(counts)
        ends = np.append(np.flatnonzero(tuples[1:] != tuples[:-1]) + 1, len(tuples))
        shown = starts[first[ends - 1]]
        yield codes[shown[:, None] + np.arange(length)], ends, docs, n


def _chunk(number: int, ids: list[pa.Array], texts: list[bytes], max_n: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one chunk: words, tuples, texts."""

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["chunk"] = pa.array(np.full(size, number))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    words = [ALNUM_WORD.findall(text.lower()) for text in texts]
    counts = np.array([len(x) for x in words], np.int64)
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(word, len(numbers)) for text in words for word in text), np.int64, int(counts.sum()))
    del words
    for tuples, ends, docs, n in tuples_of(codes, counts, max_n):
        total = np.add.reduceat(n, np.append(0, ends[:-1]))
        kind = {"total": pa.array(total), "cell": _packed(docs, n, ends)}
        if tuples.shape[1] == 1:  # in the order of the words' numbers
            yield rows(len(tuples), word=pa.array(list(numbers), pa.binary()), local=pa.array(np.arange(len(numbers), dtype=np.int32)) if max_n > 1 else pa.nulls(len(tuples), pa.int32()), **kind)
        else:
            yield rows(len(tuples), tuple=_lists(tuples.ravel(), tuples.shape[1] * np.arange(1, len(tuples) + 1), pa.int32()), **kind)
    features = sum(np.maximum(counts - length + 1, 0) for length in range(1, max_n + 1))
    yield rows(len(texts), doc_id=pa.concat_arrays(ids), at=pa.array(np.arange(len(texts), dtype=np.int32)), n_words=pa.array(counts), n_features=pa.array(features))


def chunks(texts: DataFrame, max_n: int, id_col: str, text_col: str, first: int = 0) -> DataFrame:
    """Writes the chunks of a table, numbered from `first`, to the shared folder; rows with `word`, with `tuple`, and with `at` (texts)."""
    rows = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"{CELLS}, doc_id {dict(rows.dtypes)['doc_id']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, size = first + (TaskContext.get().partitionId() << 32), [], [], 0
        for batch in parts(batches):
            kinds = CELL_SCHEMA.append(pa.field("doc_id", batch.column(0).type))
            for at, text in enumerate(views(batch.column(1))):
                ids.append(batch.column(0).slice(at, 1))
                held.append(bytes(text))
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield from _chunk(number, ids, held, max_n, kinds)
                    number, ids, held, size = number + 1, [], [], 0
        if held:
            yield from _chunk(number, ids, held, max_n, kinds)

    spark = texts.sparkSession
    rows.mapInArrow(run, schema).write.parquet(folder := scratch_folder(spark, "chunks"))
    return spark.read.schema(schema).parquet(folder)


def _saved(df: DataFrame, name: str) -> DataFrame:
    df.write.parquet(folder := scratch_folder(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered_words(raw: DataFrame, target: DataFrame, buckets: int, spell: bool) -> DataFrame:
    """id, bucket, chunk, total, cell of every chunk's words; where longer tuples must be spelled also local, and word where an id begins.

    A word that a task's end cuts has an id in each task, which `dictionary` brings together.
    """
    columns = ["word", "chunk", "total", "cell", *(["local"] if spell else [])]
    both = raw.where("word is not null").select(*columns).union(target.where("word is not null").select(*columns))
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, bucket = (TaskContext.get().partitionId() << 33) - 1, None, 0
        for batch in batches:
            ids, hashes, begins = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int32), np.zeros(batch.num_rows, bool)
            for at, word in enumerate(batch.column(0).to_pylist()):
                if word != last:
                    number, last, bucket, begins[at] = number + 1, word, zlib.crc32(word) % buckets, True
                ids[at], hashes[at] = number, bucket
            made = [pa.array(ids), pa.array(hashes), *(batch.column(at) for at in (1, 2, 3))]
            if spell:
                made += [batch.column(4), pc.if_else(pa.array(begins), batch.column(0), pa.scalar(None, batch.column(0).type))]
            yield pa.RecordBatch.from_arrays(made, ["id", "bucket", "chunk", "total", "cell", *(["local", "word"] if spell else [])])

    ordered = both.repartitionByRange(parts, "word", "chunk").sortWithinPartitions("word", "chunk")
    return _saved(ordered.mapInArrow(run, f"id long, bucket int, chunk long, total long, cell binary{', local int, word binary' if spell else ''}"), "words")


def dictionary(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """word and id, one row a distinct word; and what other id a word had where a task's end cut it (at most a row a task)."""
    every = numbered.where("word is not null").select("word", "id")
    words = _saved(every.groupBy("word").agg(F.min("id").alias("id"), F.collect_set("id").alias("ids")), "dictionary")
    return words.select("word", "id"), words.where(F.size("ids") > 1).select(F.explode("ids").alias("old"), "id").where("old <> id")


def longer_tuples(cells: DataFrame, numbered: DataFrame, same: DataFrame) -> DataFrame:
    """ids (a tuple of dictionary ids), chunk, total, cell of the chunks' longer n-grams."""
    local = numbered.select("id", F.col("chunk").alias("of"), "local").join(F.broadcast(same.toDF("id", "instead")), "id", "left")  # a row a task
    local = local.select("of", "local", F.coalesce("instead", "id").alias("id"))

    def renumber(cells: pa.Table, local: pa.Table) -> pa.Table:
        known = np.zeros(local.num_rows, np.int64)
        known[local["local"].to_numpy()] = local["id"].to_numpy()
        tuples = cells["tuple"].combine_chunks()
        ends = np.cumsum(tuples.value_lengths().to_numpy())
        return pa.table({"ids": _lists(known[tuples.flatten().to_numpy()], ends, pa.int64()), "chunk": cells["chunk"], "total": cells["total"], "cell": cells["cell"]})

    grouped = cells.where("tuple is not null").select("chunk", "tuple", "total", "cell").groupBy("chunk")
    return _saved(grouped.cogroup(local.groupBy("of")).applyInArrow(renumber, "ids array<long>, chunk long, total long, cell binary"), "tuples")


def hashed_tuples(tuples: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, total, cell of the longer n-grams; each distinct tuple is spelled and hashed once."""
    placed = tuples.select("ids").distinct().select("ids", F.posexplode("ids").alias("pos", "id")).join(words, "id")
    spelled = placed.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words"))
    text = F.aggregate(F.slice("words", 2, F.size("words")), F.element_at("words", 1)["word"], lambda done, x: F.concat(done, F.lit(b" "), x["word"]))
    hashed = _saved(spelled.select("ids", (F.crc32(text) % buckets).cast("int").alias("bucket")), "hashed")
    return tuples.join(hashed, "ids").select("bucket", "chunk", "total", "cell")


def gains(cells: DataFrame, buckets: int) -> dict[int, int]:
    """The gain of each bucket that occurs, by its cells' totals (chunks below 0 are the target's); at most `buckets` rows come to the driver."""
    wanted = F.col("chunk") < 0
    rows = cells.groupBy("bucket").agg(F.sum(F.when(wanted, 0).otherwise(F.col("total"))).alias("s"), F.sum(F.when(wanted, F.col("total")).otherwise(0)).alias("t")).collect()
    raw, target = float(sum(row["s"] for row in rows)), float(sum(row["t"] for row in rows))
    return {row["bucket"]: math.floor(1000 * math.log((row["t"] + 1.0) * (raw + buckets) / ((row["s"] + 1.0) * (target + buckets)))) for row in rows}


def _summed(batches: Iterator[pa.RecordBatch], gain: dict[int, int], buckets: int) -> Iterator[pa.RecordBatch]:
    """of (a chunk), docs, sums: what a task's cells (bucket, chunk, cell) mean for each text, a row a chunk."""
    table = np.zeros(buckets, np.int64)
    table[list(gain)] = list(gain.values())
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        chunk, doc, value = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, chunk))
        chunk, doc, value = chunk[order], doc[order], value[order]
        first = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (doc[1:] != doc[:-1])))
        chunk, doc, value = chunk[first], doc[first], np.add.reduceat(value, first)
        ends = np.append(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, len(chunk))
        return pa.RecordBatch.from_arrays([pa.array(chunk[ends - 1]), _lists(doc, ends, pa.int32()), _lists(value, ends, pa.int64())], ["of", "docs", "sums"])

    for batch in batches:
        pairs, lengths = _unpacked(batch.column(2))
        if len(pairs):
            held.append((np.repeat(batch.column(1).to_numpy(), lengths), pairs[:, 0], pairs[:, 1] * np.repeat(table[batch.column(0).to_numpy()], lengths)))
        if sum(len(x[0]) for x in held) >= HELD:
            yield flush()
            held.clear()
    if held:
        yield flush()


def noise(seed: str, doc_id: object) -> int:
    """A thousandth's Gumbel noise that seed and id fix."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id") -> DataFrame:
    """chunk and at (which name a row), doc_id, n_words, n_features, weight, score of every text; as written to the shared folder."""
    spark = docs.sparkSession
    raw, wanted = chunks(docs, max_n, id_col, text_col), chunks(target, max_n, target_id, text_col, first=-(1 << 62))
    numbered = numbered_words(raw, wanted, buckets, max_n > 1)
    columns = ["bucket", "chunk", "total", "cell"]
    cells = numbered.select(*columns)
    if max_n > 1:
        words, same = dictionary(numbered)
        longer = ["chunk", "tuple", "total", "cell"]
        cells = cells.union(_saved(hashed_tuples(longer_tuples(raw.select(*longer).union(wanted.select(*longer)), numbered, same), words, buckets), "cells"))
    known = spark.sparkContext.broadcast(gains(cells, buckets))  # a number a bucket
    sums = cells.where("chunk >= 0").select("bucket", "chunk", "cell").mapInArrow(lambda batches: _summed(batches, known.value, buckets), "of long, docs array<int>, sums array<long>")
    texts = raw.where("at is not null").select("chunk", "at", "doc_id", "n_words", "n_features")
    kind = dict(texts.dtypes)["doc_id"]

    def weigh(texts: pa.Table, sums: pa.Table) -> pa.Table:
        texts = texts.sort_by("at")
        total = np.zeros(texts.num_rows, np.int64)
        docs, values = sums["docs"].combine_chunks(), sums["sums"].combine_chunks()
        np.add.at(total, docs.flatten().to_numpy(), values.flatten().to_numpy())
        features = texts["n_features"].to_numpy()
        weight = np.where(features > 0, total // np.maximum(features, 1), 0)
        score = weight + np.array([noise(seed, x) for x in texts["doc_id"].to_pylist()], np.int64)
        return texts.append_column("weight", pa.array(weight)).append_column("score", pa.array(score))

    schema = f"chunk long, at int, doc_id {kind}, n_words long, n_features long, weight long, score long"
    return _saved(texts.groupBy("chunk").cogroup(sums.groupBy("of")).applyInArrow(weigh, schema), "weighted")


def ranked(rows: DataFrame, order: list, parts: int) -> DataFrame:
    """Adds `rank`, 1 for the first row in `order` (which tells all rows apart); the driver gets one count a task."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint()
    placed = placed.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33).cast("int"))
    before, offsets = 0, []
    for row in placed.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((row["_part"], before + 1 - (row["_part"] << 33)))
        before += row["count"]
    known = spark.createDataFrame(offsets, "_part int, _add long")
    return placed.join(F.broadcast(known), "_part").withColumn("rank", F.col("_at") + F.col("_add")).drop("_at", "_part", "_add")  # as many rows as tasks


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank: of the texts with enough words, the highest `percent` have ranks 1, 2, 3, ..., all others none."""
    found = weighted(docs, target, **options)
    enough = F.col("n_words") >= least_words
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = found.where(enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("chunk"), F.asc("at")]
    placed = ranked(found.where(enough), order, parts)
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    return placed.select(*columns, rank).union(found.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))


def report_sql(buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> str:
    """DuckDB SQL for runs of one word, written from the contract; crc32 is worked out bit by bit."""
    from corpusloom.llm.oracles import ALNUM, LOWER

    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    crc = "xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"
    return f"""WITH crc AS MATERIALIZED (SELECT {table} AS crcs), d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, {ALNUM}) AS w FROM documents),
    b AS (SELECT regexp_extract_all({LOWER}, {ALNUM}) AS w FROM benchmark), x AS MATERIALIZED (SELECT r, unnest(w) AS word FROM d), y AS MATERIALIZED (SELECT unnest(w) AS word FROM b),
    h AS (SELECT word, list_transform(range(1, 2 * strlen(word), 2), lambda i: ('0x' || hex(word)[i:i + 1])::BIGINT) AS bytes FROM (SELECT word FROM x UNION SELECT word FROM y)),
    k AS MATERIALIZED (SELECT word, {crc} % {buckets} AS bucket FROM h, crc), s AS (SELECT bucket, count(*) AS s FROM x JOIN k USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM y JOIN k USING (word) GROUP BY bucket),
    n AS (SELECT (SELECT count(*) FROM x) AS s_all, (SELECT count(*) FROM y) AS t_all),
    g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + {buckets}) / ((s + 1.0::DOUBLE) * (t_all + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
    m AS (SELECT r, sum(gain)::BIGINT AS total, count(*) AS n FROM x JOIN k USING (word) JOIN g USING (bucket) GROUP BY r),
    v AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || sha256('{seed}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN m USING (r)),
    z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM v),
    o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= {least_words})
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {percent} // 100 THEN rank END AS rank FROM z LEFT JOIN o USING (r)"""
