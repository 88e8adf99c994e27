"""Substring de-duplication over prefix-partitioned suffix trees.

Words are runs of `[^\\x20\\x09-\\x0D]`, unchanged; a window is `window` consecutive words of one text. A window that starts more
than once is a node of the corpus's suffix tree at depth `window` with several leaves. Such nodes are found exactly, word by word:

1. Texts are dealt into blocks of bounded size, by a hash of the row, and ordered there, so that a block is the same whenever it is
   made or read again.
2. Filter: a block sends 32 bits of every distinct window's hash to one of many shards; a shard's number of windows is fixed, so
   that the share of false alarms does not grow. What comes back is one bit a window: may it stand elsewhere?
3. Anchors: of the first half of a window's words, the one where a hash of the next words is smallest. Equal windows have equal
   anchors, neighbours mostly share one, and windows of one anchor in a row make one record of words; so a window that may be
   repeated travels in about five words instead of `window`.
4. Variable-length prefixes: a record belongs to the group of the shortest prefix at its anchor (1, 2, 4, 8, 16 words) whose bucket
   holds at most `group_size` anchors of the corpus, by counts over all texts. Where none does, each of its windows goes by itself
   to the group of its whole path. So a group fits a task, and a passage in a third of all texts is one record a block.
5. A task builds its groups' subtrees level by level: words get exact numbers, nodes at depth 2d are distinct pairs of nodes at
   depth d, down to `window`. Deep nodes with several leaves are repeats; the blocks get them back by position.
6. Overlapping repeated windows join into maximal repeated runs, which go.

Null and empty texts have no words; a text too short for a window passes by without a shuffle. Every row is a document of its own,
so a row that occurs twice repeats all its windows; rows with null doc_id take part like any other. Texts of any length are read
whole; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import PIECE, coded, doc_bytes, mix64, widened, window_starts, windows_hashed

#: Bytes of text in a block, and in all for each shard; anchors that a group may hold before its prefix grows.
BLOCK_BYTES, SHARD_BYTES, GROUP_SIZE = 6 << 20, 12 << 20, 1 << 16
#: Least bits of a bucket; bits of the buckets that one row of counts holds; corpus bytes for one anchor, about.
LEAST_BITS, SLICE_BITS, ANCHOR_BYTES = 14, 14, 60
#: Words of records whose subtrees are built at a time.
CHUNK = 1 << 20
RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def spread_of(window: int) -> int:
    """The number of words among which a window's anchor is chosen."""
    return (window + 1) // 2


def levels_of(window: int) -> list[int]:
    """Prefix lengths: powers of two that any window holds from its anchor on."""
    return [1 << k for k in range(window.bit_length()) if 1 << k <= window - spread_of(window) + 1]


def anchors_of(codes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window: the first place of the least mark; a mark is a hash of up to four words."""
    spread = spread_of(window)
    marks = widened(mix64(codes), 1, min(4, window - spread + 1))
    best, have = np.arange(len(marks)), 1
    while have < spread:
        step = min(have, spread - have)
        left, right = best[:-step], best[step:]
        best = np.where(marks[right] < marks[left], right, left)
        have += step
    return best[starts]


def _prefixes(codes: np.ndarray, at: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each level the hashes of the prefixes at some places."""
    now, have = codes, 1
    for level, width in enumerate(levels_of(window)):
        now, have = widened(now, have, width) if width > have else now, width
        yield level, mix64(now[at] + np.uint64(level))


def _by_piece(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= 4 * PIECE:
            yield group
            group, size = [], 0
    if group:
        yield group


def small_prefixes(docs: DataFrame, window: int, bits: int, group_size: int, text_col: str = "text") -> np.ndarray:
    """For each level and bucket of prefixes, packed, whether at most `group_size` anchors of all texts fall into it. The counts are
    summed by slices in Spark; one bit a bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _by_piece([doc_bytes(text) for text in batch.column(0).to_pylist()]):
                codes, counts = coded(texts)
                starts = window_starts(counts, window)
                if not len(starts):
                    continue
                at = np.unique(anchors_of(codes, starts, window))
                for level, hashes in _prefixes(codes, at, window):
                    buckets, n = np.unique(hashes >> np.uint64(64 - bits), return_counts=True)
                    slices = (buckets >> np.uint64(SLICE_BITS)).astype(np.int64)
                    cuts = _cut(slices)
                    low = (buckets & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint16)
                    ends = [*cuts[1:], len(low)]
                    columns = [pa.array([level] * len(cuts), pa.int32()), pa.array(slices[cuts]), *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (low, n.astype(np.uint32)))]
                    yield pa.RecordBatch.from_arrays(columns, ["level", "slice", "low", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << SLICE_BITS, np.int64)
        for low, n in zip(table.column("low"), table.column("n"), strict=True):
            total[np.frombuffer(low.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.uint32)
        own = [pa.array([table.column(name)[0].as_py()], kind) for name, kind in (("level", pa.int32()), ("slice", pa.int64()))]
        return pa.table([*own, pa.array([np.packbits(total <= group_size).tobytes()], pa.binary())], ["level", "slice", "small"])

    found = np.full((len(levels_of(window)), 1 << (bits - SLICE_BITS), 1 << (SLICE_BITS - 3)), 255, np.uint8)
    counted = docs.select(text_col).mapInArrow(count, "level int, slice long, low binary, n binary")
    for row in counted.groupBy("level", "slice").applyInArrow(add, "level int, slice long, small binary").toLocalIterator():
        found[row["level"], row["slice"]] = np.frombuffer(row["small"], np.uint8)
    return found.reshape(len(found), -1)


def _cut(column: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, column[1:] != column[:-1])) if len(column) else np.zeros(0, np.int64)


def _texts_of(table: pa.Table) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(packed.as_py()) for packed in table.column("packed")]


def _in_order(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """The rows of a block, which a shuffle hands over in any order, and their texts, by text: places in a block count from reading to
    reading. Equal texts may change places, as the same windows of theirs are repeated."""
    texts = _texts_of(table)
    order = sorted(range(len(texts)), key=texts.__getitem__)
    return table.take(pa.array(order, pa.int64())), [texts[i] for i in order]


def _filter_keys(hashes: np.ndarray, shard_bits: int) -> tuple[np.ndarray, ...]:
    """Distinct (shard, 32 bits) in order, how often each occurs, and each window's place among them."""
    keys, place, n = np.unique(hashes >> np.uint64(32 - shard_bits), return_inverse=True, return_counts=True)
    return (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32), n, place


def _records(codes: np.ndarray, starts: np.ndarray, window: int, small: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows and group of every record that the windows at `starts` make."""
    anchors = anchors_of(codes, starts, window)
    new = np.append(True, (starts[1:] != starts[:-1] + 1) | (anchors[1:] != anchors[:-1]))
    first = np.flatnonzero(new)
    group, free = np.zeros(len(first), np.uint64), np.ones(len(first), bool)
    for level, hashes in _prefixes(codes, anchors[first], window):
        buckets = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        fits = free & (small[level, buckets >> 3] >> (7 - (buckets & 7)) & 1).astype(bool)
        group[fits] = hashes[fits]
        free &= ~fits
    sizes = np.diff(first, append=len(starts))
    if free.any():  # no prefix is rare enough: one record a window, by its whole path
        alone = np.repeat(free, sizes)
        paths = mix64(widened(codes, 1, window)[starts[alone]] + np.uint64(len(small)))
        begin = np.concatenate([starts[first[~free]], starts[alone]])
        return begin, np.concatenate([sizes[~free], np.ones(len(paths), np.int64)]), np.concatenate([group[~free], paths])
    return starts[first], sizes, group


def deep_nodes(words: list[bytes], lengths: np.ndarray, window: int) -> np.ndarray:
    """How many leaves the node at depth `window` has, for each window of records laid end to end: the levels of their subtrees."""
    numbers: dict[bytes, int] = {}
    nodes, depth = np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), np.int64, len(words)), 1
    while depth < window:
        step = min(depth, window - depth)  # the last level may overlap
        pairs = nodes[:-step] * (nodes.max() + 1) + nodes[step:]
        nodes, depth = np.unique(pairs, return_inverse=True)[1], depth + step
    own = nodes[window_starts(lengths, window)]
    return np.bincount(own)[own] if len(own) else own


def _judged(keys: np.ndarray, texts: list[bytes], sizes: np.ndarray, window: int) -> np.ndarray:
    """For each window of each record, whether its node has several leaves; whole groups at a time."""
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum(sizes)
    found = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    groups = _cut(keys[order])
    at = 0
    while at < len(groups):
        end, size = at, 0
        while end < len(groups) and (end == at or size < CHUNK):
            own = order[groups[end] : groups[end + 1] if end + 1 < len(groups) else len(order)]
            size += int((sizes[own] + window - 1).sum())
            end += 1
        chunk = order[groups[at] : groups[end] if end < len(groups) else len(order)]
        own = sizes[chunk]
        leaves = deep_nodes(b" ".join(texts[i] for i in chunk).split(), own + window - 1, window)
        places = np.repeat(ends[chunk] - own - (np.cumsum(own) - own), own) + np.arange(len(leaves))
        found[places] = leaves > 1
        at = end
    return found


def _left(texts: list[bytes], gone: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """n_words, runs and the words that stay of each text."""
    runs, kept, at = [], [], 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        own = gone[at : at + n]
        at += n
        words = text.split()
        edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
        runs.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
        kept.append(b" ".join(words if not len(edges) else [words[i] for i in np.flatnonzero(~own)]))
    return [pa.array(counts, pa.int64()), pa.array(runs, RUNS), pa.array(kept, pa.binary()).cast(pa.string())]


def repeated_runs(
    docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, group_size: int = GROUP_SIZE
) -> DataFrame:
    """One row a document: its id column, n_words, runs (array<struct<start,end>>: maximal repeated runs of words), text (the words that stay, joined by one space).

    The shuffles carry a row for each block and shard that meet; with far more data, both may be larger on larger executors.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, -(-size // block_bytes))
    shard_bits = (max(parts, size // shard_bytes) - 1).bit_length()
    bits = max(LEAST_BITS, (size // ANCHOR_BYTES * 4 // group_size).bit_length())
    result = f"`{id_col}` {kind}, n_words long, runs array<struct<start:int,end:int>>, text string"
    names = [id_col, "n_words", "runs", "text"]
    short = F.coalesce(F.octet_length(text_col), F.lit(0)) < 2 * window - 1
    tables = spark.sparkContext.broadcast(small_prefixes(docs.where(~short), window, bits, group_size, text_col))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [doc_bytes(text) for text in batch.column(1).to_pylist()]
            counts = np.array([len(text.split()) for text in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_left(texts, np.zeros(int(counts.sum()), bool), counts)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([compress(doc_bytes(text)) for text in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed], ["block", id_col, "packed"])

    where = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).alias("block")
    base = docs.where(~short).select(where, id_col, text_col).mapInArrow(pack, f"block long, `{id_col}` {kind}, packed binary")

    def send(table: pa.Table) -> pa.Table:
        hashes, _ = windows_hashed(*coded(_texts_of(table)), window)
        shard, keys, n, _ = _filter_keys(hashes, shard_bits)
        block, cuts = table.column("block")[0].as_py(), _cut(shard)
        rows = [
            {"shard": int(shard[a]), "block": block, "keys": keys[a:b].tobytes(), "several": np.packbits(n[a:b] > 1).tobytes()}
            for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True)
        ]
        return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("several", pa.binary())]))

    def suspect(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(value.as_buffer(), np.uint32) for value in table.column("keys")]
        sizes = [len(own) for own in keys]
        repeated = np.concatenate([np.unpackbits(np.frombuffer(value.as_buffer(), np.uint8), count=n) for value, n in zip(table.column("several"), sizes, strict=True)]).astype(bool)
        every = np.concatenate(keys)
        order = np.argsort(every)
        same = every[order[1:]] == every[order[:-1]]
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        marks = [np.packbits(part).tobytes() for part in np.split(repeated, np.cumsum(sizes)[:-1])]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "marks": pa.array(marks, pa.binary())})

    def offer(left: pa.Table, right: pa.Table) -> pa.Table:
        left, texts = _in_order(left)
        codes, counts = coded(texts)
        hashes, starts = windows_hashed(codes, counts, window)
        rows = []
        if len(starts):
            shard, _, _, place = _filter_keys(hashes, shard_bits)
            marked = np.zeros(len(shard), bool)
            marks = dict(zip(right.column("shard").to_pylist(), right.column("marks").to_pylist(), strict=True))
            cuts = _cut(shard)
            for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                marked[a:b] = np.unpackbits(np.frombuffer(marks[int(shard[a])], np.uint8), count=b - a)
            starts = starts[marked[place]]
        if len(starts):
            begin, sizes, group = _records(codes, starts, window, tables.value, bits)
            words = b"\n".join(texts).split()
            to = (group >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(group), np.int64)
            order = np.lexsort((group, to))
            cuts = _cut(to[order])
            block = left.column("block")[0].as_py()
            compress = zstandard.ZstdCompressor(level=3).compress
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                own = order[a:b]
                seen: dict[bytes, int] = {}
                of = np.array([seen.setdefault(b" ".join(words[s : s + n + window - 1]), len(seen)) for s, n in zip(begin[own].tolist(), sizes[own].tolist(), strict=True)], np.uint32)
                _, first = np.unique(of, return_index=True)
                rows.append(
                    {
                        "shard": int(to[own[0]]),
                        "block": block,
                        "groups": group[own[first]].tobytes(),
                        "sizes": sizes[own[first]].astype(np.uint32).tobytes(),
                        "texts": compress(b"\n".join(seen)),
                        "of": of.tobytes(),
                        "begin": begin[own].astype(np.uint32).tobytes(),
                    }
                )
        return pa.Table.from_pylist(rows, OFFERED)

    def judge(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        groups, sizes, texts = [], [], []
        for row in zip(*(table.column(name) for name in ("groups", "sizes", "texts")), strict=True):
            groups.append(np.frombuffer(row[0].as_buffer(), np.uint64))
            sizes.append(np.frombuffer(row[1].as_buffer(), np.uint32).astype(np.int64))
            texts += unpack(row[2].as_py()).split(b"\n")
        repeated = np.split(_judged(np.concatenate(groups), texts, np.concatenate(sizes), window), np.cumsum([int(n.sum()) for n in sizes])[:-1])
        hits = []
        for found, n, of, begin in zip(repeated, sizes, table.column("of"), table.column("begin"), strict=True):
            of, begin = (np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in (of, begin))
            several = np.bincount(of) > 1  # the block itself has the record more than once
            found = found | np.repeat(several, n)
            first = np.cumsum(n) - n
            own = n[of]
            inner = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            hits.append((np.repeat(begin, own) + inner)[found[np.repeat(first[of], own) + inner]].astype(np.uint32).tobytes())
        return pa.table({"block": table.column("block"), "hits": pa.array(hits, pa.binary())})

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        left, texts = _in_order(left)
        counts = np.array([len(text.split()) for text in texts], np.int64)
        cover = np.zeros(int(counts.sum()) + 1, np.int32)
        for hits in right.column("hits"):
            at = np.frombuffer(hits.as_buffer(), np.uint32).astype(np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
        return pa.table([left.column(id_col).combine_chunks(), *_left(texts, np.cumsum(cover[:-1]) > 0, counts)], names=names)

    sent = base.groupBy("block").applyInArrow(send, "shard int, block long, keys binary, several binary")
    marks = sent.groupBy("shard").applyInArrow(suspect, "block long, shard int, marks binary")
    offered = base.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(offer, "shard int, block long, groups binary, sizes binary, texts binary, of binary, begin binary")
    verdicts = offered.groupBy("shard").applyInArrow(judge, "block long, hits binary")
    long = base.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(answer, result)
    return long.union(docs.where(short).select(id_col, text_col).mapInArrow(whole, result))


OFFERED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), *((name, pa.binary()) for name in ("groups", "sizes", "texts", "of", "begin"))])


def substring_report(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one space), n_runs."""
    found = repeated_runs(docs, window)
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.size("runs").cast("long").alias("n_runs")
    )
