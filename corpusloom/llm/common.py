"""What the operators of this subpackage share: columns, scratch folders and word hashing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir

#: A run of ASCII letters and digits and of everything beyond ASCII.
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows; what Arrow no longer needs goes back to the system in between."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def views(texts: pa.StringArray) -> list[memoryview]:
    """The bytes of every text, without a copy; a null is empty."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")
    known = np.ones(len(texts), bool) if not texts.null_count else texts.is_valid().to_numpy(zero_copy_only=False)
    return [data[a:b] if there else data[:0] for a, b, there in zip(offsets[:-1].tolist(), offsets[1:].tolist(), known.tolist(), strict=True)]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and doc_key with doc_check, 128 bits: rows that repeat both an id and a text are one document, whatever else the table holds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_keys(id_col, text_col))


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """doc_key and doc_check: two hashes of id and text with unlike seeds."""
    return [F.xxhash64(id_col, text_col).alias("doc_key"), F.xxhash64(F.lit(7), text_col, id_col).alias("doc_check")]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * MIX2
    return x ^ (x >> np.uint64(29))


def _word_bytes(separators: str) -> np.ndarray:
    table = np.ones(256, bool)
    table[[byte for byte in range(256) if re.match(separators.encode(), bytes([byte]))]] = False
    return table


#: Which bytes belong to a word.
IN_WORD = _word_bytes(r"[\x20\x09-\x0D]")
#: A random odd value for each byte.
BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed at a time.
PIECE = 1 << 20


class Factors:
    """A random odd factor for each place in a word, as many as have been asked for."""

    def __init__(self):
        self.known = np.zeros(0, np.uint64)

    def get(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            places = np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64)
            self.known = mix64(mix64(places * GOLDEN)) | np.uint64(1)
        return self.known


_factors = Factors()


def _piece_codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of some bytes, and where each starts.

    A word's code is the sum of its bytes' values, each times the factor of its place (multilinear hashing modulo 2^64), mixed;
    no structure of a word, such as one that makes polynomials vanish, brings two words together.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = IN_WORD[raw]
    step = np.diff(inside)
    starts = np.flatnonzero(step == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = np.flatnonzero(step == -1) - starts
    first = np.cumsum(lengths) - lengths
    places = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = BYTES[raw[inside[1:-1].view(bool)]] * _factors.get(int(lengths.max()))[places]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64) * GOLDEN), starts


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts, one text after the other, and the number of words of each."""
    counts, found, group, size = np.zeros(len(texts), np.int64), [], [], 0

    def flush():
        data = b"\n".join(texts[i] for i in group)
        codes, starts = _piece_codes(data)
        ends = np.cumsum([len(texts[i]) + 1 for i in group])
        counts[group] = np.diff(np.searchsorted(starts, ends), prepend=0)
        found.append(codes)

    for i, text in enumerate(texts):
        if group and size + len(text) > PIECE:
            flush()
            group, size = [], 0
        if len(text) <= PIECE:
            group.append(i)
            size += len(text) + 1
            continue
        at = 0
        while at < len(text):  # a longer text in pieces that end at a separator
            end = at + PIECE
            while end < len(text) and IN_WORD[text[end]]:
                end += 1
            codes, _ = _piece_codes(text[at:end])
            found.append(codes)
            counts[i] += len(codes)
            at = end
    if group:
        flush()
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def joined_codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One code for each pair of codes, in order; mixed, so that nothing linear is left."""
    return mix64(left * GOLDEN + right)


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Where the runs of `width` words within a text start; counts: the number of words of each text."""
    room = np.maximum(counts - width + 1, 0)
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(room) - room), room)
    return first + np.arange(len(first))


def widened(codes: np.ndarray, have: int, width: int) -> np.ndarray:
    """From codes of runs of `have` words (a power of two) those of runs of `width` words, by doubling and one overlapping step."""
    while 2 * have <= width:
        codes, have = joined_codes(codes[:-have], codes[have:]), 2 * have
    return codes if have == width else joined_codes(codes[: -(width - have)], codes[width - have :])


def windows_hashed(codes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of `width` codes within a text, and where it starts; counts: the number of codes of each text."""
    starts = window_starts(counts, width)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    return widened(codes, 1, width)[starts], starts
