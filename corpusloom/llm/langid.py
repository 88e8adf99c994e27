"""Language identification by words first, with back-off to character n-grams.

A word is a letter and the letters and marks that follow it (Unicode classes L and M), lower-cased. A known word scores each language by its log frequency there. An unseen word falls
back to the longest character n-grams (of the word between two blanks) of which the model knows at least one, and scores by
their mean log frequency, so that it weighs like one word. The languages' sums over all words of the text give the prediction
and, as a softmax, its score.

Words are counted over all learning texts in Spark, n-grams once for each distinct word. The model keeps every counted entry,
whatever its count: by the 64-bit hash of its text it lies in one of many shards, as many as the counted words fill, which are sorted
arrays in the shared folder that workers map into memory. Text that is null or has no letter is `und` with score 0; so is everything when nothing could be
learned. A tie goes to the first language by name. Repeated rows count each time and have equal results; very long texts are read whole,
a part at a time; an empty table gives no rows; rows with null lang or a null doc_id teach nothing, the latter are not held out; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import scratch_folder
from corpusloom.llm.shared import load, save, shard_count
from corpusloom.session import ensure_checkpoint_dir

#: Runs of letters in texts without combining marks or letter-like numbers.
LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: Entries that a task gathers before it hands them to the shuffle, and words that a worker remembers.
HELD = 200_000
#: Counted words of a shard on average, with their n-grams; a task writes four shards.
SHARD_WORDS = 1 << 18
#: Bytes of the texts whose words are looked up together: few, and each shard is visited for a handful of words.
PART_BYTES = 1 << 20
#: The seed of Spark's xxhash64.
SEED = 42
SMOOTH = 0.1


@cache
def _rare(char: str) -> bool:
    """Whether LETTERS takes this character for a letter, or for none, against its Unicode class."""
    return char > "\x7f" and unicodedata.category(char) in ("Mn", "Mc", "Me", "No", "Nl")


@cache
def _by_class() -> re.Pattern:
    """A letter (class L) and the letters and marks (L, M) that follow it."""

    def ranges(kinds: str) -> str:
        found, start = [], None
        for code in range(sys.maxunicode + 2):
            inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] in kinds
            if inside and start is None:
                start = code
            if not inside and start is not None:
                found.append(f"\\U{start:08x}-\\U{code - 1:08x}")
                start = None
        return "".join(found)

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text; the slower pattern only where it makes a difference."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii() and any(map(_rare, set(text))):
        return _by_class().findall(text)
    return LETTERS.findall(text)


def grams_of(word: str, order: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)] if order > 1 else list(word)


def _emit(counts: Counter, names: list[str]) -> pa.RecordBatch:
    keys = list(counts)
    columns = [pa.array([key[i] for key in keys]) for i in range(len(names) - 1)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], names)


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n over the whole texts; tasks add up what they can before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(words_of(text)).items():
                    counts[lang, word] += n
                if len(counts) >= HELD:
                    yield _emit(counts, ["lang", "word", "n"])
                    counts = Counter()
        if counts:
            yield _emit(counts, ["lang", "word", "n"])

    found = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return found.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """size, gram, lang, n: in how many distinct words of a language an n-gram occurs, with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((order, gram, lang) for order in ORDERS for gram in grams_of(word, order))
                if len(counts) >= HELD:
                    yield _emit(counts, ["size", "gram", "lang", "n"])
                    counts = Counter()
        if counts:
            yield _emit(counts, ["size", "gram", "lang", "n"])

    tallied = words.select("lang", "word").mapInArrow(run, "size long, gram string, lang string, n long")
    return tallied.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))


class Model:
    """Where the arrays are, the languages, and by size (0 for words, else the n-gram's order) each language's smoothed total."""

    def __init__(self, folder: str, bits: int, langs: list[str], totals: dict[int, np.ndarray]):
        self.folder, self.bits, self.langs, self.totals = folder, bits, langs, totals


class Scorer(dict):
    """Maps the words met lately to their rows of log frequencies; looks up many words at once."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.arrays = model, {}
        self.rows = np.zeros((HELD, len(model.langs)), np.float32)

    def _shard(self, size: int, shard: int) -> list[np.ndarray]:
        if (size, shard) not in self.arrays:
            kinds = {"key": "uint64", "first": "int64", "lang": "uint16", "count": "int64"}
            self.arrays[size, shard] = [load(self.model.folder, f"{size}-{name}-{shard}", kind) for name, kind in kinds.items()]
        return self.arrays[size, shard]

    def look(self, size: int, entries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which entries are known, and each one's log frequencies."""
        known = np.zeros(len(entries), bool)
        if size not in self.model.totals:
            return known, np.zeros((len(entries), len(self.model.langs)))
        counts = np.zeros((len(entries), len(self.model.langs)))
        keys = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SEED) for x in entries), np.uint64, len(entries))
        order = np.argsort(keys)
        ranked = keys[order]
        shards = (ranked >> np.uint64(64 - self.model.bits)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(keys) else []
        for start, end in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            stored, first, lang, count = self._shard(size, int(shards[start]))
            if not len(stored):
                continue
            at = np.minimum(np.searchsorted(stored, ranked[start:end]), len(stored) - 1)
            hit = stored[at] == ranked[start:end]
            at, place = at[hit], order[start:end][hit]
            known[place] = True
            begin, n = first[at], first[at + 1] - first[at]
            spots = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            np.add.at(counts, (np.repeat(place, n), lang[spots]), count[spots])
        return known, np.log((counts + SMOOTH) / self.model.totals[size])

    def learn(self, words: list[str]) -> None:
        """Rows for words that are not remembered; the unseen ones by their longest known n-grams."""
        known, table = self.look(0, words)
        table[~known] = 0
        left = np.flatnonzero(~known)
        for order in ORDERS:
            if not len(left):
                break
            own = [grams_of(words[i], order) for i in left]
            at: dict[str, int] = {}
            of_gram = np.array([at.setdefault(gram, len(at)) for grams in own for gram in grams], np.int64)
            of_word = np.repeat(np.arange(len(left)), [len(grams) for grams in own])
            there, rows = self.look(order, list(at))
            use = there[of_gram] if len(at) else np.zeros(0, bool)
            n = np.bincount(of_word[use], minlength=len(left))
            total = np.zeros((len(left), table.shape[1]))
            np.add.at(total, of_word[use], rows[of_gram[use]])
            table[left[n > 0]] = total[n > 0] / n[n > 0][:, None]
            left = left[n == 0]
        first = len(self)
        self.rows[first : first + len(words)] = table
        self.update(zip(words, range(first, first + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found, langs = [], self.model.langs
        own = [words_of(text) for text in texts]
        self._remember({word for words in own for word in words})
        for words in own:
            if not words or not langs:
                found.append(("und", 0.0))
                continue
            total = np.zeros(len(langs))
            for at in range(0, len(words), HELD // 2):
                part = words[at : at + HELD // 2]
                self._remember(set(part))
                total += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0, dtype=np.float64)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            found.append((langs[best], float(odds[best] / odds.sum())))
        return found

    def _remember(self, words: set[str]) -> None:
        """Looks up what is new; more than there is room for is left to the texts' own turns."""
        new = [word for word in words if word not in self]
        if not new or len(words) > HELD or not self.model.langs:
            return
        if len(self) + len(new) > HELD:
            self.clear()
            new = list(words)
        self.learn(sorted(new))


def learn(docs: DataFrame) -> Model:
    """A model of all documents with a language; docs: lang, text. Each counted entry is written to the shared folder."""
    spark = docs.sparkSession
    words = count_words(docs).checkpoint()
    counted = {row["lang"]: row["n"] for row in words.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counted)
    folder = scratch_folder(spark, "language")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = (max(shard_count(parts), -(-sum(counted.values()) // SHARD_WORDS)) - 1).bit_length()
    parts = max(parts, (1 << bits) // 4)
    if not langs:
        return Model(folder, bits, [], {})
    entries = words.select(F.lit(0).cast("long").alias("size"), F.col("word").alias("entry"), "lang", "n").union(count_grams(words).select("size", "gram", "lang", "n"))
    code = (F.array_position(F.array(*[F.lit(lang) for lang in langs]), F.col("lang")) - 1).cast("int")
    coded = entries.select("size", F.xxhash64("entry").alias("key"), code.alias("lang"), "n").withColumn("shard", F.shiftrightunsigned("key", 64 - bits).cast("int"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush():
            sizes, keys, codes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            keys = keys.view(np.uint64)
            for size in np.unique(sizes):
                here = np.flatnonzero(sizes == size)
                here = here[np.argsort(keys[here], kind="stable")]
                own = keys[here]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                arrays = {"key": own[first], "first": np.append(first, len(own)), "lang": codes[here].astype(np.uint16), "count": counts[here]}
                for name, array in arrays.items():
                    save(folder, f"{size}-{name}-{now}", array)
                sums = np.bincount(codes[here], counts[here], len(langs)).astype(np.int64)
                columns = [np.full(len(langs) + 1, size), np.arange(-1, len(langs)), np.append(len(first), sums)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["size", "lang", "n"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cuts = np.flatnonzero(columns[4][1:] != columns[4][:-1]) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                if columns[4][start] != now:
                    if held:
                        yield from flush()
                    now, held = int(columns[4][start]), []
                held.append([np.array(x[start:end]) for x in columns[:4]])
        if held:
            yield from flush()

    tallied = coded.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(write, "size long, lang long, n long")
    totals: dict[int, np.ndarray] = {}
    for row in tallied.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect():
        total = totals.setdefault(row["size"], np.zeros(len(langs)))
        total[slice(None) if row["lang"] < 0 else row["lang"]] += row["n"] * (SMOOTH if row["lang"] < 0 else 1)
    return Model(folder, bits, langs, totals)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in order, cut wherever another PART_BYTES of text (column 1) are full."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PART_BYTES
    cuts = np.flatnonzero(ends[1:] != ends[:-1]) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if end > start:
            yield batch.slice(start, end - start)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Its id column, lang_pred and score of every whole text; one row by itself, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for batch in batches:
            for part in _runs(batch):
                found = own.predict(part.column(1).to_pylist())
                columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")


def language_report(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents outside the held-out fold."""
    ensure_checkpoint_dir(docs.sparkSession)
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    model = learn(docs.where(remainder != held_out).select("lang", "text"))
    return identify(docs, model).select("doc_id", F.coalesce(remainder == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
