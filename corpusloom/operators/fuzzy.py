"""Names that resemble asked ones, for many asked names at once and without comparing all pairs.

The score is the matching-block ratio 2m / (a + b) of two names of a and b characters; m is at most the number of characters that they
share, repeats counted. So a ratio of `floor` needs `needed(a, b)` shared characters, and lengths that are not too far apart. Every
name is the set of its characters numbered by occurrence, put in one global order with rare ones in front; two such sets that share
enough have one of their first few in common. An equi-join on such a character and a class of lengths therefore meets every pair that
can reach the floor; only those are scored.

Names of equal length that differ only by letters that sound alike, and agree in one place at least, score 0.6 and up to 0.3 more by the
share of places that agree, if their ratio is below the floor. They meet by a key in which each letter stands for its class.

Null and empty names resemble nothing. Repeated names count once. Ties go by length, then by the name. The broadcast dictionary holds a
number for each character that occurs, at most as many as Unicode has. A name gives as many rows as it has characters, times nine
classes of lengths if it is asked for.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of one class differ by at most this factor.
CLASS = 1.25
#: Guards sums of decimal fractions against rounding; one character more is a thousand million times as much.
TINY = 1e-9


def needed(a: int, b: int, floor: float) -> int:
    """Characters that two names of so many characters share at least, if their ratio reaches the floor."""
    return max(1, math.ceil(floor * (a + b) / 2 - TINY))


def shortest(n: int, floor: float) -> int:
    """Length of the shortest name that can reach the floor with one of n characters."""
    return max(1, math.ceil(n * floor / (2 - floor) - TINY))


def length_class(n: int) -> int:
    return int(math.log(n) / math.log(CLASS) + TINY)


def numbered(name: str, frequency: dict[str, int]) -> list[str]:
    """The characters of a name, each with the number of its occurrence, rare ones first: later occurrences, then less frequent characters."""
    seen: Counter = Counter()
    found = []
    for char in name:
        seen[char] += 1
        found.append((-seen[char], frequency.get(char, 0), char))
    return [f"{char}{-n}" for n, _, char in sorted(found)]


def name_parts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name: the distinct comma- or line-separated parts of some columns, trimmed."""
    every = F.flatten(F.array(*[F.split(F.coalesce(F.col(c), F.lit("")), "[,，\n]") for c in columns]))
    return rows.select(F.explode(F.transform(every, lambda part: F.trim(part, F.lit(" \t\r")))).alias("name")).where("name <> ''").distinct()


def classes(alike: Sequence[str]) -> tuple[str, str]:
    """Letters and what stands for them: groups that share a letter are one class."""
    stands: dict[str, str] = {}
    for group in alike:
        first = min(stands.get(char, char) for char in group)
        old = {stands.get(char, char) for char in group}
        stands = {char: first if at in old else at for char, at in stands.items()} | dict.fromkeys(group, first)
    return "".join(stands), "".join(stands.values())


def aligned_score(asked: str, name: str, alike: Sequence[frozenset[str]]) -> float:
    """0.6 to 0.9 for names that differ only by letters of one group and agree somewhere, else 0."""
    if len(asked) != len(name):
        return 0.0
    other = [(a, b) for a, b in zip(asked, name, strict=True) if a != b]
    same = len(asked) - len(other)
    if not same or not all(any(a in group and b in group for group in alike) for a, b in other):
        return 0.0
    return 0.6 + 0.3 * same / len(asked)


def candidates(asked: DataFrame, names: DataFrame, floor: float) -> DataFrame:
    """asked, name: all pairs (and some more) whose ratio reaches the floor. Both tables: distinct `name`."""
    chars = names.union(asked).select(F.explode(F.split("name", "")).alias("char")).where("char <> ''").groupBy("char").count()
    frequency = names.sparkSession.sparkContext.broadcast(dict(map(tuple, chars.collect())))

    def index(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                tokens, n = numbered(name, frequency.value), len(name)
                least = shortest(n, floor)
                first = tokens[: n - needed(least, n, floor) + 1]
                longest = int(n * (2 - floor) / floor + TINY)
                spread = range(length_class(least), length_class(max(longest, least)) + 1) if wanted else [length_class(n)]
                found += [(name, token, at, size) for size in spread for at, token in enumerate(first)]
            columns = list(zip(*found, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "token", "place", "size"])

    schema = "name string, token string, place int, size int"
    left = asked.mapInArrow(lambda batches: index(batches, True), schema).withColumnsRenamed({"name": "asked", "place": "_place"})
    right = names.mapInArrow(lambda batches: index(batches, False), schema)
    a, b = F.length("asked"), F.length("name")
    least = F.greatest(F.lit(1), F.ceil(F.lit(floor) * (a + b) / 2 - TINY))
    met = left.join(right, ["token", "size"]).where((least <= F.least(a, b)) & (F.col("_place") <= a - least) & (F.col("place") <= b - least))
    return met.select("asked", "name").distinct()


def similar_to_each(asked: DataFrame, asked_col: str, names: DataFrame, name_col: str, n: int = 3, floor: float = 0.6, alike: Sequence[str] = ()) -> DataFrame:
    """asked, name, score, rank: for each distinct asked name the n names most like it that reach the floor or sound alike."""
    if not 0 < floor <= 1:
        raise ValueError("the floor lies above 0 and is at most 1")

    def distinct(rows: DataFrame, column: Column) -> DataFrame:
        return rows.select(column.alias("name")).where("name <> ''").distinct()

    wanted, known = distinct(asked, F.col(asked_col)), distinct(names, F.col(name_col))
    pairs = candidates(wanted, known, floor)
    if alike:
        key = F.translate("name", *classes(alike)).alias("_key")
        pairs = pairs.union(wanted.select(F.col("name").alias("asked"), key).join(known.select("name", key), "_key").select("asked", "name")).distinct()
    groups = [frozenset(group) for group in alike]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matcher = SequenceMatcher(None, a, b, autojunk=False)
                ratio = matcher.ratio() if matcher.quick_ratio() >= floor else 0.0
                scores.append(ratio if ratio >= floor else aligned_score(a, b, groups))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], ["asked", "name", "score"])

    scored = pairs.mapInArrow(score, "asked string, name string, score double").where("score > 0")
    window = Window.partitionBy("asked").orderBy(F.desc("score"), F.length("name"), "name")
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
