"""Which names occur in which texts: counts, first places, inverted index and co-occurrence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import occurrences

try:
    import ahocorasick
except ImportError:  # a list of names is then searched one by one
    ahocorasick = None

#: Names that are broadcast as one automaton; more are searched block by block.
NAME_BLOCK = 200_000


class Patterns:
    """Names with their entities; finds every occurrence, overlaps included."""

    def __init__(self, pairs: list[tuple[str, str]]):
        owners: dict[str, list[str]] = {}
        for name, entity in pairs:
            owners.setdefault(name, []).append(entity)
        self.owners, self.automaton = owners, None
        if ahocorasick is not None and owners:
            self.automaton = ahocorasick.Automaton()
            for name in owners:
                self.automaton.add_word(name, name)
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[str, int]]:
        """(name, start) of each occurrence."""
        if self.automaton is not None:
            for end, name in self.automaton.iter(text):
                yield name, end - len(name) + 1
            return
        for name in self.owners:
            at = text.find(name)
            while at >= 0:
                yield name, at
                at = text.find(name, at + 1)


def mention_index(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """entity_id, entry_id, pattern_hits, first_start, first_end for every entity of names (entity_id, name) found in a text.

    Overlapping occurrences count, and so does each of several names of an entity. The names are a dictionary: they go to the
    workers in blocks of at most NAME_BLOCK, and every block reads the texts once; the sums per text need no shuffle.
    """
    clean = names.where(F.length(F.trim("name")) > 1).select(F.col("entity_id").cast("string").alias("entity_id"), F.trim("name").alias("name")).select("name", "entity_id").distinct()
    blocks = max(1, -(-clean.count() // NAME_BLOCK))
    kind = dict(docs.dtypes)[id_col]
    found = None
    for block in range(blocks):
        part = clean if blocks == 1 else clean.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast([tuple(row) for row in part.toLocalIterator()])

        def scan(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            patterns = Patterns(shared.value)
            for frame in frames:
                rows = []
                for key, text in zip(frame[id_col], frame[text_col], strict=True):
                    sums: dict[str, list[int]] = {}
                    for name, start in patterns.find(text or ""):
                        for entity in patterns.owners[name]:
                            known = sums.setdefault(entity, [0, start, start + len(name)])
                            known[0] += 1
                            if (start, start + len(name)) < (known[1], known[2]):
                                known[1:] = [start, start + len(name)]
                    rows += [(entity, key, *figures) for entity, figures in sums.items()]
                yield pd.DataFrame(rows, columns=["entity_id", "entry_id", "pattern_hits", "first_start", "first_end"])

        part = docs.select(id_col, text_col).mapInPandas(scan, f"entity_id string, entry_id {kind}, pattern_hits long, first_start long, first_end long")
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("entity_id", "entry_id").agg(F.sum("pattern_hits").alias("pattern_hits"), F.min(F.struct("first_start", "first_end")).alias("_f"))
        found = found.select("entity_id", "entry_id", "pattern_hits", "_f.first_start", "_f.first_end")
    return found.where(F.col("pattern_hits") >= least)


def counted_names(docs: DataFrame, names: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, name, n: occurrences of a few names without overlap, inside code generation; texts without one give no row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), occurrences(text_col, n).alias("n")) for n in names]))
    return docs.select(F.col(id_col), pairs.alias("_p")).select(id_col, "_p.name", "_p.n").where("n > 0")


def inverted(mentions: DataFrame, entity: str = "entity_id", entry: str = "entry_id") -> DataFrame:
    """entry, entities: the sorted names of each entry; bounded by the dictionary."""
    return mentions.groupBy(entry).agg(F.sort_array(F.collect_set(entity)).alias("entities"))


def index_stats(mentions: DataFrame, previous: DataFrame | None = None, entity: str = "entity_id") -> DataFrame:
    """entity, entries, hits, and delta of hits against a previous run of the same shape."""
    now = mentions.groupBy(entity).agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("hits"))
    if previous is None:
        return now.withColumn("delta", F.lit(None).cast("long"))
    then = previous.groupBy(entity).agg(F.sum("n").alias("_hits"))
    return now.join(then, entity, "left").select(entity, "entries", "hits", (F.col("hits") - F.coalesce("_hits", F.lit(0))).alias("delta"))


def participations(mentions: DataFrame, variants: DataFrame) -> DataFrame:
    """canonical, entry_id, n, names: mentions of all variants (variant, canonical) of a name, summed for each entry."""
    joined = mentions.join(variants.withColumnRenamed("variant", "name"), "name")
    return joined.groupBy("canonical", "entry_id").agg(F.sum("n").alias("n"), F.count_distinct("name").alias("names"))


def intersected(a: DataFrame, b: DataFrame, key: str, floor: int = 0) -> DataFrame:
    """key, weight (the lesser), heavier (a or b; a on a tie): rows of both sides whose lesser weight reaches the floor."""
    both = a.select(key, F.col("weight").alias("_a")).join(b.select(key, F.col("weight").alias("_b")), key)
    least = F.least("_a", "_b")
    return both.where(least >= floor).select(key, least.alias("weight"), F.when(F.col("_a") >= F.col("_b"), "a").otherwise("b").alias("heavier"))


def resolved(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Adds canonical: the name itself if it is canonical, else its single canonical; and candidates: how many there are."""
    per_variant = aliases.groupBy("variant").agg(F.min("canonical").alias("_one"), F.count_distinct("canonical").alias("_n"))
    own = aliases.select(F.col("canonical").alias("_own")).distinct()
    joined = rows.join(per_variant, F.col(name) == F.col("variant"), "left").join(own, F.col(name) == F.col("_own"), "left")
    canonical = F.when(F.col("_own").isNotNull(), F.col(name)).when(F.col("_n") == 1, F.col("_one"))
    count = F.when(F.col("_own").isNotNull(), 1).otherwise(F.coalesce("_n", F.lit(0)))
    return joined.withColumn("canonical", canonical).withColumn("candidates", count.cast("long")).drop("variant", "_one", "_n", "_own")


def task_cast(entries: DataFrame, title: str) -> DataFrame:
    """The entry with exactly this title, else the first whose title contains it."""
    tier = F.when(F.col("title") == title, 0).when(F.col("title").contains(title), 1)
    return entries.withColumn("_tier", tier).where("_tier is not null").orderBy("_tier", "entry_id").limit(1).drop("_tier")


def earliest_names(names: DataFrame, question: str, limit: int = 2) -> DataFrame:
    """Names contained in a question: earliest first, longest on a tie; one within a chosen one is skipped. name, start."""
    at = F.instr(F.lit(question), F.col("name"))
    hits = names.select("name", at.alias("start")).where("start > 0").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("start", (-F.length("name")).alias("_len"), "name")))

    def step(chosen, hit):
        inside = F.exists(chosen, lambda c: (hit["start"] >= c["start"]) & (hit["start"] - hit["_len"] <= c["start"] - c["_len"]))
        return F.when(inside, chosen).otherwise(F.concat(chosen, F.array(hit)))

    kept = F.aggregate("_all", F.array().cast("array<struct<start:int,_len:int,name:string>>"), step)
    found = hits.agg(ordered.alias("_all")).select(F.explode(F.slice(kept, 1, limit)).alias("_h"))  # at most one hit a place of the question
    return found.select("_h.name", "_h.start")


def longest_title(titles: DataFrame, question: str) -> DataFrame:
    """The longest title that the question contains."""
    return titles.where((F.length("title") > 0) & F.lit(question).contains(F.col("title"))).orderBy(F.desc(F.length("title")), "title").limit(1)
