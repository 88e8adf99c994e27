"""A lookup in tiers, from exact titles to what only a related name has; each tier is an equi-join, and the first one that finds decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.normal import normalised


def cascaded_cast(entries: DataFrame, records: DataFrame) -> DataFrame:
    """id, tier, cast (names, in order), source of every entry.

    entries: id, title, act (the part's own title, or null), aliases (array), listed (names of the entry itself, or null). records: key (unique), cast,
    source. Tiers: title, its normal form, the act, its normal form, all records whose key begins with the act or its form (merged by key; a mix of
    sources counts as speaker_lines), an alias (with an act, one that holds it), any alias of an entry with an act (activity_inherited),
    the entry's own list (infobox_text). A record without names stands, but the entry's own list then fills it.
    Keys that begin with an act meet it by their beginnings, of the lengths that acts have.
    """
    known = records.select(F.col("key"), F.struct("key", "cast", "source").alias("r"))
    own = entries.select("id", "title", "act", "aliases")
    form = lambda name: normalised(F.col(name), "key")

    def exact(rows: DataFrame, tier: int) -> DataFrame:
        """rows: id, key, place."""
        return rows.where("key <> ''").join(known, "key").select("id", F.lit(tier).alias("tier"), "place", F.col("r.cast").alias("cast"), F.col("r.source").alias("source"))

    zero = F.lit(0).alias("place")
    found = exact(own.select("id", F.col("title").alias("key"), zero), 1)
    for tier, key in ((2, form("title")), (3, F.col("act")), (4, form("act"))):
        found = found.union(exact(own.select("id", key.alias("key"), zero), tier))

    acts = own.where("act <> ''").select("id", F.explode(F.array_distinct(F.array(F.col("act"), form("act")))).alias("begin"), F.col("act").alias("act"))
    lengths = [row["n"] for row in acts.select(F.length("begin").alias("n")).where("n > 0").distinct().orderBy("n").collect()]  # as many as titles have lengths
    begun = records.select("key", "cast", "source", F.explode(F.array(F.struct(F.col("key").alias("text"), F.lit(False).alias("plain")), F.struct(form("key").alias("text"), F.lit(True).alias("plain")))).alias("k"))
    begun = begun.withColumn("n", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"))).where(F.length("k.text") >= F.col("n"))
    begun = begun.select("key", "cast", "source", F.left("k.text", F.col("n")).alias("begin"), F.col("k.plain").alias("plain"))
    fits = acts.withColumn("plain", F.explode(F.array(F.lit(False), F.lit(True)))).where((F.col("plain") & (F.col("begin") == form("act"))) | (~F.col("plain") & (F.col("begin") == F.col("act"))))
    pairs = fits.join(begun, ["begin", "plain"]).select("id", "key", "cast", "source").distinct()
    merged = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "cast"))).alias("parts"), F.count_distinct("source").alias("n"), F.first("source").alias("one"))
    merged = merged.select("id", F.lit(5).alias("tier"), zero, F.array_distinct(F.flatten(F.transform("parts", lambda x: x["cast"]))).alias("cast"), F.when(F.col("n") == 1, F.col("one")).otherwise("speaker_lines").alias("source"))

    named = own.select("id", "act", F.posexplode("aliases").alias("place", "alias")).select("id", "act", "place", F.trim("alias").alias("alias")).where("alias <> ''")
    holds = F.coalesce(F.col("act"), F.lit("")) == ""
    holds = holds | F.contains("alias", "act") | F.contains(form("alias"), form("act"))
    keys = F.explode(F.array(F.struct((2 * F.col("place")).alias("place"), F.col("alias").alias("key")), F.struct((2 * F.col("place") + 1).alias("place"), form("alias").alias("key"))))
    by_alias = exact(named.where(holds).select("id", keys.alias("k")).select("id", "k.key", "k.place"), 6)
    inherited = exact(named.where(F.coalesce(F.col("act"), F.lit("")) != "").select("id", keys.alias("k")).select("id", "k.key", "k.place"), 7).withColumn("source", F.lit("activity_inherited"))

    every = found.union(merged).union(by_alias).union(inherited)
    best = every.groupBy("id").agg(F.min(F.struct("tier", "place", "cast", "source")).alias("b"))
    joined = entries.select("id", "listed").join(best, "id", "left")
    empty = F.coalesce(F.size("b.cast"), F.lit(0)) <= 0
    own_list = empty & (F.coalesce(F.size("listed"), F.lit(0)) > 0)
    names = F.when(own_list, F.col("listed")).otherwise(F.coalesce("b.cast", F.array().cast("array<string>")))
    source = F.when(own_list, "infobox_text").when(empty, "").otherwise(F.col("b.source"))
    return joined.select("id", F.when(own_list, 8).otherwise(F.col("b.tier")).alias("tier"), names.alias("cast"), source.alias("source"))
