"""Counts that state how complete they are, coverage rates, alias maps and evidence verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.logic import decided


def distinct_with_conflict(rows: DataFrame, id_col: str, content: Sequence[str]) -> DataFrame:
    """One row: n_rows, n_distinct, conflicts (ids of several contents), status exact / ambiguous, count (null when ambiguous).

    Only ids and hashes of contents are shuffled, pre-aggregated.
    """
    hashed = rows.select(F.col(id_col).alias("_id"), F.xxhash64(*content).alias("_h"))
    per_id = hashed.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    total = per_id.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col("_lo") != F.col("_hi")).alias("conflicts"))
    ambiguous = F.col("conflicts") > 0
    return total.select("n_rows", "n_distinct", "conflicts", F.when(ambiguous, "ambiguous").otherwise("exact").alias("status"), F.when(~ambiguous, F.col("n_distinct")).alias("count"))


def member_verdicts(packets: DataFrame, group: Sequence[str], decision: str = "decision") -> DataFrame:
    """One verdict a member: conflict over include over exclude over unknown; include together with exclude is a conflict."""
    has = {name: F.count_if(F.col(decision) == name) > 0 for name in ("conflict", "include", "exclude")}
    verdict = F.when(has["conflict"] | (has["include"] & has["exclude"]), "conflict").when(has["include"], "include").when(has["exclude"], "exclude").otherwise("unknown")
    return packets.groupBy(*group).agg(verdict.alias("verdict"))


def counted_with_status(verdicts: DataFrame, complete: Column, group: Sequence[str] = ()) -> DataFrame:
    """included, excluded, unknown, conflict, status and count: exact when the source is complete and nothing is open, a lower bound when something is included, else missing with a null count."""
    counts = verdicts.groupBy(*group).agg(
        *[F.count_if(F.col("verdict") == name).alias(alias) for name, alias in (("include", "included"), ("exclude", "excluded"), ("unknown", "unknown"), ("conflict", "conflict"))],
        F.bool_and(complete).alias("_complete"),
    )
    status = (
        F.when(F.col("conflict") > 0, "ambiguous")
        .when(F.col("_complete") & (F.col("unknown") == 0), "exact")
        .when(F.col("included") > 0, "lower_bound")
        .otherwise("missing")
    )
    marked = counts.withColumn("status", status)
    return marked.withColumn("count", F.when(F.col("status").isin("exact", "lower_bound"), F.col("included"))).drop("_complete")


def coverage_rates(rows: DataFrame, group: str, classes: dict[str, Column], denominators: dict[str, Column]) -> DataFrame:
    """group, one count a class, and one rate (first class over each denominator, at least 1) rounded to 4 digits."""
    first = next(iter(classes))
    counted = rows.groupBy(group).agg(
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in classes.items()], *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"_{name}") for name, c in denominators.items()]
    )
    rates = [F.round(F.col(first) / F.greatest(F.lit(1), F.col(f"_{name}")), 4).alias(f"rate_{name}") for name in denominators]
    return counted.select(group, *classes, *rates)


def period_alerts(now: DataFrame, before: DataFrame, group: str, rate: str, low: float = 0.80, drop: float = 0.10) -> DataFrame:
    """Groups whose rate is low, or has dropped against the period before."""
    joined = now.join(before.select(group, F.col(rate).alias("_before")), group, "left")
    alert = F.when(F.col(rate) < low, "low").when(F.col("_before") - F.col(rate) > drop, "drop")
    return joined.withColumn("alert", alert).where("alert is not null").select(group, rate, F.col("_before").alias("before"), "alert")


def unambiguous(pairs: DataFrame, key: str, value: str, shortest: int = 2) -> DataFrame:
    """Keys of at least so many characters that map to exactly one value."""
    found = pairs.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_other"))
    return found.where((F.col(value) == F.col("_other")) & (F.length(key) >= shortest)).drop("_other")


def ambiguous(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of several values, with their number; the values themselves are counted in two steps, so a hot key is no single task's list."""
    counts = pairs.select(key, value).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1")


def last_per_key(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The values of the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_row")).select(key, *[F.col(f"_row.{name}").alias(name) for name in columns])


def fill_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, filled, total: how many rows have a non-blank value."""
    one = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), F.col("_n").alias("total")) for c in columns]))
    return one.select(pairs.alias("_p")).select("_p.*")


def member_evidence(entries: DataFrame, name: Column, aliases: Column) -> DataFrame:
    """Adds decision and kind for one member and entry.

    Columns: cast (array or null), cast_complete, speakers (array), text, scope_matches, conflicting (array of names). The first
    rule that holds decides: conflict, metadata, complete list without the name, speaker, inherited scope, mention, missing.
    """
    named = F.array_distinct(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))))
    in_cast = F.coalesce(F.arrays_overlap("cast", named), F.lit(False))
    decision = decided(
        [
            (F.coalesce(F.arrays_overlap("conflicting", named), F.lit(False)), "conflict:alias"),
            (in_cast & F.col("scope_matches"), "include:metadata"),
            (in_cast, "unknown:inherited"),
            (F.coalesce(F.col("cast_complete") & (F.size("cast") > 0), F.lit(False)), "exclude:metadata"),
            (F.coalesce(F.arrays_overlap("speakers", named), F.lit(False)), "include:speaker"),
            (F.exists(named, lambda n: F.col("text").contains(n)), "unknown:mention"),
        ],
        "unknown:missing",
    )
    return entries.withColumn("decision", F.substring_index(decision, ":", 1)).withColumn("kind", F.substring_index(decision, ":", -1))


def graded_evidence(rows: DataFrame, names: Sequence[str], cast: str = "cast", body: str = "body", actions: Sequence[str] = (), weights: dict[str, int] | None = None) -> DataFrame:
    """Adds level (cast, line, action, mention; null: no part in it), weight and mentions.

    An authoritative list decides alone: in it or out. Otherwise a text without a mention has no part; a dialogue line by the
    name outranks an action next to it, and that a mere mention.
    """
    from corpusloom.functions.text import occurrences, speakers

    weights = weights or {"cast": 4, "line": 3, "action": 2, "mention": 1}
    mentions = sum((occurrences(body, n) for n in names[1:]), occurrences(body, names[0]))
    near = F.lit(False)
    for n in names:
        for action in actions:
            near = near | F.regexp_like(F.col(body), F.lit(f"{n}[^\\n。！？]{{0,6}}?{action}"))
    listed = F.coalesce(F.size(cast) > 0, F.lit(False))
    level = (
        F.when(listed & F.arrays_overlap(F.col(cast), F.array(*map(F.lit, names))), "cast")
        .when(~listed & (F.col("mentions") > 0) & F.arrays_overlap(speakers(body), F.array(*map(F.lit, names))), "line")
        .when(~listed & (F.col("mentions") > 0) & near, "action")
        .when(~listed & (F.col("mentions") > 0), "mention")
    )
    ranked = rows.withColumn("mentions", mentions).withColumn("level", level)
    return ranked.withColumn("weight", F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("level")], F.lit(0)))
