"""Versioned facts: nested pages to flat rows, applicability, ambiguity and search."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.logic import EXCLUDED, all_of, bound, version_key, version_state
from corpusloom.functions.text import tokens_for_facts
from corpusloom.operators import ordered

#: Record arrays of a page, in order of their facts.
RECORDS = ("identity_versions", "events", "relations", "affiliation_states", "attribute_records", "memory_records")


def facts_of(pages: DataFrame, records: Sequence[str] = RECORDS) -> DataFrame:
    """One row a record: entity_id, kind, position and the record's fields key, value, introduced_in, valid_to, status, evidence; rejected records are left out."""
    found = None
    for kind in records:
        if kind not in pages.columns:
            continue
        rows = pages.select("entity_id", F.lit(kind).alias("kind"), F.posexplode(kind).alias("position", "_r"))
        rows = rows.select("entity_id", "kind", "position", *[F.col(f"_r.{name}").alias(name) for name in ("key", "value", "introduced_in", "valid_to", "status", "evidence")])
        found = rows if found is None else found.unionByName(rows)
    return found.where(F.coalesce(F.col("status") != "rejected", F.lit(True)))


def with_state(facts: DataFrame, asked_version: Column, historical: bool = False) -> DataFrame:
    """Adds state: superseded facts are excluded unless history is asked for; then the version range decides."""
    superseded = F.when((F.col("status") == "superseded") & F.lit(not historical), EXCLUDED).otherwise("applicable")
    return facts.withColumn("state", bound(F.array(superseded, version_state(asked_version, F.col("introduced_in"), F.col("valid_to"))), all_of))


def attribute_projection(facts: DataFrame) -> DataFrame:
    """entity_id, key, status, value: ambiguous (several applicable values), unresolved, applicable, unknown (only null) or not_applicable."""
    applies = F.col("state") == "applicable"
    grouped = facts.groupBy("entity_id", "key").agg(
        F.min(F.when(applies, F.col("value"))).alias("_lo"),
        F.max(F.when(applies, F.col("value"))).alias("_hi"),
        F.bool_or(F.col("state") == "unresolved").alias("_open"),
        F.bool_or(applies).alias("_any"),
    )
    status = (
        F.when(F.col("_lo") != F.col("_hi"), "ambiguous")
        .when(F.col("_open"), "unresolved")
        .when(F.col("_lo").isNotNull(), "applicable")
        .when(F.col("_any"), "unknown")
        .otherwise("not_applicable")
    )
    return grouped.select("entity_id", "key", status.alias("status"), F.when(status == "applicable", F.col("_lo")).alias("value"))


def merged_by_context(facts: DataFrame, context: Sequence[str]) -> DataFrame:
    """One row for each context: the number of records and their distinct evidence, sorted."""
    return facts.groupBy(*context).agg(F.count(F.lit(1)).alias("records"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"))


def fact_search(facts: DataFrame, question: str, k: int = 6, least: float = 2.0, text: str = "text", entity: str = "entity_name", id_col: str = "fact_id", intents: Sequence[tuple[str, Column]] = (), stop: Sequence[str] = ()) -> DataFrame:
    """The k best facts: the overlap of token multisets, 5 for a named entity, 2 for each matching intent; ties by id."""
    asked = Counter(_tokens(question, stop))
    own = tokens_for_facts(text, list(stop))
    score = F.lit(0.0)
    for token, n in asked.items():
        score = score + F.least(F.size(F.filter(own, _equals(token))), F.lit(n))
    score = score + F.when((F.length(entity) > 0) & F.lit(question).contains(F.col(entity)), 5.0).otherwise(0.0)
    for word, condition in intents:
        if word in question:
            score = score + F.when(condition, 2.0).otherwise(0.0)
    return facts.select(id_col, score.alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), id_col).limit(k)


def _equals(token: str):
    return lambda x: x == token


def _tokens(text: str, stop: Sequence[str]) -> list[str]:
    import re

    found: list[str] = []
    for run in re.findall(r"[a-z0-9_.]+|[一-鿿]+", text.lower()):
        found += [run[i : i + 2] for i in range(len(run) - 1)] if re.fullmatch(r"[一-鿿]{2,}", run) else [run]
    return [x for x in found if x not in stop]


def resolve_versions(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds version_id and outcome for (numeric, label) against a registry (version_id, numeric, label, aliases).

    One key: found or unknown. Two keys: both must find one entry; different entries are a mismatch, one unknown side leaves it unresolved.
    """
    labels = registry.select("version_id", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_label"))
    by_label = labels.groupBy("_label").agg(F.min("version_id").alias("_by_label"))
    by_number = registry.where("numeric is not null").groupBy(F.col("numeric").alias("_numeric")).agg(F.min("version_id").alias("_by_number"))
    joined = asked.join(by_label, F.col("label") == F.col("_label"), "left").join(by_number, F.col("numeric") == F.col("_numeric"), "left")
    both = F.col("label").isNotNull() & F.col("numeric").isNotNull()
    outcome = (
        F.when(both & F.col("_by_label").isNotNull() & F.col("_by_number").isNotNull(), F.when(F.col("_by_label") == F.col("_by_number"), "matched").otherwise("mismatch"))
        .when(both, "unresolved")
        .when(F.coalesce("_by_label", "_by_number").isNotNull(), "matched")
        .otherwise("unknown")
    )
    version = F.when(outcome == "matched", F.coalesce("_by_label", "_by_number"))
    return joined.select(*asked.columns, version.alias("version_id"), outcome.alias("outcome"))


def registry_violations(registry: DataFrame) -> DataFrame:
    """key, problem: duplicate ids, labels or numbers, and versions that a later one (in declared order) falls below."""
    problems = None
    for column in ("version_id", "label", "numeric"):
        part = registry.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key", F.lit(f"duplicate_{column}").alias("problem"))
        problems = part if problems is None else problems.unionByName(part)
    versions = registry.where("numeric is not null").withColumn("_n", version_key(F.col("numeric")))
    numbered = ordered.least_after(versions, ["order"], F.col("_n"), "_least")
    wrong = numbered.where(F.col("_n") > F.col("_least")).select(F.col("version_id").alias("key"), F.lit("order").alias("problem"))
    return problems.unionByName(wrong)


def broken_references(rows: DataFrame, id_col: str, refs: str, known: DataFrame, known_id: str) -> DataFrame:
    """id, ref: references without a target."""
    return rows.select(id_col, F.explode(refs).alias("ref")).join(known.select(F.col(known_id).alias("ref")), "ref", "left_anti").select(id_col, "ref")
