"""What changed between two inputs and what has to follow: fingerprints, events, dirty pages and plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprints(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, fingerprint: SHA-256 over the columns as JSON, nulls included."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return rows.select(key, F.sha2(body.cast("binary"), 256).alias("fingerprint"))


def change_events(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, event: added, removed or modified; equal rows give none."""
    both = old.select(key, F.col("fingerprint").alias("_a")).join(new.select(key, F.col("fingerprint").alias("_b")), key, "full_outer")
    event = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return both.select(key, event.alias("event")).where("event is not null")


def dependencies(pages: DataFrame, page: str, references: str, known: DataFrame, known_id: str) -> tuple[DataFrame, DataFrame]:
    """(consumer, dependency) for references that resolve, and (consumer, ref) diagnostics for the others."""
    refs = pages.select(F.col(page).alias("consumer"), F.explode(references).alias("dependency")).distinct()
    ids = known.select(F.col(known_id).alias("dependency")).distinct()
    return refs.join(ids, "dependency").select("consumer", "dependency"), refs.join(ids, "dependency", "left_anti").select("consumer", F.col("dependency").alias("ref"))


def freshness(pages: DataFrame, page: str, baseline: DataFrame, observed: DataFrame, dirty: DataFrame) -> DataFrame:
    """page, status: unknown without baseline or observation, stale if dirty or its fingerprint differs, else fresh."""
    joined = (
        pages.select(page)
        .join(baseline.select(page, F.col("fingerprint").alias("_a")), page, "left")
        .join(observed.select(page, F.col("fingerprint").alias("_b")), page, "left")
        .join(dirty.select(page, F.lit(True).alias("_dirty")).distinct(), page, "left")
    )
    status = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown").when(F.col("_dirty") | (F.col("_a") != F.col("_b")), "stale").otherwise("fresh")
    return joined.select(page, status.alias("status"))


def field_impacts(fields: DataFrame, dirty: DataFrame) -> DataFrame:
    """page, field, dependencies (sorted) for fields (page, field, dependency) that a dirty node reaches."""
    hit = fields.join(dirty.select(F.col("node").alias("dependency")).distinct(), "dependency")
    return hit.groupBy("page", "field").agg(F.sort_array(F.collect_set("dependency")).alias("dependencies"))


def rebuild_plan(pages: DataFrame, page: str, dirty: DataFrame, full: Column | None = None) -> DataFrame:
    """page, action: rebuild or keep, and mode of the whole plan: none, single, several or full."""
    marked = pages.select(page).join(dirty.select(page, F.lit(True).alias("_dirty")).distinct(), page, "left")
    total = marked.agg(F.count("_dirty").alias("_n"))
    everything = full if full is not None else F.lit(False)
    mode = F.when(everything, "full").when(F.col("_n") == 0, "none").when(F.col("_n") == 1, "single").otherwise("several")
    action = F.when(everything | F.col("_dirty"), "rebuild").otherwise("keep")
    return marked.join(F.broadcast(total)).select(page, F.coalesce(action, F.lit("keep")).alias("action"), mode.alias("mode"))  # total is one row


def bound_citations(spans: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    """Adds quote, citation_id and status for spans (source, start, end, quote_sha256): bound, stale (digest differs), partial (beyond the text), missing."""
    joined = spans.join(sources.select(source, F.col("text").alias("_text")), source, "left")
    quote = F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start"))
    digest = F.sha2(quote.cast("binary"), 256)
    status = F.when(F.col("_text").isNull(), "missing").when(F.col("end") > F.length("_text"), "partial").when(digest == F.col("quote_sha256"), "bound").otherwise("stale")
    identity = F.sha2(F.to_json(F.struct(source, "start", "end", "quote_sha256")).cast("binary"), 256)
    return joined.withColumn("quote", quote).withColumn("status", status).withColumn("citation_id", identity).drop("_text")


def missing_names(evidence: Column, answer: Column, most: int = 12) -> Column:
    """Names of the evidence that the answer does not contain, in order."""
    return F.slice(F.filter(evidence, lambda n: ~answer.contains(n)), 1, most)


def unverified(fragments: Column, context: Column) -> Column:
    """Fragments that the context does not contain, once case, white space and punctuation are gone."""
    from corpusloom.functions.text import squeezed

    body = squeezed(context)
    return F.filter(fragments, lambda f: ~body.contains(squeezed(f)))
