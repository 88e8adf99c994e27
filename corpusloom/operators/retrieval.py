"""Keyword and vector retrieval, rank fusion and the figures that judge them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import occurrences, overlapping_occurrences
from corpusloom.operators import ordered
from corpusloom.session import ensure_checkpoint_dir

#: Query vectors that are broadcast at a time; more are searched block by block.
QUERY_BLOCK = 1024
#: Queries of a block whose scores a worker holds at a time.
QUERY_SLICE = 64
# Relevance thresholds by similarity backend.
THRESHOLDS = {"bge-m3": {"hard": 0.50, "hard_with_keyword": 0.42, "weak": 0.60}}


def bigrams(query: str) -> list[str]:
    """Distinct character pairs, in order of appearance."""
    return list(dict.fromkeys(query[i : i + 2] for i in range(len(query) - 1)))


def _tf(text: Column, token: str) -> Column:
    return overlapping_occurrences(text, token) if token[0] == token[1] else occurrences(text, token)


def bm25(docs: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """The k best rows for a query: id and score, above 0, ties by id.

    Tokens are character pairs. A document's length counts pairs while the mean counts characters, as in the scheme that is
    matched. The texts are read and counted once, into narrow rows in the shared folder; one pass over these sums document
    frequencies into a single row, which then meets them again. Nothing but the k best rows is shuffled.
    """
    tokens = bigrams(query)
    if not tokens:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    body = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), F.length(body).alias("_chars"), *[_tf(body, t).alias(f"_tf{i}") for i, t in enumerate(tokens)])
    ensure_checkpoint_dir(docs.sparkSession)
    counted = counted.checkpoint()
    totals = counted.agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_chars").alias("_mean"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(tokens))]
    )
    both = counted.join(F.broadcast(totals))  # one row
    norm = k1 * (1 - b + b * F.greatest(F.col("_chars") - 1, F.lit(0)) / F.col("_mean"))
    score = F.lit(0.0)
    for i in range(len(tokens)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        score = score + F.when(df > 0, F.ln(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + norm)).otherwise(0.0)
    scored = both.select(id_col, F.round(score, digits).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def unit(vector: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", within: Sequence[str] = (), keep_self: bool = False, digits: int = 6) -> DataFrame:
    """For each query row (query_id, query vector) its k nearest rows by cosine, per group of `within`: rank 1 is best, ties by id.

    Queries are a stated set. They meet all rows block by block (QUERY_BLOCK at a time), each block a bounded broadcast and one matrix
    product a batch of rows; every batch hands on about k rows a query. Vectors that are null or of another length are left out.
    """
    n = queries.count()
    blocks = max(1, math.ceil(n / QUERY_BLOCK))
    kinds = dict(vectors.dtypes)
    names = [id_col, *within]
    asked = queries.select("query_id", unit(F.col("query")).alias("_q")).where("_q is not null")
    best = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        found = part.collect()  # a block of the stated queries
        if not found:
            continue
        ids, matrix = [row["query_id"] for row in found], np.array([row["_q"] for row in found])
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
        rows = vectors.where(F.size(vector_col) == matrix.shape[1]).select(*names, unit(F.col(vector_col)).alias("_v"))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            """The best of each batch for each query, and what is as good after rounding."""
            ids, matrix = shared.value
            asked = pa.array(ids)
            for batch in batches:
                groups = pa.Table.from_batches([batch]).select(list(within)).to_pylist() if within else []
                of: dict[tuple, list[int]] = {}
                for i, group in enumerate(groups):
                    of.setdefault(tuple(group.values()), []).append(i)
                values = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for first in range(0, len(ids), QUERY_SLICE):
                    scores = values @ matrix[first : first + QUERY_SLICE].T
                    for chosen in of.values() if within else [range(batch.num_rows)] if batch.num_rows else []:
                        chosen = np.array(chosen)
                        own = scores[chosen]
                        most = min(k, len(chosen) - 1)  # one more than k, as the row itself may be among them
                        least = np.partition(own, len(chosen) - 1 - most, axis=0)[len(chosen) - 1 - most]
                        row, column = np.nonzero(own >= least - 10.0**-digits)
                        columns = [batch.column(i).take(pa.array(chosen[row])) for i in range(len(names))]
                        yield pa.RecordBatch.from_arrays([asked.take(pa.array(first + column)), *columns, pa.array(own[row, column])], ["query_id", *names, "score"])

        schema = ", ".join([f"query_id {dict(queries.dtypes)['query_id']}", *(f"`{name}` {kinds[name]}" for name in names), "score double"])
        scored = rows.mapInArrow(nearest, schema).withColumn("score", F.round("score", digits))
        if not keep_self:
            scored = scored.where(F.col(id_col) != F.col("query_id"))
        order = Window.partitionBy("query_id", *within).orderBy(F.desc("score"), id_col)
        own = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = own if best is None else best.unionByName(own)
    if best is None:
        empty = vectors.select(*names).limit(0).crossJoin(queries.select("query_id").limit(0))
        return empty.select("query_id", *names, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return best


def global_top(per_group: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """The k best of each query over all groups."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return per_group.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse_ranks(routes: Sequence[DataFrame], key: str = "key", k: int = 60, mode: str = "sum", digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of routes (key, rank from 1): key, score, best first; ties by route and rank of first appearance.

    mode `sum` adds a term for each row of a key, `max` one for each route.
    """
    every = None
    for i, route in enumerate(routes):
        part = route.select(F.col(key), F.lit(i).alias("_route"), F.col("rank").alias("_rank"))
        every = part if every is None else every.unionByName(part)
    term = (1.0 / (k + F.col("_rank"))).alias("_term")
    rows = every.select(key, "_route", "_rank", term)
    if mode == "max":
        rows = rows.groupBy(key, "_route").agg(F.max("_term").alias("_term"), F.min("_rank").alias("_rank"))
    fused = rows.groupBy(key).agg(F.round(F.sum("_term"), digits).alias("score"), F.min(F.struct("_route", "_rank")).alias("_first"))
    return fused.orderBy(F.desc("score"), "_first").select(key, "score")


def relevance(scores: DataFrame, keyword_hits: Column, backend: str, query_col: str = "query_id") -> DataFrame:
    """query, top1, delta to the second, verdict: hard, hard_with_keyword, weak, strong, or uncalibrated for an unknown backend."""
    order = Window.partitionBy(query_col).orderBy(F.desc("score"))
    ranked = scores.withColumn("_second", F.lead("score").over(order)).withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    top, limits = F.col("score"), THRESHOLDS.get(backend)
    verdict = F.lit("uncalibrated")
    if limits:
        verdict = (
            F.when((keyword_hits == 0) & (top < limits["hard"]), "hard")
            .when((keyword_hits > 0) & (top < limits["hard_with_keyword"]), "hard_with_keyword")
            .when((keyword_hits == 0) & (top < limits["weak"]), "weak")
            .otherwise("strong")
        )
    delta = F.coalesce(F.round(top - F.col("_second"), 6), F.lit(0.0))
    return ranked.select(query_col, top.alias("top1"), delta.alias("delta"), verdict.alias("verdict"))


def overlap_at(left: Column, right: Column, k: int) -> Column:
    """Share of k that the first k distinct keys of both lists have in common; divides by k even for short lists."""
    a, b = F.slice(F.array_distinct(left), 1, k), F.slice(F.array_distinct(right), 1, k)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.lit(float(k)))


def coverage(found: Column, required: Column) -> tuple[Column, Column]:
    """(share of the required terms that were found, 1.0 if none are required; the missing ones)."""
    missing = F.array_except(required, found)
    share = F.when(F.size(required) == 0, 1.0).otherwise(1.0 - F.size(missing) / F.size(F.array_distinct(required)))
    return share, missing


def best_in_group(scored: DataFrame, group: str, index: str) -> DataFrame:
    """The row of the highest score of each group, the lowest index on a tie."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), index)
    return scored.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def scored_search(entries: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """entry_id, title, score: 100 for the title, 80 in it, 70 in an alias, 40 in the story, 20 if all words occur; best first, then by title and id."""
    kw = keyword.strip()
    everything = F.concat(F.coalesce("title", F.lit("")), F.coalesce("story_text", F.lit("")))
    terms = [t for t in kw.replace(",", " ").replace("，", " ").replace("、", " ").split() if t]
    all_terms = F.lit(bool(terms))
    for term in terms:
        all_terms = all_terms & everything.contains(term)
    score = (
        F.when(F.col("title") == kw, 100)
        .when(F.col("title").contains(kw), 80)
        .when(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.contains(kw)), 70)
        .when(F.col("story_text").contains(kw), 40)
        .when(all_terms, 20)
        .otherwise(0)
    )
    found = entries.select("entry_id", "title", score.alias("score")).where((F.col("score") > 0) & F.lit(bool(kw)))
    return found.orderBy(F.desc("score"), "title", "entry_id").limit(limit)


def capped_candidates(hits: DataFrame, source: str, ordinal: str, per_source: int, total: int) -> DataFrame:
    """The first rows of each source, and of all of them."""
    order = Window.partitionBy(source).orderBy(ordinal)
    return hits.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_source).drop("_rn").orderBy(ordinal).limit(total)


def promoted(hits: DataFrame, exact: Column, ordinal: str) -> DataFrame:
    """Exact rows first; the order is kept otherwise. Adds `place`, from 1."""
    return ordered.places(hits, [F.when(exact, 0).otherwise(1), ordinal])


def reranked_or_all(hits: DataFrame, ordinal: str, n: int = 10, verdicts: DataFrame | None = None, floor: float = 0.25) -> DataFrame:
    """Without verdicts (ordinal, relevance) the first n in order; with them those at or above the floor, best first."""
    if verdicts is None:
        return hits.orderBy(ordinal).limit(n)
    return hits.join(verdicts, ordinal).where(F.col("relevance") >= floor).orderBy(F.desc("relevance"), ordinal).limit(n)


def evaluation(cases: DataFrame) -> DataFrame:
    """One row over cases (hits_a, hits_b, required, overlap): macro and micro recall of both, wins, ties, mean overlap; 0.0 for none."""

    def share(hits: str) -> Column:
        return F.when(F.col("required") == 0, 1.0).otherwise(F.col(hits) / F.col("required"))

    def micro(hits: str) -> Column:
        return F.coalesce(F.round(F.sum(hits) / F.sum("required"), 6), F.lit(0.0))

    a, b = share("hits_a"), share("hits_b")
    return cases.agg(
        F.coalesce(F.round(F.avg(a), 6), F.lit(0.0)).alias("macro_a"),
        F.coalesce(F.round(F.avg(b), 6), F.lit(0.0)).alias("macro_b"),
        micro("hits_a").alias("micro_a"),
        micro("hits_b").alias("micro_b"),
        F.count_if(a > b).alias("wins_a"),
        F.count_if(b > a).alias("wins_b"),
        F.count_if(a == b).alias("ties"),
        F.coalesce(F.round(F.avg("overlap"), 6), F.lit(0.0)).alias("mean_overlap"),
    )
