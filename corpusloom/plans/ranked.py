"""Sections 2.5, 2.6 and 2.7: windows, ranking, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import logic, text
from corpusloom.operators import fuzzy, greedy, mentions, ranking, reconcile, retrieval
from corpusloom.plans.base import query, table
from corpusloom.sources import models

PHRASE = "the and"


def _bm25_sql(limit: int) -> str:
    grams = ", ".join(f"('{g}')" for g in retrieval.bigrams(PHRASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents), q(t) AS (VALUES {grams}),
    s AS (SELECT count(*) AS total, avg(n) AS mean FROM d), tf AS (SELECT doc_id, n, t, len(string_split(text, t)) - 1 AS f FROM d, q), df AS (SELECT t, count(*) FILTER (WHERE f > 0) AS c FROM tf GROUP BY t)
    SELECT doc_id, round(sum(ln(1 + (total - c + 0.5) / (c + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * greatest(n - 1, 0) / mean))), 6) AS score
    FROM tf JOIN df USING (t), s GROUP BY doc_id HAVING round(sum(ln(1 + (total - c + 0.5) / (c + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * greatest(n - 1, 0) / mean))), 6) > 0 ORDER BY score DESC, doc_id LIMIT {limit}"""


def _knn_sql(k: int, where: str, self: bool = False, group: str = "") -> str:
    keep = "" if self else "AND q.vec_id <> e.vec_id"
    part = f"q.vec_id{', e.label' if group else ''}"
    return f"""(SELECT q.vec_id AS query_id, e.vec_id{', e.label' if group else ''}, round(list_dot_product(e.u, q.u), 6) AS score, row_number() OVER (PARTITION BY {part} ORDER BY round(list_dot_product(e.u, q.u), 6) DESC, e.vec_id) AS rank
    FROM u e JOIN u q ON {where} {keep} QUALIFY rank <= {k})"""


UNIT = "WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)"


@query("2.6.6", _bm25_sql(10))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), PHRASE, 10)


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query("2.6.1", f"{UNIT} SELECT * FROM {_knn_sql(5, 'q.vec_id % 20 = 0')}")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.exact_knn(vectors, _queries(vectors), 5)


@query("2.6.2", f"{UNIT}, g AS {_knn_sql(3, 'q.vec_id % 20 = 0', group='label')} SELECT query_id, vec_id, label, score, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM g) WHERE place <= 5")
def knn_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each collection, then of all."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.global_top(retrieval.exact_knn(vectors, _queries(vectors), 3, within=["label"]), 5)


@query("2.6.3 2.1.24", f"{UNIT} SELECT query_id, vec_id, score FROM {_knn_sql(5, 'q.vec_id = 7')} WHERE score >= 0.2")
def knn_with_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor applies after the limit."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.exact_knn(vectors, asked, 5).where("score >= 0.2").select("query_id", "vec_id", "score")


@query("2.5.5", f"{UNIT}, k AS {_knn_sql(2, 'q.vec_id % 20 = 0')} SELECT query_id, max(score) AS top1, round(max(score) - min(score), 6) AS delta, CASE WHEN max(score) < 0.42 THEN 'hard_with_keyword' ELSE 'strong' END AS verdict FROM k GROUP BY query_id")
def relevance_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.relevance(retrieval.exact_knn(vectors, _queries(vectors), 2), F.lit(1), "bge-m3")


RRF = """WITH kw AS (SELECT source AS key, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en' QUALIFY rank <= 30), vec AS (SELECT source AS key, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents WHERE lang = 'de' QUALIFY rank <= 30)
    SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM vec) GROUP BY key"""


def _routes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), "doc_id", "n_chars", "lang")
    longest = docs.where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(30)
    shortest = docs.where("lang = 'de'").orderBy("n_chars", "doc_id").limit(30)
    from pyspark.sql import Window

    return [longest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))), shortest.withColumn("rank", F.row_number().over(Window.orderBy("n_chars", "doc_id")))]


@query("2.5.1 2.5.2", RRF)
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse_ranks(_routes(spark, sf_dir))


HYBRID = f"""WITH kw AS (SELECT doc_id AS key, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_bm25_sql(30)})),
    vec AS (SELECT vec_id AS key, rank FROM ({UNIT} SELECT * FROM {_knn_sql(30, 'q.vec_id = 7')}) WHERE score >= 0.1)
    SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM vec) GROUP BY key"""


@query("2.11.4 2.5.1", HYBRID)
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword route and a vector route with a floor, fused by rank."""
    from pyspark.sql import Window

    words = retrieval.bm25(table(spark, sf_dir, "documents"), PHRASE, 30)
    words = words.select(F.col("doc_id").alias("key"), F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"))  # thirty rows
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = retrieval.exact_knn(vectors, asked, 30).where("score >= 0.1").select(F.col("vec_id").alias("key"), "rank")
    return retrieval.fuse_ranks([words, near])


# Rows of a group in order (rn), and for some (v) the earlier rows that would cover it (us): a row stays if none of these stays.
FOLD = """, r AS (SELECT g, 1 AS rn, [1]::BIGINT[] AS kept FROM d WHERE rn = 1
    UNION ALL SELECT d.g, d.rn, CASE WHEN list_has_any(kept, coalesce(us, [])) THEN kept ELSE list_append(kept, d.rn) END FROM r JOIN d ON d.g = r.g AND d.rn = r.rn + 1 LEFT JOIN e ON e.g = d.g AND e.v = d.rn),
    k AS (SELECT g, unnest(arg_max(kept, rn)) AS rn FROM r GROUP BY g)"""


@query(
    "2.5.12",
    r"""WITH RECURSIVE n AS (SELECT conv_id AS g, turn, regexp_replace(regexp_replace(text, '\{\{[^{}]*\}\}', ' ', 'g'), '[^\p{L}\p{N}_]+', '', 'g') AS b FROM conversations WHERE text IS NOT NULL),
    d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY length(b) DESC, turn) AS rn, list_transform(range(0, greatest(length(b) - 24, 0), 24), lambda i: substring(b, i + 1, 24)) AS f FROM n),
    e AS (SELECT s.g, s.rn AS v, list(o.rn) AS us FROM d s JOIN d o ON o.g = s.g AND o.rn < s.rn AND length(s.b) >= 96 AND length(o.b) >= 1.2 * length(s.b) AND 2 * len(list_filter(s.f, lambda x: contains(o.b, x))) >= len(s.f) GROUP BY ALL)"""
    + FOLD
    + " SELECT g AS conv_id, turn FROM k JOIN d USING (g, rn)",
)
def uncovered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation that no longer one covers."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    return greedy.without_covered(turns, "conv_id", "turn", "text").select("conv_id", "turn")


@query("2.5.3", "SELECT source, arg_min(doc_id, doc_id) AS doc_id, any_value(score) AS score FROM (SELECT source, doc_id, n_chars / 1000 AS score, max(n_chars / 1000) OVER (PARTITION BY source) m FROM documents) WHERE score = m GROUP BY source")
def best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.best_in_group(table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") / 1000).alias("score")), "source", "doc_id")


@query(
    "2.5.4",
    """SELECT doc_id, CASE WHEN rn <= 4 THEN greatest(0, least(want, 8000 - used)) ELSE 0 END::BIGINT AS granted FROM (SELECT doc_id, least(n_chars, 2800) AS want, row_number() OVER w AS rn, coalesce(sum(least(n_chars, 2800)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))""",
)
def shared_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.shared_budget(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars").select("doc_id", "granted")


@query("2.5.6", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 = 0 THEN 999 ELSE value END, event_id) <= 6")
def first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By version (missing last), then by order; the first and the next five."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("version", F.when(F.col("event_id") % 3 == 0, 999.0).otherwise(F.col("value")))
    return ranking.first_rows(rows, ["user_id"], ["version", "event_id"], 6).select("event_id", "user_id")


@query(
    "2.5.7",
    """SELECT event_id, method, row_number() OVER (PARTITION BY user_id ORDER BY CASE method WHEN 'title' THEN o WHEN 'time' THEN epoch_us(ts)::DOUBLE END, event_id) AS place FROM (SELECT *, CASE WHEN count(o) OVER p = count(*) OVER p THEN 'title' WHEN count(DISTINCT ts) OVER p = count(*) OVER p THEN 'time' ELSE 'input' END AS method
    FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 1000 - event_id % 1000 END AS o FROM events) WINDOW p AS (PARTITION BY user_id))""",
)
def assigned_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("o", F.when(F.col("user_id") % 2 == 0, 1000 - F.col("event_id") % 1000))
    return ranking.assigned_order(rows, "user_id", "o", "ts", "event_id").select("event_id", "method", "place")


@query("2.5.8", "SELECT min(p_partkey) AS p_partkey, split_part(p_name, ' ', 1) AS base FROM part GROUP BY 2")
def collapsed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_rows(table(spark, sf_dir, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("base")), ["base"], ["p_partkey"])


@query(
    "2.5.9",
    """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER w AS rn, sum(least(n_chars, 6000)) OVER w AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE rn = 1 OR (rn <= 30 AND used <= 20000)""",
)
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.within_budget(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", F.col("n_chars"), 30, 20000, 6000).select("doc_id", "source")


@query(
    "2.5.11",
    r"""WITH RECURSIVE d AS (SELECT source AS g, doc_id AS id, substring(text, 1, 12) AS title, length(text) AS size, list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS p,
    row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn FROM documents),
    e AS (SELECT b.g, b.rn AS v, list(a.rn) AS us FROM d a JOIN d b ON a.g = b.g AND a.rn < b.rn AND length(b.title) >= 3 AND (contains(a.title, b.title) OR (length(a.title) >= 3 AND contains(b.title, a.title)))
    AND b.size >= 0.6 * a.size AND len(list_intersect(a.p, b.p)) >= 0.7 * len(list_distinct(list_concat(a.p, b.p))) AND len(b.p) > 0 GROUP BY ALL)"""
    + FOLD
    + " SELECT g AS source, id FROM k JOIN d USING (g, rn)",
)
def suppressed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression among all texts of each source: titles are their heads, profiles all their words."""
    profile = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.substring("text", 1, 12).alias("title"), F.length("text").alias("size"), profile.alias("profile"))
    return greedy.without_variants(docs, "source").select("source", "id")


@query("2.5.13 2.5.14", "SELECT p_name, arg_max(p_partkey, p_size * 1000000 - p_partkey) AS p_partkey FROM part GROUP BY p_name")
def best_per_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.graph import best_per_title as best

    return best(table(spark, sf_dir, "part"), F.col("p_name"), [F.desc("p_size"), F.col("p_partkey")]).select("p_name", "p_partkey")


@query(
    "2.5.15",
    """SELECT event_id FROM (SELECT event_id, event_type, first_value(event_type) OVER w AS f, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE rn = 1 OR event_type <> f""",
)
def distinct_on_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.distinct_on_first(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"]).select("event_id")


@query(
    "2.5.16",
    """SELECT conv_id, turn FROM (SELECT *, max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE last IS NULL OR turn > last""",
)
def turns_since_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.since_last(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn")


@query("2.5.16 2.10.3", "SELECT user_id, (count(*) FILTER (WHERE event_type = 'error' AND (good IS NULL OR event_id > good)))::BIGINT AS run FROM (SELECT *, max(event_id) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id) AS good FROM events) GROUP BY user_id")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.trailing_run(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error")


@query("2.5.17", "SELECT conv_id, turn, left(text, 300) AS head FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.last_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", F.left("text", F.lit(300)).alias("head"))


@query(
    "2.6.4 2.8.12 2.11.1",
    """SELECT p_partkey AS entry_id, p_name AS title, CASE WHEN p_name = 'blue bolt' THEN 100 WHEN contains(p_name, 'blue bolt') THEN 80 WHEN contains(p_brand, 'blue bolt') THEN 70 WHEN contains(p_type, 'blue bolt') THEN 40 ELSE 20 END AS score FROM part
    WHERE contains(p_name, 'blue bolt') OR (contains(p_name || p_type, 'blue') AND contains(p_name || p_type, 'bolt')) ORDER BY score DESC, title, entry_id LIMIT 20""",
)
def scored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("title"), F.array("p_brand").alias("aliases"), F.col("p_type").alias("story_text"))
    return retrieval.scored_search(entries, "blue bolt")


@query("2.6.7 2.6.8", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10")
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No reranker answers, so the order stays."""
    return retrieval.reranked_or_all(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 10)


def _overlap():
    """A model that scores a text by the share of asked words that it holds."""
    return lambda rows: [sum(word in (text or "") for word in asked.split()) / len(asked.split()) for asked, text in rows]


@query(
    "2.6.7",
    """WITH h AS (SELECT doc_id, text FROM documents WHERE contains(text, 'the') OR contains(text, 'und')),
    r AS (SELECT doc_id, (contains(text, 'the')::INT + contains(text, 'und')::INT + contains(text, 'thand')::INT + contains(text, 'über')::INT + contains(text, 'zzzz')::INT) / 5 AS relevance FROM h)
    SELECT doc_id, relevance FROM r WHERE relevance >= 0.4 ORDER BY relevance DESC, doc_id LIMIT 25""",
)
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits scored by a model; those at or above a floor, best first."""
    hits = table(spark, sf_dir, "documents").where(F.col("text").contains("the") | F.col("text").contains("und")).select("doc_id", F.lit("the und thand über zzzz").alias("asked"), "text")
    verdicts = models.answered(hits, ["asked", "text"], _overlap, "double", "relevance").select("doc_id", "relevance")
    return retrieval.reranked_or_all(hits.select("doc_id"), "doc_id", 25, verdicts, 0.4).select("doc_id", "relevance")


@query("2.6.9 2.6.18", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE contains(text, 'the')) WHERE rn <= 5 ORDER BY doc_id LIMIT 60")
def per_source_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").where(F.col("text").contains("the")).select("doc_id", "source")
    return retrieval.capped_candidates(hits, "source", "doc_id", 5, 60)


@query("2.6.10", "SELECT n_nationkey, row_number() OVER (ORDER BY CASE WHEN n_name IN ('NATION_7','NATION_3') THEN 0 ELSE 1 END, n_nationkey) AS place FROM nation")
def promoted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.promoted(table(spark, sf_dir, "nation"), F.col("n_name").isin("NATION_7", "NATION_3"), "n_nationkey").select("n_nationkey", "place")


@query(
    "2.6.12 2.6.13 2.6.17",
    """SELECT kw, doc_id, hits FROM (SELECT kw, doc_id, (len(string_split(text, kw)) - 1)::BIGINT AS hits, row_number() OVER (PARTITION BY kw ORDER BY len(string_split(text, kw)) DESC, doc_id) rn FROM documents, (VALUES ('thand'), ('über'), ('ción')) k(kw) WHERE len(string_split(text, kw)) - 1 >= 2) WHERE rn <= 5""",
)
def keyword_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = mentions.counted_names(table(spark, sf_dir, "documents"), ["thand", "über", "ción"]).where("n >= 2")
    return ranking.first_rows(hits, ["name"], [F.desc("n"), "doc_id"], 5).select(F.col("name").alias("kw"), "doc_id", F.col("n").alias("hits"))


@query("2.6.14", "SELECT p_name AS title FROM (SELECT DISTINCT p_name FROM part) WHERE contains('where is the large blue bolt now', p_name) ORDER BY length(p_name) DESC, p_name LIMIT 1")
def longest_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.longest_title(table(spark, sf_dir, "part").select(F.col("p_name").alias("title")).distinct(), "where is the large blue bolt now")


ASKED = "show me a small ring, a red widget and a large blue bolt"


@query(
    "2.6.15 2.9.33",
    f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[2] FROM part), h AS (SELECT name, instr('{ASKED}', name) AS start, length(name) AS n FROM n WHERE contains('{ASKED}', name))
    SELECT name, start::INT AS start FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.name <> a.name AND b.start <= a.start AND b.start + b.n >= a.start + a.n) ORDER BY a.start, name LIMIT 2""",
)
def earliest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the dictionary and their second words, which whole names contain."""
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.explode(F.array("p_name", F.element_at(F.split("p_name", " "), 2))).alias("name")).distinct()
    return mentions.earliest_names(names, ASKED, 2).select("name", "start")


@query("2.6.16", None)
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.similar_names(table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey")), "p_partkey", "p_name", "blu bolts")


#: Letters, and others that sound like them.
SOUNDS = ("aeioudtgklr", "eaoeitdkgrl")


@query("2.6.16", None)
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt names (other letters of a like sound, no vowels) and names of suppliers, against all names of parts and their words."""
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.explode(F.concat(F.array("p_name"), F.split("p_name", " "))).alias("name"))
    missed = names.select(F.explode(F.array(F.translate("name", *SOUNDS), F.regexp_replace("name", "[aeiou]", ""))).alias("asked"))
    suppliers = table(spark, sf_dir, "supplier").select("s_name")
    return fuzzy.similar_to_each(missed.union(suppliers), "asked", names, "name", alike=("aeiou", "dt", "gk", "lr"))


@query(
    "2.6.19 2.9.30",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 + o_orderkey % 999 END::INT AS n FROM orders""",
)
def chinese_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals written from numbers up to 999 and read again; digits for every fifth, no numeral for every seventh row."""
    n = (F.col("o_orderkey") % 999 + 1).cast("int")
    digit = F.split(F.lit(",一,二,三,四,五,六,七,八,九"), ",")
    hundreds, tens, ones = (F.floor(n / 100).cast("int"), F.floor(n / 10).cast("int") % 10, n % 10)
    ten = F.when(tens == 0, F.when((hundreds > 0) & (ones > 0), "零").otherwise("")).otherwise(F.concat(F.when((tens == 1) & (hundreds == 0), "").otherwise(digit[tens]), F.lit("十")))
    written = F.concat(F.when(hundreds == 0, "").otherwise(F.concat(digit[hundreds], F.lit("百"))), ten, digit[ones])
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key, F.when(key % 7 == 0, "x").when(key % 5 == 0, n.cast("string")).otherwise(written).alias("ordinal"))
    return rows.select("o_orderkey", text.chinese_number("ordinal").alias("n"))


@query("2.6.20", "SELECT doc_id, least(greatest(doc_id % 5, 1), greatest(1, ceil(length(text) / 5000))::INT)::INT AS page, greatest(1, ceil(length(text) / 5000))::INT AS pages, sha256(substring(text, ((least(greatest(doc_id % 5, 1), greatest(1, ceil(length(text) / 5000))) - 1) * 5000 + 1)::BIGINT, 5000)) AS body FROM documents")
def paged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.chunking import paged

    asked = table(spark, sf_dir, "documents").withColumn("page", (F.col("doc_id") % 5).cast("int"))
    return paged(asked, "doc_id", "text", 5000).withColumn("body", F.sha2(F.col("body").cast("binary"), 256))


@query(
    "2.7.1 2.7.2 2.7.3",
    """SELECT 'part' AS branch, p_name AS name FROM part WHERE p_size = 1 UNION ALL SELECT 'nation', n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT DISTINCT 'brand', p_brand FROM part WHERE p_brand NOT IN (SELECT p_name FROM part)""",
)
def union_of_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed branches in order; the last one only adds names that are not there yet."""
    parts = table(spark, sf_dir, "part")
    first = parts.where("p_size = 1").select(F.lit("part").alias("branch"), F.col("p_name").alias("name"))
    second = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.lit("nation").alias("branch"), F.col("n_name").alias("name"))
    third = parts.select(F.lit("brand").alias("branch"), F.col("p_brand").alias("name")).distinct().join(parts.select(F.col("p_name").alias("name")), "name", "left_anti").select("branch", "name")
    return first.unionByName(second).unionByName(third)


@query(
    "2.7.4 2.7.5 2.7.10",
    """WITH r AS (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE (1 + (p_partkey % 2 = 0)::INT) / 5.0 END AS overlap, CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE 1.0 - (1 + (b <> 'bolt')::INT) / 3.0 END AS covered,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat_ws(',', CASE WHEN b <> 'bolt' THEN 'bolt' END, 'z') END AS missing FROM r""",
)
def overlap_and_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of keys for each part, with repeats and empty ones, and the required terms that the first holds."""
    key, first, second = F.col("p_partkey"), F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    none = F.array().cast("array<string>")
    left = F.array(first, second, first, F.col("p_brand"))
    right = F.when(key % 7 == 0, none).otherwise(F.array(F.col("p_brand"), F.lit("none"), F.when(key % 2 == 0, second).otherwise("none")))
    need = F.when(key % 5 == 0, none).otherwise(F.array(first, F.lit("bolt"), F.lit("z")))
    rows = table(spark, sf_dir, "part").select("p_partkey", left.alias("l"), right.alias("r"), need.alias("need"))
    share, missing = retrieval.coverage(F.col("l"), F.col("need"))
    return rows.select("p_partkey", retrieval.overlap_at(F.col("l"), F.col("r"), 5).alias("overlap"), share.alias("covered"), F.array_join(missing, ",").alias("missing"))


@query(
    "2.7.6 2.9.29",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR (doc_id % 40) / greatest(n_chars, 1) > 0.05 THEN 'MAJOR' WHEN doc_id % 3 = 0 OR (doc_id % 40) / greatest(n_chars, 1) > 0.01 THEN 'MINOR' ELSE 'META' END AS class FROM documents""",
)
def update_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a text before and after: one added for some, an important one removed for others, and lengths that grow a little."""
    key = F.col("doc_id")
    old = F.when(key % 7 == 0, F.array("lang", F.lit("the plot"))).otherwise(F.array("lang"))
    new = F.when(key % 3 == 0, F.array("lang", "source")).otherwise(F.array("lang"))
    rows = table(spark, sf_dir, "documents").select("doc_id", old.alias("o"), new.alias("n"), F.col("n_chars").alias("a"), (F.col("n_chars") + key % 40).alias("b"))
    return rows.select("doc_id", reconcile.update_class(F.col("o"), F.col("n"), F.col("a"), F.col("b"), ["plot"]).alias("class"))


@query("2.7.8", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'later' ELSE n_name END AS n_name FROM nation")
def later_table_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return reconcile.union_last_wins([nations, nations.where("n_nationkey % 4 = 0").withColumn("n_name", F.lit("later"))], "n_nationkey")


@query(
    "2.4.12",
    """WITH h AS (SELECT p_partkey, p_type FROM part WHERE p_size = 3 AND p_brand = 'Brand#2') SELECT p_partkey, false AS added FROM h
    UNION ALL SELECT p_partkey, true FROM part WHERE p_type IN (SELECT p_type FROM h) AND p_partkey NOT IN (SELECT p_partkey FROM h)""",
)
def completed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, and the other members of their series."""
    parts = table(spark, sf_dir, "part")
    return reconcile.with_series(parts.where("p_size = 3 AND p_brand = 'Brand#2'").select("p_partkey"), parts, "p_partkey", "p_type")


@query(
    "2.2.23",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'applicable' WHEN p_partkey % 11 = 0 THEN 'unresolved' WHEN p_size % 6 < 2 OR (p_size % 6 = 2 AND p_partkey % 13 < 5) THEN 'excluded' WHEN p_partkey % 5 > 0 AND p_size % 6 >= 4 THEN 'excluded' ELSE 'applicable' END AS state FROM part""",
)
def applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked versions against [2.5, 4.0), open above for every fifth part and on both sides for every seventh; no version is asked for every eleventh."""
    key = F.col("p_partkey")
    asked = F.when(key % 11 > 0, F.concat_ws(".", (F.col("p_size") % 6).cast("string"), (key % 13).cast("string")))
    lower, upper = F.when(key % 7 > 0, "2.5"), F.when((key % 7 > 0) & (key % 5 > 0), "4.0")
    return table(spark, sf_dir, "part").select("p_partkey", logic.version_state(asked, lower, upper).alias("state"))
