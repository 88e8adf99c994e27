"""Sections 2.10 and 2.11, and the versioned facts: state over time and the callable surface."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import table_functions
from corpusloom.operators import chains, facts, incremental, reconcile, retrieval
from corpusloom.plans.base import query, table
from corpusloom.plans.scans import scratch
from corpusloom.streaming import admission, sinks, stateful


@query("2.10.1", "SELECT user_id, ts::DATE AS day, least(count(*), 3)::BIGINT AS accepted, greatest(count(*) - 3, 0)::BIGINT AS rejected FROM events GROUP BY ALL")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.daily_quota(table(spark, sf_dir, "events"), "user_id", "ts", 3)


@query(
    "2.10.1",
    """WITH RECURSIVE a AS (SELECT user_id, min((ts, event_id)) AS hit FROM events GROUP BY user_id
    UNION ALL SELECT e.user_id, (e.ts, e.event_id) FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.hit[1] + INTERVAL 10 HOUR QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) = 1)
    SELECT event_id, user_id, ts, event_id IN (SELECT hit[2] FROM a) AS accepted FROM events""",
)
def sliding_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call in ten hours a user; rejected calls do not count."""
    return chains.spaced(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", ["event_id"], 36_000)


@query("2.10.4", "SELECT event_id, CASE WHEN event_id <> min(event_id) OVER w THEN min(event_id) OVER w END AS reused_from FROM events WINDOW w AS (PARTITION BY user_id, event_type, props)")
def reused_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.first_of_signature(table(spark, sf_dir, "events"), ["user_id", "event_type", "props"], "event_id").select("event_id", "reused_from")


@query(
    "2.10.5 2.10.3",
    """SELECT user_id, reason IS NOT NULL AS stop, reason FROM (SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type='error' AND (good IS NULL OR event_id > good)) >= 2 THEN 'failures' WHEN count(*) FILTER (WHERE event_type='signup' AND value > 180) >= 2 THEN 'rejects' WHEN count(*) FILTER (WHERE event_type='view' AND value > 180) >= 2 THEN 'repeats' END AS reason
    FROM (SELECT *, max(event_id) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id) AS good FROM events) GROUP BY user_id)""",
)
def circuit_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, high = F.col("event_type"), F.col("value") > 180
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", (kind == "error").alias("failed"), ((kind == "signup") & high).alias("rejected"), ((kind == "view") & high).alias("repeated"))
    return admission.circuit(calls, "user_id", "event_id", "failed", "rejected", "repeated")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls with a time that a watermark can follow."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


@query(
    "2.10.1",
    """WITH RECURSIVE a AS (SELECT user_id, min((ts, event_id)) AS hit FROM events GROUP BY user_id
    UNION ALL SELECT e.user_id, (e.ts, e.event_id) FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.hit[1] + INTERVAL 20 HOUR QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) = 1)
    SELECT event_id, user_id, event_id IN (SELECT hit[2] FROM a) AS accepted FROM events""",
)
def streamed_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call in twenty hours a user, by state over a stream that starts again twice."""
    calls = _calls(spark, sf_dir)
    found = stateful.run_over(spark, calls, "ts", scratch(spark, "admission"), lambda stream: stateful.judged(stream, "user_id", stateful.Admission("ts", "event_id", 72_000, 1)), 3)
    return found.select("event_id", "user_id", "accepted")


@query(
    "2.10.2",
    """WITH RECURSIVE b AS (SELECT event_type, min((ts, event_id)) AS hit FROM events GROUP BY event_type
    UNION ALL SELECT e.event_type, (e.ts, e.event_id) FROM b JOIN events e ON e.event_type = b.event_type AND e.ts >= b.hit[1] + INTERVAL 5 HOUR QUALIFY row_number() OVER (PARTITION BY e.event_type ORDER BY e.ts, e.event_id) = 1)
    SELECT event_id, event_type, event_id IN (SELECT hit[2] FROM b) AS rebuilt FROM events""",
)
def expiring_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which access builds a value that is good for five hours, by state over a stream that starts again twice."""
    calls = _calls(spark, sf_dir)
    found = stateful.run_over(spark, calls, "ts", scratch(spark, "cache"), lambda stream: stateful.judged(stream, "event_type", stateful.Expiring("ts", "event_id", 18_000)), 3)
    return found.select("event_id", "event_type", "rebuilt")


@query(
    "2.10.3",
    """WITH g AS (SELECT *, event_type = 'error' AS bad, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
    s AS (SELECT *, count(*) FILTER (WHERE bad) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS strikes FROM g)
    SELECT event_id, user_id, max(strikes) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 3 AS opened FROM s""",
)
def streamed_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three failures in a row open a user's breaker for good, by state over a stream that starts again twice."""
    calls = _calls(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    found = stateful.run_over(spark, calls, "ts", scratch(spark, "breaker"), lambda stream: stateful.judged(stream, "user_id", stateful.Breaker("ts", "event_id", "failed", 3)), 3)
    return found.select("event_id", "user_id", "opened")


@query("2.10.6", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def event_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that logs each batch twice under its epoch; read back, each event counts once."""
    folder = scratch(spark, "trace")

    def write(batch: DataFrame, epoch: int) -> None:
        for _ in range(2):
            sinks.append_events(batch, epoch, f"{folder}/log")

    sinks.run_into(spark, _calls(spark, sf_dir), "ts", folder, write)
    return spark.read.parquet(f"{folder}/log").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("2.10.7", "SELECT user_id, max((ts, event_id))[2] AS event_id FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) = 'error'")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table that a stream upserts, compacted after each piece; items whose newest event is an error are pending."""
    folder = scratch(spark, "pending")
    rows = _calls(spark, sf_dir).select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("valid"))
    kept = sinks.KeyedTable(spark, f"{folder}/table", ["user_id"], ["ts", "event_id"], "user_id long, ts timestamp, event_id long, valid boolean")

    def write(batch: DataFrame, epoch: int) -> None:
        kept.upsert(batch, epoch)
        if epoch == 1:
            kept.compact(epoch)
            kept.upsert(batch, epoch)

    sinks.run_into(spark, rows, "ts", folder, write)
    return sinks.pending(kept, "valid").select("user_id", "event_id")


@query(
    "2.10.8 2.10.9",
    """SELECT doc_id, CASE WHEN doc_id % 6 = 2 THEN n_chars WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, CASE WHEN doc_id % 6 = 1 THEN 20 ELSE 10 END AS fetched, CASE WHEN doc_id % 6 = 2 THEN 'stale' ELSE 'ok' END AS status FROM documents""",
)
def updated_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    old = docs.where("doc_id % 6 <> 1").withColumn("fetched", F.lit(10))
    new = docs.where("doc_id % 6 <> 2").withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))).withColumn("fetched", F.lit(20))
    return reconcile.updated_manifest(old, new, "doc_id", "n_chars", "fetched")


@query("2.10.10", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'rebuild' ELSE 'keep' END AS action, 'several' AS mode FROM documents")
def rebuild_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return incremental.rebuild_plan(docs, "doc_id", docs.where("doc_id % 9 = 0"))


@query("2.10.13 2.10.14", "SELECT phase, count(*)::BIGINT AS records, (count(*) FILTER (WHERE gap))::BIGINT AS gaps FROM (SELECT lang AS phase, doc_id % 10 = 0 AS gap FROM documents) GROUP BY phase")
def snapshot_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared records by phase, with those that have no body."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("phase"))
    bodies = docs.where("doc_id % 10 <> 0").select("doc_id", F.lit(True).alias("there"))
    return docs.join(bodies, "doc_id", "left").groupBy("phase").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("there").isNull()).alias("gaps"))


# The facts of _pages at version 3.10, each by its own rule.
FLAT = """WITH v AS (SELECT *, p_partkey AS entity_id, p_size % 6 > 3 OR (p_size % 6 = 3 AND p_partkey % 13 > 10) AS later FROM part),
    f AS (SELECT entity_id, 'type' AS key, p_type AS value, CASE WHEN later THEN 'applicable' ELSE 'excluded' END AS state FROM v
    UNION ALL SELECT entity_id, 'type', p_brand, CASE WHEN later THEN 'excluded' ELSE 'applicable' END FROM v
    UNION ALL SELECT entity_id, 'size', p_size::VARCHAR, CASE WHEN entity_id % 4 = 1 THEN 'excluded' ELSE 'applicable' END FROM v WHERE entity_id % 4 > 0
    UNION ALL SELECT entity_id, 'size', '7', 'applicable' FROM v WHERE entity_id % 5 = 0)"""

PROJECTED = """, p AS (SELECT *, CASE WHEN lo <> hi THEN 'ambiguous' WHEN unsure THEN 'unresolved' WHEN lo IS NOT NULL THEN 'applicable' ELSE 'not_applicable' END AS status FROM
    (SELECT entity_id, key, min(value) FILTER (WHERE state = 'applicable') AS lo, max(value) FILTER (WHERE state = 'applicable') AS hi, bool_or(state = 'unresolved') AS unsure FROM f GROUP BY ALL))"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages: the type up to a version and the brand from it on; the size, rejected or superseded for some, and a second one for others."""
    key, changed = F.col("p_partkey"), F.concat_ws(".", (F.col("p_size") % 6).cast("string"), (F.col("p_partkey") % 13).cast("string"))
    none = F.lit(None).cast("string")

    def record(name, value, introduced, until, status):
        parts = {"key": F.lit(name), "value": value, "introduced_in": introduced, "valid_to": until, "status": status, "evidence": F.array("p_brand")}
        return F.struct(*[column.alias(field) for field, column in parts.items()])

    confirmed = F.lit("confirmed")
    kinds = F.array(record("type", F.col("p_type"), F.lit("0.0"), changed, confirmed), record("type", F.col("p_brand"), changed, none, confirmed))
    status = F.when(key % 4 == 0, "rejected").when(key % 4 == 1, "superseded").otherwise("confirmed")
    sizes = F.array(record("size", F.col("p_size").cast("string"), none, none, status), record("size", F.lit("7"), none, none, F.when(key % 5 == 0, "confirmed").otherwise("rejected")))
    return table(spark, sf_dir, "part").select(key.alias("entity_id"), kinds.alias("identity_versions"), sizes.alias("attribute_records"))


@query("2.9.21 2.2.22", FLAT + " SELECT entity_id, key, value, state FROM f")
def flat_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.with_state(facts.facts_of(_pages(spark, sf_dir)), F.lit("3.10")).select("entity_id", "key", "value", "state")


@query("2.4.21", FLAT + PROJECTED + " SELECT entity_id, key, status, CASE WHEN status = 'applicable' THEN lo END AS value FROM p")
def attribute_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.attribute_projection(facts.with_state(facts.facts_of(_pages(spark, sf_dir)), F.lit("3.10")))


@query("2.4.21", FLAT + ", f2 AS (SELECT * REPLACE (CASE WHEN key = 'type' THEN 'unresolved' ELSE state END AS state) FROM f)" + PROJECTED.replace("FROM f ", "FROM f2 ") + " SELECT entity_id, key, status FROM p")
def projection_without_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = facts.with_state(facts.facts_of(_pages(spark, sf_dir)), F.lit(None).cast("string"))
    return facts.attribute_projection(state).select("entity_id", "key", "status")


@query(
    "2.6.5 2.11.3",
    """SELECT p_partkey, ((contains(p_name, 'small') OR p_type = 'SMALL')::INT + contains(p_name, 'ring')::INT + (p_type = 'PROMO')::INT + 1 + (p_brand = 'Brand#17')::INT + CASE WHEN p_name = 'small ring' THEN 5 ELSE 0 END)::DOUBLE AS score FROM part ORDER BY score DESC, p_partkey LIMIT 6""",
)
def searched_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("entity_name"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return facts.fact_search(rows, "where is the small ring of promo brand 17", least=1.0, stop=("where", "is", "the", "of"), id_col="p_partkey")


ACTIVITY = "SELECT doc_id FROM documents WHERE contains(text, 'the') AND source = 'src7' ORDER BY doc_id LIMIT 10"


@query("2.11.5 2.11.6 2.2.14", ACTIVITY)
def activity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").where(F.col("text").contains("the") & (F.col("source") == "src7"))
    return retrieval.reranked_or_all(hits.select("doc_id"), "doc_id", 10)


@query("2.11.5", "SELECT doc_id, CASE WHEN length(text) <= 3000 THEN 'whole' WHEN length(text) <= 9000 THEN 'chunks' ELSE 'ranked' END AS mode FROM documents")
def content_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n <= 3000, "whole").when(n <= 9000, "chunks").otherwise("ranked").alias("mode"))


SECTIONS = """WITH RECURSIVE d AS (SELECT doc_id, {key} AS g, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY {key} ORDER BY doc_id) AS rn FROM documents),
    r AS (SELECT doc_id, g, rn, n AS used, 0::BIGINT AS bucket FROM d WHERE rn = 1
    UNION ALL SELECT d.doc_id, d.g, d.rn, CASE WHEN used + n > {most} THEN n ELSE used + n END, bucket + (used + n > {most})::BIGINT FROM r JOIN d ON d.g = r.g AND d.rn = r.rn + 1) SELECT doc_id, bucket FROM r"""


@query("2.11.8", SECTIONS.format(key="source", most=60_000))
def packed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each source fill sections of 60,000 characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return chains.packed_sections(rows, "source", ["doc_id"], "n_chars").select("doc_id", "bucket")


@query("2.11.8", SECTIONS.format(key="0", most=9_000))
def packed_sections_of_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts under one key, over many tasks; longer ones than a section stand alone."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("key"), "n_chars")
    return chains.packed_sections(rows, "key", ["doc_id"], "n_chars", 9_000).select("doc_id", "bucket")


def _called(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A query that calls table functions, over views of some tables."""
    for name in tables:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    table_functions.register(spark)
    return spark.sql(sql)


@query("2.11.1", "SELECT p_partkey, p_name, (count(*) OVER ())::BIGINT AS n FROM part WHERE p_type = 'PROMO'")
def called_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _called(spark, sf_dir, "SELECT * FROM entries_of_type('PROMO')", "part")


@query(
    "2.11.1 2.11.2",
    """WITH m AS (SELECT doc_id, (length(text) - length(replace(text, 'tion', ''))) // 4 AS a, (length(text) - length(replace(text, 'über', ''))) // 4 AS b FROM documents)
    SELECT doc_id, least(a, b)::BIGINT AS weight, CASE WHEN a >= b THEN 'a' ELSE 'b' END AS heavier FROM m WHERE a > 0 AND b > 0""",
)
def called_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _called(spark, sf_dir, "SELECT * FROM shared_mentions('tion', 'über')", "documents")


@query(
    "2.11.1 2.9.7",
    """WITH p AS (SELECT doc_id, string_split(text, 'über') AS w FROM documents WHERE contains(text, 'über')), q AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM p),
    r AS (SELECT doc_id, array_to_string(w[:i], 'über') AS before, array_to_string(w[i + 1:], 'über') AS after_ FROM q)
    SELECT doc_id, length(before) AS start, right(before, 10) || 'über' || left(after_, 10) AS context FROM r""",
)
def called_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _called(spark, sf_dir, "SELECT * FROM contexts(TABLE(SELECT doc_id, text FROM documents), 'text', 'über', 10)", "documents")


@query("2.11.1 2.11.8", SECTIONS.format(key="source", most=60_000))
def called_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "TABLE(SELECT doc_id, source, n_chars FROM documents) PARTITION BY source ORDER BY (doc_id)"
    return _called(spark, sf_dir, f"SELECT doc_id, bucket FROM sections({rows}, 'n_chars', 60000)", "documents")


@query("2.11.1", "SELECT event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS changed FROM events")
def called_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "TABLE(SELECT user_id, event_id, event_type FROM events) PARTITION BY user_id ORDER BY (event_id)"
    return _called(spark, sf_dir, f"SELECT event_id, changed FROM changes({rows}, 'event_type')", "events")


RELATIONS = ("participated", "co_occur", "cast_of_task", "presence")
LEVELS = ("mention", "action", "line", "cast")
#: Names that a text's cast is looked for; what counts as doing something next to a name.
NAMES, ACTIONS = ("thand", "über", "tion of", "nicht", "the"), ("was", "and", "ist")


def entity_query(spark: SparkSession, sf_dir: str, entity: str, relation: str = "participated", target: str = "", top_k: int = 8, task_type: str = "", min_level: str = "") -> DataFrame:
    """Texts and entities by relation; arguments are checked before a plan is built.

    participated: doc_id, weight, level of the entity's texts by evidence, at least `min_level`, of a task type (language). co_occur: doc_id, weight
    of texts with the target too. cast_of_task: name, n, level of the names in the first text whose head is, or contains, the target.
    presence: region, texts, mentions by source, or for one source (the target).
    """
    from corpusloom.operators.mentions import counted_names, intersected, task_cast
    from corpusloom.operators.stats import graded_evidence

    if relation not in RELATIONS:
        raise ValueError(f"relation is one of {', '.join(RELATIONS)}")
    if relation in ("co_occur", "cast_of_task") and not target:
        raise ValueError(f"{relation} needs a target")
    if relation != "cast_of_task" and not entity:
        raise ValueError(f"{relation} needs an entity")
    if min_level and min_level not in LEVELS:
        raise ValueError(f"min_level is one of {', '.join(LEVELS)}")
    if top_k <= 0:
        raise ValueError("top_k is positive")
    docs = table(spark, sf_dir, "documents")
    docs = docs.where(F.col("lang") == task_type) if task_type else docs
    if relation == "presence":
        counted = counted_names(docs, [entity]).join(docs.select("doc_id", F.col("source").alias("region")), "doc_id")
        counted = counted.where(F.col("region") == target) if target else counted
        return counted.groupBy("region").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("mentions"))
    none = F.lit(None).cast("array<string>")
    if relation == "cast_of_task":
        heads = docs.select(F.col("doc_id").alias("entry_id"), F.substring_index("text", " ", 3).alias("title"), F.col("text").alias("body"), none.alias("cast"))
        entry = task_cast(heads, target)
        found = None
        for name in NAMES:
            own = graded_evidence(entry, [name], actions=ACTIONS).where("level is not null").select(F.lit(name).alias("name"), F.col("mentions").cast("long").alias("n"), "level")
            found = own if found is None else found.union(own)
        return found
    if relation == "co_occur":
        own = counted_names(docs, [entity]).select("doc_id", F.col("n").alias("weight"))
        both = intersected(own, counted_names(docs, [target]).select("doc_id", F.col("n").alias("weight")), "doc_id").select("doc_id", "weight")
        return both.orderBy(F.desc("weight"), "doc_id").limit(top_k)
    graded = graded_evidence(docs.select("doc_id", F.col("text").alias("body"), none.alias("cast")), [entity], actions=ACTIONS).where("level is not null")
    graded = graded.where(F.col("weight") > LEVELS.index(min_level)) if min_level else graded
    return graded.orderBy(F.desc("weight"), F.desc("mentions"), "doc_id").limit(top_k).select("doc_id", F.col("weight").cast("long").alias("weight"), "level")


@query(
    "2.11.2",
    """WITH m AS (SELECT doc_id, (length(text) - length(replace(text, 'thand', ''))) // 5 AS n, regexp_matches(text, 'thand[^\\n。！？]{0,6}?(was|and|ist)') AS near FROM documents WHERE lang = 'en' AND contains(text, 'thand'))
    SELECT doc_id, CASE WHEN near THEN 2 ELSE 1 END::BIGINT AS weight, CASE WHEN near THEN 'action' ELSE 'mention' END AS level FROM m ORDER BY weight DESC, n DESC, doc_id LIMIT 30""",
)
def participated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_query(spark, sf_dir, "thand", top_k=30, task_type="en")


@query("2.11.2", "SELECT source AS region, count(*)::BIGINT AS texts, sum((length(text) - length(replace(text, 'tion', ''))) // 4)::BIGINT AS mentions FROM documents WHERE contains(text, 'tion') GROUP BY source")
def presence_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_query(spark, sf_dir, "tion", "presence")


@query(
    "2.11.2",
    """WITH t AS (SELECT text FROM documents, (SELECT 'The' AS w) WHERE contains(array_to_string(string_split(text, ' ')[1:3], ' '), w) ORDER BY array_to_string(string_split(text, ' ')[1:3], ' ') <> w, doc_id LIMIT 1),
    n AS (SELECT unnest(['thand', 'über', 'tion of', 'nicht', 'the']) AS name)
    SELECT name, ((length(text) - length(replace(text, name, ''))) // length(name))::BIGINT AS n, CASE WHEN regexp_matches(text, name || '[^\\n。！？]{0,6}?(was|and|ist)') THEN 'action' ELSE 'mention' END AS level FROM t, n WHERE contains(text, name)""",
)
def cast_of_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names in the first text that begins with a title."""
    return entity_query(spark, sf_dir, "", "cast_of_task", "The")


@query("2.11.2 2.3.13", "SELECT doc_id, least(len(string_split(text, 'thand')) - 1, len(string_split(text, 'tion of')) - 1)::BIGINT AS weight FROM documents WHERE contains(text, 'thand') AND contains(text, 'tion of') ORDER BY weight DESC, doc_id LIMIT 8")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_query(spark, sf_dir, "thand", "co_occur", "tion of")


def phrase_to_plan(spark: SparkSession, sf_dir: str, phrase: str) -> DataFrame | None:
    """A plan for a phrase of the finite grammar, or None."""
    if found := re.fullmatch(r"how many ([A-Z]+) parts are there\?", phrase):
        return table(spark, sf_dir, "part").where(F.col("p_type") == found[1]).agg(F.count(F.lit(1)).alias("n"))
    return None
