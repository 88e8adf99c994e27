"""Section 2.4: aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import graph, stats
from corpusloom.plans.base import query, table


@query(
    "2.4.1 2.7.11",
    """SELECT sum(n)::BIGINT AS n_rows, count(*)::BIGINT AS n_distinct, (count(*) FILTER (WHERE c > 1))::BIGINT AS conflicts,
    CASE WHEN count(*) FILTER (WHERE c > 1) > 0 THEN 'ambiguous' ELSE 'exact' END AS status, CASE WHEN count(*) FILTER (WHERE c > 1) = 0 THEN count(*) END::BIGINT AS count
    FROM (SELECT p_name, count(*) n, count(DISTINCT p_brand) c FROM part GROUP BY p_name)""",
)
def catalogue_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_with_conflict(table(spark, sf_dir, "part"), "p_name", ["p_brand"])


VERDICTS = """SELECT user_id, CASE WHEN bool_or(value > 350) OR (bool_or(event_type='purchase' AND value > 200) AND bool_or(event_type='signup' AND value > 200)) THEN 'conflict' WHEN bool_or(event_type='purchase' AND value > 200) THEN 'include' WHEN bool_or(event_type='signup' AND value > 200) THEN 'exclude' ELSE 'unknown' END AS verdict
    FROM events GROUP BY user_id"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, sure = F.col("event_type"), F.col("value") > 200
    decision = F.when(F.col("value") > 350, "conflict").when(sure & (kind == "purchase"), "include").when(sure & (kind == "signup"), "exclude").otherwise("unknown")
    return stats.member_verdicts(table(spark, sf_dir, "events").withColumn("decision", decision), ["user_id"])


@query("2.4.3", VERDICTS)
def member_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


@query(
    "2.4.2 2.4.4 2.4.5",
    f"""WITH v AS ({VERDICTS}) SELECT user_id % 40 AS part, (count(*) FILTER (WHERE verdict='include'))::BIGINT AS included, (count(*) FILTER (WHERE verdict='exclude'))::BIGINT AS excluded,
    (count(*) FILTER (WHERE verdict='unknown'))::BIGINT AS unknown, (count(*) FILTER (WHERE verdict='conflict'))::BIGINT AS conflict,
    CASE WHEN count(*) FILTER (WHERE verdict='conflict') > 0 THEN 'ambiguous' WHEN count(*) FILTER (WHERE verdict='unknown') = 0 THEN 'exact' WHEN count(*) FILTER (WHERE verdict='include') > 0 THEN 'lower_bound' ELSE 'missing' END AS status,
    CASE WHEN count(*) FILTER (WHERE verdict='conflict') > 0 THEN NULL WHEN count(*) FILTER (WHERE verdict='unknown') = 0 OR count(*) FILTER (WHERE verdict='include') > 0 THEN (count(*) FILTER (WHERE verdict='include'))::BIGINT END AS count
    FROM v GROUP BY 1""",
)
def counted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counted_with_status(_verdicts(spark, sf_dir).withColumn("part", F.col("user_id") % 40), F.lit(True), ["part"])


@query(
    "2.4.6",
    """SELECT lang, doc_id, len(string_split(text, chr(10) || 'The')) - 1 AS lines FROM documents WHERE contains(text, chr(10) || 'The')
    UNION ALL SELECT lang, NULL, sum(len(string_split(text, chr(10) || 'The')) - 1)::BIGINT FROM documents WHERE contains(text, chr(10) || 'The') GROUP BY lang
    UNION ALL SELECT NULL, NULL, sum(len(string_split(text, chr(10) || 'The')) - 1)::BIGINT FROM documents WHERE contains(text, chr(10) || 'The')""",
)
def lines_with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching lines a text, with subtotals by language and a grand total."""
    counted = table(spark, sf_dir, "documents").select("lang", "doc_id", text.occurrences("text", "\nThe").alias("n")).where("n > 0")
    return counted.rollup("lang", "doc_id").agg(F.sum("n").alias("lines"))


@query(
    "2.4.7 2.4.9 2.4.11",
    """SELECT p_brand, p_type, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names, count(*)::BIGINT AS n FROM part GROUP BY p_brand, p_type""",
)
def grouped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.array_join(F.sort_array(F.collect_set("p_name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))


@query(
    "2.4.8 2.4.10",
    """SELECT r_name, n_name, count(*)::BIGINT AS customers, grouping_id(r_name, n_name)::BIGINT AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
)
def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.grouping_id().alias("level"))


@query("2.4.13", """SELECT string_split(p_brand, '#')[1] AS head, string_agg(DISTINCT string_split(p_brand, '#')[2], ',' ORDER BY string_split(p_brand, '#')[2]) AS tails FROM part GROUP BY 1""")
def split_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("p_brand", "#")
    rows = table(spark, sf_dir, "part").select(parts[0].alias("head"), parts[1].alias("tail"))
    return rows.groupBy("head").agg(F.array_join(F.sort_array(F.collect_set("tail")), ",").alias("tails"))


@query(
    "2.4.14 2.7.9",
    """SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, arg_min(left(text, 40), turn) AS opening, left(string_agg(left(text, 20), '|' ORDER BY turn), 60) AS digest FROM conversations GROUP BY conv_id""",
)
def nested_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in order, the first text, and a digest of bounded length."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.substring("text", 1, 40).alias("head")))).alias("t"))
    digest = F.left(F.array_join(F.transform("t", lambda x: F.substring(x["head"], 1, 20)), "|"), F.lit(60))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("roles"), F.get("t", 0)["head"].alias("opening"), digest.alias("digest"))


RATES = """SELECT source, (count(*) FILTER (WHERE quality = 1))::BIGINT AS good, (count(*) FILTER (WHERE quality IS NOT NULL))::BIGINT AS labelled,
    round(count(*) FILTER (WHERE quality = 1) / greatest(1, count(*))::DOUBLE, 4) AS rate_every, round(count(*) FILTER (WHERE quality = 1) / greatest(1, count(*) FILTER (WHERE quality IS NOT NULL))::DOUBLE, 4) AS rate_labelled
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    labelled = F.col("quality").isNotNull()
    return stats.coverage_rates(joined, "source", {"good": F.col("quality") == 1, "labelled": labelled}, {"every": F.lit(True), "labelled": labelled})


@query("2.4.15 2.4.17", RATES)
def coverage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir)


@query(
    "2.4.16",
    """WITH m AS (SELECT day(ts) <= 15 AS early, event_type || '-' || user_id::VARCHAR AS grp, value > 11 AS ok FROM events),
    b AS (SELECT grp, round(avg(ok::INT), 4) AS rate FROM m WHERE early GROUP BY grp), a AS (SELECT grp, round(avg(ok::INT), 4) AS rate FROM m WHERE NOT early GROUP BY grp)
    SELECT a.grp, a.rate, b.rate AS before, CASE WHEN a.rate < 0.8 THEN 'low' ELSE 'drop' END AS alert FROM a LEFT JOIN b USING (grp) WHERE a.rate < 0.8 OR b.rate - a.rate > 0.1""",
)
def period_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-"), "user_id").alias("grp"), (F.dayofmonth("ts") <= 15).alias("early"), (F.col("value") > 11).cast("int").alias("ok"))

    def rates(rows: DataFrame) -> DataFrame:
        return rows.groupBy("grp").agg(F.round(F.avg("ok"), 4).alias("rate"))

    return stats.period_alerts(rates(events.where("not early")), rates(events.where("early")), "grp", "rate")


@query(
    "2.4.20 2.4.27",
    """SELECT event_type, user_id, count(*)::BIGINT AS records, string_agg(DISTINCT strftime(ts, '%d'), ',' ORDER BY strftime(ts, '%d')) AS evidence FROM events GROUP BY ALL""",
)
def merged_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.facts import merged_by_context

    rows = table(spark, sf_dir, "events").withColumn("evidence", F.array(F.date_format("ts", "dd")))
    return merged_by_context(rows, ["event_type", "user_id"]).select("event_type", "user_id", "records", F.array_join("evidence", ",").alias("evidence"))


@query("2.4.22", "SELECT p_name, count(DISTINCT p_brand)::BIGINT AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ambiguous(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query("2.4.23 2.4.28", "SELECT o_custkey::VARCHAR AS o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1 AND length(o_custkey::VARCHAR) >= 2")
def unambiguous_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus")
    return stats.unambiguous(pairs, "o_custkey", "o_orderstatus")


@query(
    "2.4.24",
    """SELECT source, lang, n, labelled FROM (SELECT source, lang, n, sum(n) OVER (PARTITION BY source)::BIGINT AS labelled, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang DESC) rn
    FROM (SELECT source, lang, count(*)::BIGINT n FROM documents WHERE lang IS NOT NULL GROUP BY ALL)) WHERE rn = 1 AND 2 * n > labelled AND n >= 2""",
)
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.majority_label(table(spark, sf_dir, "documents"), "source", "lang")


@query(
    "2.4.25 2.4.12",
    """SELECT w AS name, count(DISTINCT p_partkey)::BIGINT AS n, min(p_partkey) AS first FROM (SELECT p_partkey, unnest(list_distinct(list_concat(string_split(p_name, ' '), [p_brand]))) AS w FROM part) GROUP BY w""",
)
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.explode(F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_brand")))).alias("name")
    return table(spark, sf_dir, "part").select("p_partkey", names).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("2.4.26", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.last_per_key(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type", "event_id"])


@query(
    "2.4.29",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 'stale' ELSE 'fresh' END AS status FROM documents""",
)
def page_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.incremental import fingerprints, freshness

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    base = fingerprints(docs.where("doc_id % 5 <> 0"), "doc_id", ["lang", "source"])
    seen = fingerprints(docs.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang"))), "doc_id", ["lang", "source"])
    return freshness(docs, "doc_id", base, seen, docs.where("doc_id % 3 = 0"))


@query(
    "2.4.30",
    """SELECT l_orderkey AS page, l_returnflag AS field, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS dependencies FROM lineitem WHERE l_suppkey < 4 GROUP BY ALL""",
)
def field_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.incremental import field_impacts as impacts

    fields = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("field"), F.col("l_suppkey").cast("string").alias("dependency"))
    dirty = table(spark, sf_dir, "supplier").where("s_suppkey < 4").select(F.col("s_suppkey").cast("string").alias("node"))
    return impacts(fields, dirty).select("page", "field", F.array_join("dependencies", ",").alias("dependencies"))


@query(
    "2.4.31",
    """WITH c AS (SELECT user_id, (count(*) FILTER (WHERE event_type='click'))::BIGINT a, (count(*) FILTER (WHERE event_type='view'))::BIGINT b, count(*)::BIGINT r, avg(value/100) o FROM events GROUP BY user_id)
    SELECT round(avg(a/r::DOUBLE),6) AS macro_a, round(avg(b/r::DOUBLE),6) AS macro_b, round(sum(a)/sum(r)::DOUBLE,6) AS micro_a, round(sum(b)/sum(r)::DOUBLE,6) AS micro_b,
    (count(*) FILTER (WHERE a>b))::BIGINT AS wins_a, (count(*) FILTER (WHERE b>a))::BIGINT AS wins_b, (count(*) FILTER (WHERE a=b))::BIGINT AS ties, round(avg(o),6) AS mean_overlap FROM c""",
)
def retrieval_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.retrieval import evaluation

    kind = F.col("event_type")
    cases = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind == "click").alias("hits_a"), F.count_if(kind == "view").alias("hits_b"), F.count(F.lit(1)).alias("required"), F.avg(F.col("value") / 100).alias("overlap")
    )
    return evaluation(cases)


@query("2.4.32 2.4.33", "SELECT * FROM (SELECT 'lang' AS field, count(*) FILTER (WHERE trim(lang) <> '') AS filled, count(*) AS total FROM documents UNION ALL SELECT 'text', count(*) FILTER (WHERE trim(text) <> ''), count(*) FROM documents UNION ALL SELECT 'source', count(*) FILTER (WHERE trim(source) <> ''), count(*) FROM documents)")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fill_counts(table(spark, sf_dir, "documents"), ["lang", "text", "source"])


@query(
    "2.4.34",
    """SELECT p_type AS entry_type, count(*)::BIGINT AS entries, coalesce(sum(n), 0)::BIGINT AS links FROM part LEFT JOIN (SELECT l_partkey, count(*) n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY p_type""",
)
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_type").alias("entry_type"))
    return graph.graph_profile(nodes, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source")))


@query(
    "2.4.35 2.7.6",
    """SELECT user_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_left, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS only_right,
    array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ',') AS common FROM (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE day(ts) <= 3), []) a, coalesce(list(DISTINCT event_type) FILTER (WHERE day(ts) > 3), []) b FROM events GROUP BY user_id)""",
)
def set_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.reconcile import set_report

    early = F.dayofmonth("ts") <= 3
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(early, F.col("event_type"))).alias("a"), F.collect_set(F.when(~early, F.col("event_type"))).alias("b"))
    return set_report(sets, "a", "b").select("user_id", *[F.array_join(c, ",").alias(c) for c in ("only_left", "only_right", "common")])
