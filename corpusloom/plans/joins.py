"""Section 2.3: joins, lookups, merges and snapshot diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import cascade, content, graph, mentions, ranking, reconcile, stats
from corpusloom.plans.base import query, table


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders link to parts in line order."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("target"), F.concat(F.lit("part "), "l_partkey").alias("name"))


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("title"), F.col("p_type").alias("entry_type"))


EDGES = "(SELECT l_orderkey AS source, l_linenumber AS position, l_partkey AS target, 'part ' || l_partkey AS name FROM lineitem)"


@query(
    "2.3.1",
    f"""SELECT source, position, target, p_name AS target_title FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position, target) rn FROM {EDGES} e) LEFT JOIN part ON target = p_partkey AND p_size > 10 WHERE rn <= 2""",
)
def expand_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("title"))
    first = ranking.first_rows(edges(spark, sf_dir), ["source"], ["position", "target"], 2)
    return graph.expand(first, nodes, 2).select("source", "position", "target", "target_title")


@query("2.3.2", f"SELECT target, source, min(position) AS position FROM {EDGES} e WHERE source <> target GROUP BY ALL")
def back_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.backlinks(edges(spark, sf_dir)).select("target", "source", "position")


@query("2.3.3 2.1.28 2.1.29", f"SELECT target, arg_min(name, source * 100 + position) AS name FROM {EDGES} e WHERE target NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY target")
def missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.missing_targets(edges(spark, sf_dir), part_nodes(spark, sf_dir).join(table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("entry_id")), "entry_id", "left_semi"))


@query(
    "2.3.4 2.3.5 2.3.26",
    """SELECT c_custkey, CASE WHEN c_acctbal < 3000 AND o1 IS NOT NULL THEN 1 WHEN s1 IS NOT NULL THEN 2 END AS tier, CASE WHEN c_acctbal < 3000 AND o1 IS NOT NULL THEN o1 WHEN s1 IS NOT NULL THEN s1 END AS target FROM customer
    LEFT JOIN (SELECT o_custkey, min(o_orderkey) o1 FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) s1 FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""",
)
def fallback_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specific key first, then the broader one."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("t"))
    suppliers = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("t"))
    specific = F.when(F.col("c_acctbal") < 3000, F.col("c_custkey"))
    return reconcile.by_priority(table(spark, sf_dir, "customer"), "c_custkey", [(specific, orders, "o_custkey", "t"), (F.col("c_nationkey"), suppliers, "s_nationkey", "t")]).select("c_custkey", "tier", "target")


@query(
    "2.3.5",
    """WITH e AS (SELECT c_custkey AS id, c_custkey % 9 AS p, 'n' || c_custkey % 7 AS a, 'm' || c_custkey % 5 AS b FROM customer)
    SELECT id, CASE p WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 7 WHEN 7 THEN 8 END AS tier,
    CASE p WHEN 4 THEN a || ',' || b WHEN 7 THEN 'box' WHEN 8 THEN '' ELSE a END AS "cast", CASE p WHEN 4 THEN 'speaker_lines' WHEN 6 THEN 'activity_inherited' WHEN 7 THEN 'infobox_text' WHEN 8 THEN '' ELSE 'metadata' END AS source FROM e""",
)
def cascaded_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries whose cast is found in eight tiers, and nowhere for every ninth."""
    key = F.col("c_custkey")
    place, number = key % 9, F.lpad(key.cast("string"), 9, "0")
    title, act = F.concat(F.lit("Tale · "), number), F.concat(F.lit("Deed 「"), number, F.lit("」"))
    a, b = F.concat(F.lit("n"), key % 7), F.concat(F.lit("m"), key % 5)
    rows = table(spark, sf_dir, "customer").select("c_custkey", place.alias("p"), number.alias("number"), title.alias("title"), act.alias("act"), a.alias("a"), b.alias("b"))
    alias = F.when(F.col("p") == 5, F.array(F.lit(" "), F.concat(F.lit("Festival "), "act"))).when(F.col("p") == 6, F.array(F.concat(F.lit("Festival "), "number"))).otherwise(F.array().cast("array<string>"))
    entries = rows.select(F.col("c_custkey").alias("id"), "title", "act", alias.alias("aliases"), F.when(F.col("p") == 7, F.array(F.lit("box"))).alias("listed"))
    named = (
        F.when(F.col("p") == 0, F.array("title"))
        .when(F.col("p") == 1, F.array(F.concat(F.lit("Tale"), "number")))
        .when(F.col("p") == 2, F.array("act"))
        .when(F.col("p") == 3, F.array(F.concat(F.lit("Deed"), "number")))
        .when(F.col("p") == 4, F.array(F.concat("act", F.lit("·1")), F.concat(F.lit("Deed"), "number", F.lit("·2"))))
        .when(F.col("p") == 5, F.array(F.concat(F.lit("Festival "), "act")))
        .when(F.col("p") == 6, F.array(F.concat(F.lit("Festival "), "number")))
    )
    records = rows.select("a", "b", F.posexplode(named).alias("at", "key"))
    first = F.col("at") == 0
    records = records.select("key", F.when(first, F.array("a")).otherwise(F.array("a", "b")).alias("cast"), F.when(first, "metadata").otherwise("speaker_lines").alias("source"))
    found = cascade.cascaded_cast(entries, records)
    in_order = F.array_join(F.array_sort("cast", lambda x, y: F.when(F.left(x, F.lit(1)) > F.left(y, F.lit(1)), -1).when(F.left(x, F.lit(1)) < F.left(y, F.lit(1)), 1).otherwise(0)), ",")
    return found.select("id", "tier", in_order.alias("cast"), "source")


@query("2.3.6", "SELECT p_partkey, coalesce(flag, 'none') AS kind FROM part LEFT JOIN (VALUES ('PROMO', 'offer'), ('LARGE', 'bulky')) f(t, flag) ON p_type = t")
def flag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = spark.createDataFrame([("PROMO", "offer"), ("LARGE", "bulky")], "p_type string, flag string")
    return table(spark, sf_dir, "part").join(F.broadcast(flags), "p_type", "left").select("p_partkey", F.coalesce("flag", F.lit("none")).alias("kind"))  # two rows


MERGE = """WITH l AS (SELECT c_custkey, c_nationkey::VARCHAR || c_mktsegment AS k FROM customer), r AS (SELECT s_suppkey, s_nationkey::VARCHAR || CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'OTHER' END AS k FROM supplier),
    p AS (SELECT c_custkey, s_suppkey FROM l JOIN r USING (k)), n AS (SELECT c_custkey, count(*) n, min(s_suppkey) s FROM p GROUP BY 1)
    SELECT c_custkey, s AS s_suppkey, CASE WHEN n IS NULL THEN 'left_only' WHEN n = 1 THEN 'merged' ELSE 'review' END AS status FROM l LEFT JOIN n USING (c_custkey)
    UNION ALL SELECT NULL, s_suppkey, 'right_only' FROM r WHERE s_suppkey NOT IN (SELECT s_suppkey FROM p)"""


@query("2.3.7 2.3.9", MERGE)
def merged_with_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").withColumn("key", F.concat("c_nationkey", "c_mktsegment"))
    right = table(spark, sf_dir, "supplier").withColumn("key", F.concat("s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("OTHER")))
    return reconcile.keyed_merge(left, right, "c_custkey", "s_suppkey", "key")


@query(
    "2.3.8",
    """WITH c AS (SELECT c_custkey, s_suppkey, round(1 / (1 + abs(c_acctbal - s_acctbal) / 1000), 6) AS score FROM customer JOIN supplier ON c_nationkey = s_nationkey),
    b AS (SELECT *, max(score) OVER (PARTITION BY c_custkey) m FROM c WHERE score >= 0.2)
    SELECT c_custkey, arg_max(s_suppkey, score) AS s_suppkey, max(score) AS score, CASE WHEN count(*) > 1 THEN 'review' ELSE 'merged' END AS status FROM b WHERE score >= m - 0.05 GROUP BY c_custkey""",
)
def best_scored_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of 0.2 reach to a distance of 4,000, up to where a millionth is less than 0.03 of it."""
    left, right = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    score = lambda distance: F.round(1 / (1 + distance / 1000), 6)
    return reconcile.closest_match(left, right, "c_custkey", "s_suppkey", ("c_nationkey", "s_nationkey"), ("c_acctbal", "s_acctbal"), score, "score", near=0.05, floor=0.2, blur=0.03)


@query(
    "2.3.10 2.3.29",
    """SELECT p_partkey, f.first AS match FROM part LEFT JOIN (SELECT lower(replace(p_name, ' ', '')) k, min(p_partkey) first FROM part GROUP BY 1) f ON f.k = lower(replace(p_name, ' ', ''))""",
)
def indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item of each normalised title."""
    parts = table(spark, sf_dir, "part")
    first = parts.groupBy(text.squeezed("p_name").alias("k")).agg(F.min("p_partkey").alias("match"))
    asked = parts.select("p_partkey", text.squeezed("p_name").alias("k"))
    return asked.join(first, "k", "left").select("p_partkey", "match")


@query(
    "2.3.11",
    """WITH a AS (SELECT DISTINCT p_name FROM part), c AS (SELECT p_name, n_nationkey, CASE WHEN length(p_name) = n_nationkey THEN 1 WHEN length(p_name) > n_nationkey AND n_nationkey >= 8 THEN 2 END AS tier FROM a, nation),
    t AS (SELECT p_name, tier, count(*) n, min(n_nationkey) k, row_number() OVER (PARTITION BY p_name ORDER BY tier) rn FROM c WHERE tier IS NOT NULL GROUP BY p_name, tier)
    SELECT a.p_name, tier, CASE WHEN n = 1 THEN k END AS n_nationkey, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM a LEFT JOIN t ON a.p_name = t.p_name AND rn = 1""",
)
def tiered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact before looser conditions; a tie within the tier is ambiguous. A name brings the few numbers that it may meet, so that the join is by equality."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    size = F.length("p_name")
    met = names.select("p_name", F.explode(F.concat(F.array(size), F.when(size > 8, F.sequence(F.lit(8), size - 1)).otherwise(F.array().cast("array<int>")))).alias("n_nationkey"))
    pairs = met.join(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")
    return reconcile.tiered_match(names, "p_name", pairs, "n_nationkey", [size == F.col("n_nationkey"), (size > F.col("n_nationkey")) & (F.col("n_nationkey") >= 8)])


TIERS = r"""WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents),
    c AS (SELECT doc_id, w, w[(doc_id % len(w)) + 1] AS b, w[((doc_id + 1) % len(w)) + 1] AS o FROM w),
    q AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN b WHEN 1 THEN left(b, length(b) // 2) || '(x y)' || substring(b, length(b) // 2 + 1) WHEN 2 THEN substring(b, length(b) // 4 + 1, length(b) // 2) WHEN 3 THEN b || chr(10) || o
    WHEN 4 THEN right(w[1], 30) || ' ' || left(coalesce(w[2], ''), 30) ELSE left(b, length(b) // 3) || ' QQQQ ' || substring(b, length(b) // 3 + 1) END AS t FROM c),
    s AS (SELECT doc_id AS page, unnest(w) AS b, generate_subscripts(w, 1) - 1 AS block FROM w), z AS (SELECT doc_id AS page, array_to_string(w, chr(10)) AS b, 0 AS block FROM w),
    n AS (SELECT doc_id, {n_t} AS n, {l_t} AS l, list_filter(list_transform(string_split(t, chr(10)), lambda x: {n_x}), lambda x: length(x) >= 6) AS lines FROM q),
    a AS (SELECT * FROM n WHERE length(n) >= 6), sb AS MATERIALIZED (SELECT page, block, {n_b} AS bn, {l_b} AS bl FROM s), zb AS MATERIALIZED (SELECT page, {n_b} AS bn, {l_b} AS bl FROM z),
    i AS MATERIALIZED (SELECT doc_id, page, block, CASE WHEN n = bn THEN 1 WHEN length(l) >= 6 AND l = bl THEN 2 END AS same, CASE WHEN contains(bn, n) THEN length(bn) ELSE length(bl) END AS size FROM a, sb WHERE contains(bn, n) OR (length(l) >= 6 AND contains(bl, l))),
    p AS (SELECT doc_id, page, arg_min(same, block) FILTER (WHERE same IS NOT NULL) AS flat, min(block) FILTER (WHERE same IS NOT NULL) AS at0, count(*) AS k, min(block) AS lone, min(size) AS size FROM i GROUP BY ALL),
    g AS (SELECT doc_id, page, flat AS tier, [at0] AS blocks, 0 AS size FROM p WHERE flat IS NOT NULL UNION ALL SELECT doc_id, page, 3, [lone], size FROM p WHERE flat IS NULL AND k = 1),
    x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS r, len(lines) AS given FROM a WHERE len(lines) >= 2),
    m AS (SELECT x.doc_id, page, r, any_value(given) AS given, min(block) AS block, min(length(bn)) AS size FROM x, sb WHERE contains(bn, line) GROUP BY ALL HAVING count(*) = 1),
    mm AS (SELECT doc_id, page, list(block ORDER BY r) AS bs, arg_min(size, r) AS size FROM m GROUP BY ALL HAVING count(*) = any_value(given)),
    mo AS (SELECT doc_id, page, list_filter(bs, lambda y, j: list_position(bs, y) = j) AS blocks, size FROM mm ANTI JOIN g USING (doc_id, page)),
    e AS (SELECT * FROM g UNION ALL SELECT doc_id, page, CASE WHEN len(blocks) > 1 THEN 4 ELSE 3 END, blocks, CASE WHEN len(blocks) > 1 THEN 0 ELSE size END FROM mo
    UNION ALL SELECT doc_id, page, CASE WHEN contains(bn, n) THEN 5 ELSE 6 END, [], 0 FROM a, zb WHERE contains(bn, n) OR (length(l) >= 6 AND contains(bl, l))),
    f AS (SELECT doc_id, any_value(tier) AS tier, count(*) AS k, any_value(page) AS page, any_value(blocks) AS blocks FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY tier, size) AS r FROM e) WHERE r = 1 GROUP BY doc_id)
    SELECT d.doc_id AS id, ['block_exact', 'block_loose', 'block_contains', 'multi_blocks', 'page_exact', 'page_loose'][tier] AS tier, CASE WHEN k = 1 THEN page END AS page, CASE WHEN k = 1 THEN array_to_string(blocks, ',') END AS blocks,
    CASE WHEN k = 1 THEN 'matched' WHEN k > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM documents d LEFT JOIN f USING (doc_id)"""


def _norm_sql(text: str, loose: bool = False) -> str:
    bare = f"regexp_replace(coalesce({text}, ''), '<[^>]+>', '', 'g')"
    bare = f"regexp_replace({bare}, '[（(][^（）()]*[）)]', '', 'g')" if loose else bare
    return f"regexp_replace({bare}, '[^0-9A-Za-z一-鿿]', '', 'g')"


@query("2.3.12", TIERS.format(**{f"{kind}_{x}": _norm_sql(x, kind == "l") for kind in "nl" for x in "tbx"}))
def content_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the texts, as they are, with an insertion in brackets, cut, in twos, across a line end or damaged, against all texts as pages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("w"))
    line = lambda step: F.get("w", ((F.col("doc_id") + step) % F.size("w")).cast("int"))
    b, at = line(0), F.col("doc_id") % 6
    n = F.length(b)
    part = lambda start, size: b.substr(start.cast("int"), size.cast("int"))
    half, third, all_ = F.floor(n / 2), F.floor(n / 3), F.lit(1_000_000)
    asked = (
        F.when(at == 0, b)
        .when(at == 1, F.concat(part(F.lit(1), half), F.lit("(x y)"), part(half + 1, all_)))
        .when(at == 2, part(F.floor(n / 4) + 1, half))
        .when(at == 3, F.concat(b, F.lit("\n"), line(1)))
        .when(at == 4, F.concat(F.right(F.get("w", F.lit(0)), F.lit(30)), F.lit(" "), F.left(F.coalesce(F.get("w", F.lit(1)), F.lit("")), F.lit(30))))
        .otherwise(F.concat(part(F.lit(1), third), F.lit(" QQQQ "), part(third + 1, all_)))
    )
    found = content.content_tiers(docs.select("doc_id", asked.alias("t")), "doc_id", "t", docs, "doc_id", "w", share=None)
    return found.withColumn("blocks", F.array_join("blocks", ","))


@query(
    "2.3.11",
    """WITH l AS (SELECT c_custkey, n_name, r_name, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN left(n_name, 4) WHEN 2 THEN substring(n_name, 2, 4) ELSE 'no' || n_name END AS place, c_custkey % 3 = 0 AS vague FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    t AS (SELECT n_nationkey, r_name, CASE WHEN n_nationkey % 2 = 0 THEN 'At [' || n_name || '] gate' ELSE n_name || ' board' END AS title, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS inner_ FROM nation JOIN region ON r_regionkey = n_regionkey),
    p AS (SELECT c_custkey, n_nationkey, CASE WHEN inner_ = place THEN 'exact' WHEN starts_with(title, place) OR contains(title, place) THEN 'base' END AS kind FROM l JOIN t ON (vague OR l.r_name = t.r_name) AND (inner_ = place OR contains(title, place)))
    SELECT c_custkey, n_nationkey, kind FROM customer LEFT JOIN (SELECT c_custkey, min(n_nationkey) AS n_nationkey, arg_min(kind, n_nationkey) AS kind FROM p GROUP BY 1) USING (c_custkey)""",
)
def place_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of customers against a catalogue of titles: equal regions where both are known, then the place in brackets, or in the title; the first title counts.
    Each distinct place is asked once."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    even = F.col("n_nationkey") % 2 == 0
    titles = nations.select("n_nationkey", F.col("r_name").alias("t_region"), F.when(even, F.concat(F.lit("At ["), "n_name", F.lit("] gate"))).otherwise(F.concat("n_name", F.lit(" board"))).alias("title"), F.when(even, F.col("n_name")).alias("inner"))
    at = F.col("c_custkey") % 4
    place = F.when(at == 0, F.col("n_name")).when(at == 1, F.left("n_name", F.lit(4))).when(at == 2, F.substring("n_name", 2, 4)).otherwise(F.concat(F.lit("no"), "n_name"))
    region = F.when(F.col("c_custkey") % 3 != 0, F.col("r_name"))
    asked = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", place.alias("place"), region.alias("region"))
    return content.place_match(asked, "c_custkey", "place", "region", titles, "n_nationkey", "title", "inner", "t_region").select("c_custkey", "n_nationkey", "kind")


@query(
    "2.3.13",
    """WITH w AS (SELECT user_id, day(ts)::INT AS d, count(*)::BIGINT AS weight FROM events GROUP BY ALL) SELECT a.d, least(a.weight, b.weight) AS weight, CASE WHEN a.weight >= b.weight THEN 'a' ELSE 'b' END AS heavier
    FROM w a JOIN w b ON a.d = b.d WHERE a.user_id = 3 AND b.user_id = 5 AND least(a.weight, b.weight) >= 2""",
)
def entity_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "events").where("user_id IN (3, 5)").groupBy("user_id", F.dayofmonth("ts").alias("d")).agg(F.count(F.lit(1)).alias("weight"))
    return mentions.intersected(weights.where("user_id = 3"), weights.where("user_id = 5"), "d", 2)


NAMES = "(VALUES ('thand'), ('über'), ('ción'), ('tion of')) n(name)"


@query(
    "2.3.14 2.3.18",
    f"""SELECT CASE WHEN name IN ('thand','tion of') THEN 'en' ELSE 'xx' END AS canonical, doc_id AS entry_id, sum(len(string_split(text, name)) - 1)::BIGINT AS n, count(*)::BIGINT AS names FROM documents, {NAMES} WHERE contains(text, name) GROUP BY ALL""",
)
def entity_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mentions.counted_names(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "entry_id"), ["thand", "über", "ción", "tion of"], id_col="entry_id")
    variants = spark.createDataFrame([("thand", "en"), ("tion of", "en"), ("über", "xx"), ("ción", "xx")], "variant string, canonical string")
    return mentions.participations(counted, variants)


@query("2.3.15", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_name = 'blue bolt' THEN 0 ELSE 1 END, p_partkey) rn FROM part WHERE contains(p_name, 'blue bolt')) WHERE rn = 1")
def exact_then_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.task_cast(part_nodes(spark, sf_dir), "blue bolt").select(F.col("entry_id").alias("p_partkey"))


@query(
    "2.3.16 2.3.27",
    """WITH a AS (SELECT DISTINCT CASE WHEN p_partkey % 10 = 0 THEN p_name ELSE p_brand || ' ' || p_partkey END AS variant, p_type AS canonical FROM part), v AS (SELECT variant, min(canonical) AS one, count(*) AS n FROM a GROUP BY variant),
    r AS (SELECT DISTINCT unnest([p_name, p_brand || ' ' || p_partkey, p_type, p_brand]) AS raw FROM part)
    SELECT raw, CASE WHEN raw IN (SELECT canonical FROM a) THEN raw WHEN n = 1 THEN one END AS canonical, CASE WHEN raw IN (SELECT canonical FROM a) THEN 1 ELSE coalesce(n, 0) END::BIGINT AS candidates FROM r LEFT JOIN v ON raw = variant""",
)
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names (types), aliases of one type, names shared by several, and names that are no alias."""
    parts, numbered = table(spark, sf_dir, "part"), F.concat_ws(" ", "p_brand", "p_partkey")
    aliases = parts.select(F.when(F.col("p_partkey") % 10 == 0, F.col("p_name")).otherwise(numbered).alias("variant"), F.col("p_type").alias("canonical"))
    return mentions.resolved(parts.select(F.explode(F.array("p_name", numbered, "p_type", "p_brand")).alias("raw")).distinct(), "raw", aliases)


@query(
    "2.3.17 2.3.19",
    f"""WITH e AS {EDGES}, o AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position, target) rn FROM e) WHERE rn <= 3),
    n AS (SELECT source, target AS neighbour FROM o UNION SELECT target, source FROM e)
    SELECT source, neighbour FROM (SELECT source, neighbour, row_number() OVER (PARTITION BY source ORDER BY neighbour) rn FROM n JOIN part ON p_partkey = neighbour WHERE p_type IN ('PROMO','LARGE') AND source <> neighbour) WHERE rn <= 2""",
)
def typed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions: the first three links of a source, and all that link to it."""
    return graph.neighbours(edges(spark, sf_dir), part_nodes(spark, sf_dir), ("PROMO", "LARGE"), limit=3, cap=2).select("source", "neighbour")


@query(
    "2.3.20",
    """WITH n AS (SELECT p_partkey AS entry_id, CASE WHEN p_partkey % 7 = 0 THEN string_split(p_name, ' ')[1] ELSE p_name END AS title, p_type || ' ' || p_brand AS alias FROM part UNION ALL SELECT -n_nationkey - 1, CASE WHEN n_nationkey % 2 = 0 THEN 'PROMO' ELSE n_name END, n_name FROM nation)
    SELECT DISTINCT entry_id, series FROM (SELECT entry_id, title, unnest([string_split(alias, ' ')[1], string_split(title, ' ')[1]]) AS series FROM n) WHERE series <> title AND series IN (SELECT title FROM n)""",
)
def series_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, nations = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    title = F.when(F.col("p_partkey") % 7 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name"))
    nodes = parts.select(F.col("p_partkey").alias("entry_id"), title.alias("title"), F.array(F.concat_ws(" ", "p_type", "p_brand")).alias("aliases"))
    more = nations.select((-F.col("n_nationkey") - 1).cast("long").alias("entry_id"), F.when(F.col("n_nationkey") % 2 == 0, "PROMO").otherwise(F.col("n_name")).alias("title"), F.array("n_name").alias("aliases"))
    return graph.series_links(nodes.unionByName(more)).select("entry_id", "series")


@query(
    "2.3.21 2.3.25 2.3.30 2.3.31",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'fixed' END, o_orderpriority) ELSE o_orderpriority END AS o_orderpriority FROM orders""",
)
def coalesced_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a second source where they are not blank; then repairs of bad values."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    second = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(" ").alias("o_orderstatus"))
    fixes = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("fixed").alias("o_orderpriority"))
    merged = reconcile.coalesced(orders, second, "o_orderkey", ["o_orderstatus"])
    return reconcile.backfilled(merged, fixes, "o_orderkey", "o_orderpriority", F.col("o_orderpriority") == "5-LOW")


DIFF = """SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'deleted' WHEN a.o_orderstatus = 'P' THEN 'baseline' WHEN a.f = b.f THEN 'unchanged' ELSE 'changed' END AS change
    FROM (SELECT o_orderkey, o_orderstatus, o_totalprice f FROM orders WHERE o_orderkey % 10 <> 1) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END f FROM orders WHERE o_orderkey % 10 <> 2) b USING (o_orderkey)"""


@query("2.3.22 2.3.24 2.1.21", DIFF)
def snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 10 <> 1").withColumn("f", F.col("o_totalprice"))
    new = orders.where("o_orderkey % 10 <> 2").withColumn("f", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return reconcile.snapshot_diff(old, new, "o_orderkey", "f", F.col("o_orderstatus") == "P")


@query(
    "2.3.23 2.7.7",
    """SELECT coalesce(a.c, b.c) AS channel, (CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN CASE WHEN a.s = 'stale' THEN 'unchanged' ELSE 'removed' END WHEN a.f IS NULL OR a.f <> b.f OR a.s <> 'ok' THEN 'updated' ELSE 'unchanged' END) AS change, count(*)::BIGINT AS n
    FROM (SELECT source c, doc_id k, CASE WHEN doc_id % 11 <> 0 THEN n_chars END f, CASE WHEN doc_id % 13 = 0 THEN 'stale' WHEN doc_id % 17 = 0 THEN 'bad' ELSE 'ok' END s FROM documents WHERE doc_id % 6 <> 1) a
    FULL JOIN (SELECT source c, doc_id k, n_chars f FROM documents WHERE doc_id % 6 <> 2) b ON a.c = b.c AND a.k = b.k GROUP BY ALL""",
)
def manifest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    manifest = docs.where("doc_id % 6 <> 1").withColumn("n_chars", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")))
    manifest = manifest.withColumn("status", F.when(F.col("doc_id") % 13 == 0, "stale").when(F.col("doc_id") % 17 == 0, "bad").otherwise("ok"))
    found = reconcile.manifest_compare(manifest, docs.where("doc_id % 6 <> 2"), "source", "doc_id", "n_chars", "status")
    return found.groupBy(F.col("source").alias("channel"), "change").agg(F.count(F.lit(1)).alias("n"))


@query("2.3.28", "SELECT o_orderkey, o_custkey AS ref FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.facts import broken_references as broken

    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_custkey").alias("refs"))
    return broken(orders, "o_orderkey", "refs", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


@query(
    "2.9.41",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 IN (1, 3) THEN 'include' WHEN p_partkey % 7 = 2 THEN 'exclude' WHEN p_partkey % 7 = 6 THEN 'conflict' ELSE 'unknown' END AS decision,
    CASE p_partkey % 7 WHEN 1 THEN 'metadata' WHEN 2 THEN 'metadata' WHEN 3 THEN 'speaker' WHEN 4 THEN 'mention' WHEN 5 THEN 'inherited' WHEN 6 THEN 'alias' ELSE 'missing' END AS kind FROM part""",
)
def member_situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven situations of evidence for a member: parts whose brand is listed, missing from a complete list, a speaker, mentioned, inherited,
    at odds with an alias, or nowhere."""
    at, brand = F.col("p_partkey") % 7, F.col("p_brand")
    nobody = F.array().cast("array<string>")
    cast = F.when(at.isin(1, 5, 6), F.array(brand)).when(at == 2, F.array("p_type")).when(at == 3, nobody)
    columns = {
        "name": brand,
        "cast": cast,
        "cast_complete": at.isin(1, 2, 5, 6),
        "speakers": F.when(at == 3, F.array(F.concat(brand, F.lit("*")))).otherwise(nobody),
        "text": F.when(at.isin(2, 4), F.concat(F.lit("saw "), brand)).otherwise(F.col("p_name")),
        "scope_matches": at != 5,
        "conflicting": F.when(at == 6, F.array(F.concat(brand, F.lit("*")))).otherwise(nobody),
    }
    rows = table(spark, sf_dir, "part").select("p_partkey", *[value.alias(name) for name, value in columns.items()])
    return stats.member_evidence(rows, F.col("name"), F.array(F.concat("name", F.lit("*")))).select("p_partkey", "decision", "kind")


@query(
    "2.2.18 2.6.11",
    r"""WITH r AS (SELECT doc_id, doc_id % 4 AS kind, CASE WHEN doc_id % 8 = 3 THEN 'thand: ' || text ELSE text END AS body FROM documents),
    g AS (SELECT doc_id, len(string_split(body, 'thand')) - 1 AS n, CASE WHEN kind = 0 THEN 'cast' WHEN kind = 1 OR NOT contains(body, 'thand') THEN NULL
    WHEN list_contains(regexp_extract_all(body, '(?m)^\s*\*?\s*([^\s：:（(*]{1,20})\s*(?:[（(][^）)\n]*[）)])?\s*[：:]', 1), 'thand') THEN 'line' WHEN regexp_matches(body, 'thand[^\n。！？]{0,6}?the') THEN 'action' ELSE 'mention' END AS level FROM r)
    SELECT doc_id, level, CASE level WHEN 'cast' THEN 4 WHEN 'line' THEN 3 WHEN 'action' THEN 2 ELSE 1 END AS weight FROM g WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY level ORDER BY n DESC, doc_id) <= 8""",
)
def graded_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence grades with a floor, the best eight of each: a list that is there decides alone."""
    key = F.col("doc_id")
    cast = F.when(key % 4 == 0, F.array(F.lit("thand"))).when(key % 4 == 1, F.array(F.lit("other"))).when(key % 4 == 2, F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", cast.alias("cast"), F.when(key % 8 == 3, F.concat(F.lit("thand: "), "text")).otherwise(F.col("text")).alias("body"))
    graded = stats.graded_evidence(rows, ["thand"], actions=("the",)).where("weight > 0")
    return ranking.first_rows(graded, ["level"], [F.desc("mentions"), "doc_id"], 8).select("doc_id", "level", "weight")
