"""Section 2.8: graphs, iteration and mention indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking, graph, incremental, mentions
from corpusloom.plans.base import query, table

LINKS = """(SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION SELECT 's' || l_suppkey, 'o' || l_orderkey FROM lineitem)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    o, p, s = (F.concat(F.lit(mark), name) for mark, name in (("o", "l_orderkey"), ("p", "l_partkey"), ("s", "l_suppkey")))
    pairs = [items.select(o.alias("source"), p.alias("target")), items.select(p.alias("source"), s.alias("target")), items.select(s.alias("source"), o.alias("target"))]
    return pairs[0].union(pairs[1]).union(pairs[2])


BFS = f"""WITH RECURSIVE e AS {LINKS}, r(node, depth) AS (SELECT 'o7', 0 UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.source = r.node WHERE r.depth < 4) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node"""


@query("2.8.1", BFS)
def closure_of_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("o7",)], "node string")
    return graph.closure(_links(spark, sf_dir), seeds, 4).select("node", "depth")


DIRTY = f"""WITH RECURSIVE e AS {LINKS}, r(node, seed, depth) AS (SELECT seed, seed, 0 FROM (VALUES ('s1'), ('s3')) v(seed) UNION SELECT e.source, r.seed, r.depth + 1 FROM r JOIN e ON e.target = r.node WHERE r.depth < 3) SELECT node, seed, min(depth)::INT AS depth FROM r GROUP BY ALL"""


@query("2.8.3 2.8.4 2.10.10", DIRTY)
def dirty_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along reversed edges, for each origin by itself."""
    edges = _links(spark, sf_dir).toDF("consumer", "dependency")
    return graph.marked_dirty(edges, spark.createDataFrame([("s1",), ("s3",)], "node string"), 3).select("node", "seed", "depth")


@query("2.8.2", "SELECT p_name AS series, p_partkey AS entry_id, p_size::BIGINT AS hits FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size >= 49)")
def core_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "part").select(F.col("p_name").alias("series"), F.col("p_partkey").alias("entry_id"), F.col("p_size").cast("long").alias("hits"))
    return graph.series_with_core(members, 49).select("series", "entry_id", "hits")


@query("2.8.5", "SELECT 'resolved' AS kind, count(*)::BIGINT AS n FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) UNION ALL SELECT 'unresolved', count(*)::BIGINT FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dependency_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_custkey").alias("refs"))
    good, bad = incremental.dependencies(pages, "o_orderkey", "refs", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")
    return good.select(F.lit("resolved").alias("kind")).unionByName(bad.select(F.lit("unresolved").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "2.8.6",
    """SELECT 'root' AS node, '' AS path UNION ALL SELECT 'r' || r_regionkey, r_regionkey::VARCHAR FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey || '.' || n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'c' || c_custkey, n_regionkey || '.' || n_nationkey || '.' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def dialogue_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers below a root; customers point back to their regions, which are read already."""

    def edge(source, position, target):
        return [source.alias("source"), F.col(position).cast("int").alias("position"), target.alias("target")]

    def node(mark, name):
        return F.concat(F.lit(mark), F.col(name).cast("string"))

    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    edges = table(spark, sf_dir, "region").select(*edge(F.lit("root"), "r_regionkey", node("r", "r_regionkey")))
    edges = edges.unionByName(nations.select(*edge(node("r", "n_regionkey"), "n_nationkey", node("n", "n_nationkey"))))
    edges = edges.unionByName(customers.select(*edge(node("n", "c_nationkey"), "c_custkey", node("c", "c_custkey"))))
    edges = edges.unionByName(customers.select(*edge(node("c", "c_custkey"), "c_nationkey", F.lit("r0"))))
    return graph.paths_from(edges, spark.createDataFrame([("root",)], "node string"), 10).select("node", F.array_join("path", ".").alias("path"))


@query(
    "2.8.7",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 OR p_partkey % 11 = 0 OR p_name = 'old bolt' THEN NULL WHEN split_part(p_name, ' ', 1) IN ('small', 'cold', 'old') AND split_part(p_name, ' ', 2) IN ('ring', 'bolt', 'rod') THEN replace(p_name, ' ', ',') END AS parts FROM part""",
)
def alias_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written together; one of them splits in two ways, some have a part that is no alias, and some are empty."""
    key, joined = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(key % 11 == 0, "").when(key % 4 == 1, F.concat(joined, F.lit("s"))).otherwise(joined).alias("subject"))
    aliases = {name: name for name in ("small", "cold", "old", "ring", "bolt", "rod", "oldbolt")}
    split = chunking.segmentations(rows, "subject", aliases)
    return split.select("p_partkey", F.when(F.col("parts").isNotNull(), F.array_join("parts", ",")).alias("parts"))


NAMES = [("e1", "thand"), ("e1", "andre"), ("e2", "über"), ("e3", "tion of"), ("e4", "ción")]


@query(
    "2.8.8",
    """SELECT name, count(*)::BIGINT AS texts, sum(len(string_split(text, name)) - 1)::BIGINT AS hits, min(instr(text, name) - 1)::BIGINT AS first FROM documents, (VALUES ('thand'), ('über'), ('tion of'), ('ción')) n(name) WHERE contains(text, name) GROUP BY name""",
)
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None of these names overlaps itself, so plain counts agree with the automaton's."""
    names = spark.createDataFrame([(n, n) for _, n in NAMES if n != "andre"], "entity_id string, name string")
    found = mentions.mention_index(table(spark, sf_dir, "documents"), names)
    return found.groupBy(F.col("entity_id").alias("name")).agg(F.count(F.lit(1)).alias("texts"), F.sum("pattern_hits").alias("hits"), F.min("first_start").alias("first"))


@query("2.4.18 2.8.8 2.9.13", "SELECT doc_id AS entry_id, concat_ws(',', CASE WHEN contains(text, 'thand') OR contains(text, 'andre') THEN 'e1' END, CASE WHEN contains(text, 'über') THEN 'e2' END, CASE WHEN contains(text, 'tion of') THEN 'e3' END, CASE WHEN contains(text, 'ción') THEN 'e4' END) AS entities FROM documents WHERE regexp_matches(text, 'thand|andre|über|tion of|ción')")
def inverted_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions.mention_index(table(spark, sf_dir, "documents"), spark.createDataFrame(NAMES, "entity_id string, name string"))
    return mentions.inverted(found).select("entry_id", F.array_join("entities", ",").alias("entities"))


@query("2.4.18 2.4.19", "SELECT name, count(*)::BIGINT AS entries, sum(n)::BIGINT AS hits, (sum(n) - coalesce(sum(n) FILTER (WHERE doc_id % 2 = 0), 0))::BIGINT AS delta FROM (SELECT name, doc_id, len(string_split(text, name)) - 1 AS n FROM documents, (VALUES ('thand'), ('über')) v(name) WHERE contains(text, name)) GROUP BY name")
def mention_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a previous run over half of the texts."""
    now = mentions.counted_names(table(spark, sf_dir, "documents"), ["thand", "über"])
    return mentions.index_stats(now, now.where("doc_id % 2 = 0"), "name")


@query(
    "2.8.10",
    """SELECT o_orderkey::VARCHAR AS entry_id, o_orderstatus AS title, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS links FROM orders WHERE o_orderkey % 5 > 0""",
)
def entries_from_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as JSON items; a target with two names loses its links, and a malformed item is left out."""
    key = F.col("o_orderkey")

    def link(target, name):
        return F.struct(target.cast("string").alias("target_id"), F.col(name).alias("target_name"))

    buyer, day = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderdate")
    once = F.array(link(buyer, "o_orderstatus"), link(day, "o_orderpriority"))
    twice = F.array(link(buyer, "o_orderstatus"), link(buyer, "o_orderpriority"), link(day, "o_orderpriority"))
    item = F.to_json(F.struct(key.cast("string").alias("id"), F.col("o_orderstatus").alias("title"), F.when(key % 3 == 0, twice).otherwise(once).alias("links")))
    raw = table(spark, sf_dir, "orders").select(F.when(key % 5 == 0, F.lit("{broken")).otherwise(item).alias("raw"))
    schema = "id string, title string, links array<struct<target_id:string,target_name:string>>"
    entries = graph.entries_from_items(raw, "raw", schema, F.col("_item.id"), F.col("_item.title"), F.col("_item.links"))
    links = graph.without_ambiguous_links(graph.edges_of(entries)).groupBy(F.col("source").alias("entry_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return entries.join(links, "entry_id", "left").select("entry_id", "title", F.coalesce("n", F.lit(0)).alias("links"))


@query("2.8.9 2.8.11", "SELECT p_partkey AS entry_id, CASE WHEN p_type IN ('PROMO','LARGE') THEN p_type WHEN p_size > 25 THEN 'big' ELSE 'unknown' END AS entry_kind, p_type NOT IN ('PROMO','LARGE') AS violation FROM part")
def legal_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_type").alias("entry_kind"), "p_size")
    return graph.default_kinds(entries, ["PROMO", "LARGE"], default=F.when(F.col("p_size") > 25, "big").otherwise("unknown")).select("entry_id", "entry_kind", "violation")


@query("2.8.12 2.1.28", "SELECT count(*)::BIGINT AS links, count(DISTINCT href)::BIGINT AS targets, (count(DISTINCT href) FILTER (WHERE href NOT IN (SELECT url FROM pages)))::BIGINT AS missing FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("href").agg(F.count(F.lit(1)).alias("n"))
    known = pages.select(F.col("url").alias("href"), F.lit(True).alias("known")).distinct()
    return links.join(known, "href", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.count(F.lit(1)).alias("targets"), F.count_if(F.col("known").isNull()).alias("missing"))
