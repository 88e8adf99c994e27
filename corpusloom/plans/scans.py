"""Section 2.1: scans, sources and sinks. Each query writes what it reads to the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.base import query, table
from corpusloom.session import ensure_checkpoint_dir
from corpusloom.sources import files, landed, models, paged, vectors


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scan-{name}-{uuid.uuid4().hex}"


@query("2.1.1 2.1.5 2.1.6 2.1.19", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    path = scratch(spark, "json")
    files.written(nations, path)
    return files.json_lines(spark, path, "n_nationkey int, n_name string, n_regionkey int").unionByName(files.keyed_json(spark, f"{path}/absent.json", nations.schema))


@query(
    "2.1.2 2.1.3",
    """SELECT n_name, coalesce(note, 'none') AS note FROM (SELECT n_name, 'static' AS note FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_name, NULL FROM nation WHERE n_regionkey > 0 AND n_regionkey < 3)""",
)
def augmented_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static table, then what several files add to it."""
    nations, folder = table(spark, sf_dir, "nation"), scratch(spark, "many")
    for part in (1, 2):
        array = nations.where(F.col("n_regionkey") <= part).agg(F.to_json(F.collect_list(F.struct("n_name"))).alias("value"))
        array.write.text(f"{folder}/quests_{part}")  # 25 names at most
    found = files.many_files(spark, f"{folder}/quests_*", "n_name string", without="processed")
    static = nations.where("n_regionkey = 0").select("n_name", F.lit("static").alias("note"))
    return files.augmented(static, found, "n_name", {"note": "none"}).select("n_name", "note")


@query("2.1.4", "SELECT n_name AS key, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    maps = joined.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "r_name"))).alias("m"))
    return files.map_entries(maps, "m")


@query("2.1.7 2.1.8 2.1.9", "SELECT collection, n FROM (SELECT 'label' || label AS collection, count(*)::BIGINT AS n FROM embeddings WHERE label <> 1 GROUP BY 1 UNION ALL VALUES ('label99', 0::BIGINT), ('label1', 0::BIGINT))")
def vector_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append, drop one collection, count the named ones."""
    path = scratch(spark, "vectors")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("").alias("document"), "embedding", F.concat(F.lit("label"), "label").alias("collection"))
    labels = table(spark, sf_dir, "embeddings").agg(F.max("label") + 1).first()[0]
    vectors.add(rows, path)
    vectors.drop(spark, path, "label1")
    return vectors.counts(vectors.collections(spark, path), [f"label{n}" for n in (*range(labels), 99)])


@query("2.1.8", "SELECT vec_id::VARCHAR AS id, round(sqrt(list_dot_product(u, u)), 4) AS norm, round(u[1], 4) AS first, round(u[64], 4) AS last FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)")
def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.retrieval import dot, unit

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), unit(F.col("embedding")).alias("u"))
    return rows.select("id", F.round(F.sqrt(dot(F.col("u"), F.col("u"))), 4).alias("norm"), F.round(F.col("u")[0], 4).alias("first"), F.round(F.col("u")[63], 4).alias("last"))


@query("2.1.10 2.8.10", "SELECT l_orderkey AS source, l_partkey AS target, min(l_linenumber) AS position FROM lineitem GROUP BY ALL")
def graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with nested links, written in id order, read with their schema and exploded again."""
    from corpusloom.operators.graph import edges_of

    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("p"))
    entries = items.groupBy(F.col("l_orderkey").alias("entry_id")).agg(F.array_sort(F.collect_list(F.struct("p", "l_partkey"))).alias("links"))
    entries = entries.select("entry_id", F.transform("links", lambda x: F.struct(x["l_partkey"].alias("target_id"), x["p"].cast("string").alias("target_name"))).alias("links"))
    back = files.written(entries, scratch(spark, "graph"), one_order=["entry_id"])
    return edges_of(back).select("source", "target", F.col("name").cast("int").alias("position"))


@query("2.1.11", "SELECT r_name AS name, 'body ' || r_regionkey AS body FROM region WHERE r_regionkey <> 4")
def front_matter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown with a JSON head; one head is broken on purpose."""
    folder = scratch(spark, "pages")
    head = F.when(F.col("r_regionkey") == 4, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("r_name").alias("name"))))
    page = F.concat(F.lit("---\n"), head, F.lit("\n---\nbody "), F.col("r_regionkey"))
    table(spark, sf_dir, "region").repartition(5, "r_regionkey").select(page.alias("value"), "r_regionkey").write.partitionBy("r_regionkey").option("lineSep", "\u0001").text(folder)
    rows = files.front_matter(spark, f"{folder}/*/*.txt", "name string")
    return rows.where("name is not null").select("name", F.regexp_replace("body", "\u0001", "").alias("body"))


@query(
    "2.1.12 2.1.13 2.1.14",
    """SELECT 'r' || r_regionkey AS region, count(*)::BIGINT AS pins, (count(*) FILTER (WHERE n_nationkey % 5 = 4))::BIGINT AS stale, (count(*) FILTER (WHERE n_nationkey % 7 = 6 AND n_nationkey % 5 <> 4))::BIGINT AS missing, bool_and(n_nationkey % 5 <> 4 AND n_nationkey % 7 <> 6) AS bound
    FROM (SELECT r_regionkey, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY ALL""",
)
def pinned_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read as bytes against the digests of what was declared: some have changed, some were never there."""
    nations, folder = table(spark, sf_dir, "nation"), scratch(spark, "resources")
    key = F.col("n_nationkey")
    nations.select(F.concat("n_name", F.when(key % 5 == 4, "!").otherwise("")).alias("value"), F.concat(F.lit("n"), key.cast("string")).alias("part")).repartition(25, "part").write.partitionBy("part").option("lineSep", ";").text(folder)
    found = files.binary(spark, f"{folder}/*/*.txt").select(F.regexp_replace(F.decode("content", "UTF-8"), "[!;]", "").alias("name"), "content", "sha256")
    pins = nations.select(F.when((key % 7 == 6) & (key % 5 != 4), F.concat("n_name", F.lit("?"))).otherwise(F.col("n_name")).alias("name"), F.sha2(F.concat("n_name", F.lit(";")).cast("binary"), 256).alias("sha256"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("region"))
    checked = files.pinned(found, pins.select("name", "sha256")).join(pins.select("name", "region"), "name")
    counts = checked.groupBy("region").agg(F.count(F.lit(1)).alias("pins"), F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("status") == "missing").alias("missing"))
    return counts.join(files.all_bound(checked, ["region"]), "region")


@query("2.1.15 2.1.16", "SELECT source AS module, coalesce(reason, 'accepted') AS outcome, count(*)::BIGINT AS n FROM (SELECT source, CASE WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'hash' END AS reason FROM documents WHERE trim(text) <> '' AND text NOT IN ('TODO','...')) GROUP BY ALL")
def manifest_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest joined to bodies: accepted and rejected rows with their reasons, written by module."""
    docs = table(spark, sf_dir, "documents").where((F.trim("text") != "") & ~F.col("text").isin("TODO", "..."))
    name = F.col("doc_id").cast("string").alias("name")
    bodies = docs.where("doc_id % 10 <> 1").select(name, F.col("text").cast("binary").alias("content")).withColumn("sha256", F.sha2("content", 256))
    digest = F.when(F.col("doc_id") % 10 == 2, F.lit("0")).when(F.col("doc_id") % 10 == 3, F.lit(None)).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    done = files.imported(docs.select(name, F.col("source").alias("module"), digest.alias("sha256")), bodies)
    back = files.written(done.select("name", "reason", "module"), scratch(spark, "modules"), by=["module"])
    return back.groupBy("module", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "2.1.17 2.1.18 2.1.26",
    """SELECT module, count(*)::BIGINT AS n, min(record_id) AS first FROM (SELECT 'parts' AS module, p_partkey::VARCHAR AS record_id FROM part UNION ALL SELECT 'nations', n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'texts', doc_id::VARCHAR FROM documents) GROUP BY module""",
)
def union_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    parts = files.record(table(spark, sf_dir, "part"), "parts", F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.lit("part"), F.col("p_partkey"), F.create_map(F.lit("brand"), "p_brand"))
    nations = files.record(table(spark, sf_dir, "nation"), "nations", F.col("n_nationkey"), F.col("n_name"), F.lit(""), F.lit("nation"), F.col("n_nationkey"), empty)
    texts = files.record(table(spark, sf_dir, "documents"), "texts", F.col("doc_id"), F.lit(""), F.col("text"), F.lit("documents"), F.col("doc_id"), empty)
    return files.union_of([parts, nations, texts]).groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))


@query("2.1.20 2.1.21 2.1.22", "SELECT page_id AS pageid, url AS title, length(html)::BIGINT AS lastrevid FROM pages")
def landed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "landed")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pageid"), F.col("url").alias("title"), F.length("html").cast("long").alias("lastrevid"), F.col("html").alias("content"))
    pages.write.json(path)
    return landed.landed_pages(spark, path).where("error is null").select("pageid", "title", "lastrevid")


def _letters():
    """A model that embeds a text as its numbers of vowels; it refuses the first batch that it sees and skips some rows at first."""
    seen: dict[str, int] = {}

    def model(rows: list[tuple]) -> list:
        seen["batches"] = seen.get("batches", 0) + 1
        if seen["batches"] == 1:
            raise TimeoutError("busy")
        return [None if at % 7 == 3 and len(rows) > 20 else [float((text or "").count(letter)) for letter in "aeiou"] for at, (text,) in enumerate(rows)]

    return model


@query(
    "2.1.23 2.1.8",
    """WITH v AS (SELECT conv_id || '-' || turn AS id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda x: (length(text) - length(replace(text, x, '')))::DOUBLE) AS e FROM conversations WHERE text IS NOT NULL),
    n AS (SELECT *, sqrt(list_dot_product(e, e)) AS s FROM v) SELECT id, round((CASE WHEN s > 0 THEN e[1] / s ELSE 0 END)::FLOAT::DOUBLE, 4) AS a, round((CASE WHEN s > 0 THEN e[5] / s ELSE 0 END)::FLOAT::DOUBLE, 4) AS u FROM n""",
)
def embedded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns embedded by a model that fails at times, written to a collection as unit vectors and read back."""
    path = scratch(spark, "embedded")
    turns = table(spark, sf_dir, "conversations").where("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("document"), F.lit("turns").alias("collection"))
    vectors.add(models.answered(turns, ["document"], _letters, "array<float>", "embedding", tries=6), path)
    back = vectors.collections(spark, path, ["turns"])
    return back.select("id", F.round(F.col("embedding")[0].cast("double"), 4).alias("a"), F.round(F.col("embedding")[4].cast("double"), 4).alias("u"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("pageid"), F.col("url").alias("title"), F.length("html").cast("long").alias("lastrevid"), F.col("html").alias("content"))


@query("2.1.20 2.1.21 2.1.22", "SELECT page_id AS pageid, url AS title, length(html)::BIGINT AS lastrevid, length(html)::BIGINT AS n, (page_id // 25)::BIGINT AS token FROM pages")
def paged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that land in three pieces, read by a stream that ends after each and goes on from its last token."""
    folder, pages = scratch(spark, "paged"), _responses(spark, sf_dir)
    spark.dataSource.register(paged.Paged)
    bounds = pages.agg(F.percentile_approx("pageid", F.array(F.lit(0.3), F.lit(0.7))).alias("b")).first()["b"]
    cuts = [None, *(25 * (at // 25) for at in bounds or []), None]
    for low, high in zip(cuts, cuts[1:], strict=False):
        piece = pages.where(F.col("pageid") >= low) if low is not None else pages
        paged.land(piece.where(F.col("pageid") < high) if high is not None else piece, f"{folder}/in")
        stream = spark.readStream.format("paged").option("path", f"{folder}/in").load().where("error is null")
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    read = spark.read.parquet(f"{folder}/out")
    return read.select("pageid", "title", "lastrevid", F.length("content").cast("long").alias("n"), F.col("token").cast("long").alias("token"))


@query("2.1.20 2.1.21", "SELECT page_id AS pageid, url AS title FROM pages WHERE page_id >= 25 AND length(html) > 2000")
def paged_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in one batch: those of earlier tokens are not opened, and pages are compared where they are read."""
    folder = scratch(spark, "paged")
    paged.land(_responses(spark, sf_dir), folder)
    spark.dataSource.register(paged.Paged)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pages = spark.read.format("paged").option("path", folder).load()
    return pages.where((F.col("token") >= "000000000001") & (F.col("lastrevid") > 2000)).select("pageid", "title")


@query("2.1.24 2.1.25", "SELECT role AS tenant, 's' || (conv_id % 50) AS session, max(conv_id * 100 + turn) AS stamp FROM conversations GROUP BY ALL")
def session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended states; the newest of each session counts, illegal ids do not."""
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("tenant"), F.concat(F.lit("s"), F.col("conv_id") % 50).alias("session"), (F.col("conv_id") * 100 + F.col("turn")).alias("stamp"))
    illegal = rows.withColumn("session", F.lit("../x"))
    back = files.written(rows.unionByName(illegal), scratch(spark, "sessions"), form="parquet")
    return files.latest_sessions(back, "tenant", "session", "stamp").select("tenant", "session", "stamp")


@query(
    "2.1.27 2.9.36",
    """WITH v AS (SELECT p_partkey, p_name, p_type, p_brand, p_size FROM part WHERE p_partkey % 11 > 0) SELECT p_partkey, 0 AS module, 'names' AS module_name, 0 AS component, p_brand AS component_id, i::INT AS row, string_split(p_name, ' ')[i + 1] AS value FROM v, range(0, 2) t(i)
    UNION ALL SELECT p_partkey, 1, 'kinds', 0, 'c2', 0, p_type FROM v UNION ALL SELECT p_partkey, 1, 'kinds', 2, 'c4', 0, p_size::VARCHAR FROM v""",
)
def exploded_page_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nested pages; a component without rows gives none, and neither does a malformed page."""

    def component(name, rows):
        return F.struct(name.alias("id"), rows.alias("rows"))

    def module(name, *components):
        return F.struct(F.lit(name).alias("name"), F.array(*components).alias("components"))

    kinds = [component(F.lit("c2"), F.array("p_type")), component(F.lit("c3"), F.array().cast("array<string>")), component(F.lit("c4"), F.array(F.col("p_size").cast("string")))]
    page = F.to_json(F.struct(F.array(module("names", component(F.col("p_brand"), F.split("p_name", " "))), module("kinds", *kinds)).alias("modules")))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 > 0, page).otherwise("{broken").alias("raw"))
    return files.exploded_modules(pages, "raw", "modules array<struct<name:string,components:array<struct<id:string,rows:array<string>>>>>").drop("raw")
