"""Section 2.9: strings, hashes, versions, arrays, JSON and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import markup, normal, text
from corpusloom.operators import chunking, content, facts, incremental, nested, reconcile
from corpusloom.plans.base import query, table


@query(
    "2.9.1 2.9.2",
    r"""WITH r AS (SELECT conv_id, turn, trim(regexp_replace(chr(9) || text || ' (' || role || ')？' || chr(10), '[\x00-\x1f\x7f]', ' ', 'g')) AS prompt FROM conversations)
    SELECT conv_id, turn, md5(prompt) AS prompt, left(trim(regexp_replace(regexp_replace(prompt, '[（(][^）)]*[）)]', '', 'g'), '[？！。，、；：\s]+$', '')), 200) AS query FROM r""",
)
def cleaned_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns asked with a bracketed remark and control characters around them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("\t"), "text", F.lit(" ("), "role", F.lit(")？\n")).alias("raw"))
    return rows.select("conv_id", "turn", F.md5(text.cleaned_prompt("raw").cast("binary")).alias("prompt"), text.cleaned_query("raw").alias("query"))


@query(
    "2.9.4 2.9.35",
    """WITH q AS (SELECT p_partkey AS id, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN substring(p_name, 2) WHEN 1 THEN p_name || 's' WHEN 2 THEN 'lost ' || p_brand ELSE left(p_name, 7) END AS b FROM part),
    t AS (SELECT DISTINCT p_name AS title FROM part), k AS (SELECT b, bool_or(contains(title, b)) AS known FROM (SELECT DISTINCT b FROM q), t GROUP BY b)
    SELECT id, array_to_string(list_sort(list_distinct([a, b])), ',') AS quoted, CASE WHEN known THEN '' ELSE b END AS missing FROM q JOIN k USING (b)""",
)
def quoted_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted terms of a question a part, and those that no title contains: the index of titles is asked for each distinct term once."""
    key, name = F.col("p_partkey") % 4, F.col("p_name")
    other = F.when(key == 0, F.substring("p_name", 2, 99)).when(key == 1, F.concat("p_name", F.lit("s"))).when(key == 2, F.concat(F.lit("lost "), "p_brand")).otherwise(F.left("p_name", F.lit(7)))
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("is 「"), name, F.lit("」 like “"), other, F.lit("”?")).alias("q"))
    terms = asked.select("id", F.explode(F.array_distinct(text.quoted_terms("q"))).alias("term")).checkpoint()
    titles = table(spark, sf_dir, "part").select(F.col("p_name").alias("text"))
    known = content.contained(terms.select(F.col("term").alias("text")), titles, least=2).select(F.col("asked").alias("d")).distinct().withColumn("known", F.lit(True))
    joined = terms.withColumn("d", F.md5("term")).join(known, "d", "left")
    missing = F.array_join(F.sort_array(F.collect_list(F.when(F.col("known").isNull(), F.col("term")))), ",")
    return joined.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("term")), ",").alias("quoted"), missing.alias("missing"))


@query("2.9.5 2.9.8", None)
def best_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.best_windows(table(spark, sf_dir, "documents"), ["thand", "license", "über"])


@query(
    "2.9.6",
    """WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || 's' WHEN 1 THEN 'of a ' || p_name ELSE p_name END AS q, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'ring' END AS leaf FROM part)
    SELECT p_partkey, contains(leaf, q) OR contains(leaf, q[:-2]) OR contains(leaf, q[:-3]) OR contains(q, leaf) AS hit FROM r""",
)
def trimmed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    q = F.when(key % 3 == 0, F.concat("p_name", F.lit("s"))).when(key % 3 == 1, F.concat(F.lit("of a "), "p_name")).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", q.alias("q"), F.when(key % 2 == 0, F.col("p_name")).otherwise(F.lit("ring")).alias("leaf"))
    variants = F.filter(F.array(F.col("q"), F.expr("left(q, length(q) - 1)"), F.expr("left(q, length(q) - 2)")), lambda v: F.length(v) > 1)
    return rows.select("p_partkey", (F.exists(variants, lambda v: F.col("leaf").contains(v)) | F.col("q").contains(F.col("leaf"))).alias("hit"))


@query(
    "2.9.9 2.5.10",
    r"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), 'https?://\S+', '', 'g'), ' ') AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l WHERE x <> '')
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS lines, coalesce(again, 0)::BIGINT AS again, md5(coalesce(body, '')) AS digest FROM documents d LEFT JOIN
    (SELECT doc_id, count(*) FILTER (WHERE x IS DISTINCT FROM before) AS n, count(*) FILTER (WHERE x = before) AS again, string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE x IS DISTINCT FROM before) AS body FROM k GROUP BY doc_id) USING (doc_id)""",
)
def cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without URLs, blank lines and lines that repeat the one before; how many lines are left and how many repeated."""
    body = F.coalesce(text.without_repeated_lines("text"), F.lit(""))
    every = F.size(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"https?://\S+", ""))), lambda x: x != ""))
    n = F.when(body == "", 0).otherwise(F.size(F.split(body, "\n")))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("lines"), F.coalesce(every - n, F.lit(0)).cast("long").alias("again"), F.md5(body.cast("binary")).alias("digest"))


@query(
    "2.9.10 2.9.38",
    "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat_ws(',', CASE WHEN length(p_name) <= 10 THEN p_name END, p_brand, p_type) END AS names FROM part",
)
def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in brackets, repeated, too long, or with a dirty mark; null for every eleventh row."""
    raw = F.concat(F.lit("["), "p_name", F.lit("]、"), "p_brand", F.lit("/"), "p_type", F.lit("，"), "p_name", F.lit(";size="), F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, raw).alias("raw"))
    return rows.select("p_partkey", F.array_join(text.name_list("raw", longest=10), ",").alias("names"))


@query(
    "2.9.11",
    r"""SELECT conv_id, turn, array_to_string(regexp_extract_all('* ' || role || '：' || text || chr(10) || 'Bob (low): yes', '(?m)^\s*\*?\s*([^\s：:（(*]{1,20})\s*(?:[（(][^）)\n]*[）)])?\s*[：:]', 1), ',') AS names FROM conversations""",
)
def dialogue_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("* "), "role", F.lit("："), "text", F.lit("\nBob (low): yes"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.speakers(said), ",").alias("names"))


@query("2.9.12", "SELECT p_partkey, lower(regexp_replace(p_name || '·' || p_brand, '[ ·#]', '', 'g')) AS squeezed, p_name AS base FROM part")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit("·"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.squeezed(name).alias("squeezed"), text.base_name(name).alias("base"))


@query("2.9.13 2.9.17", "SELECT doc_id, (len(string_split(text, 'th')) - 1)::BIGINT AS n, (len(string_split(text, chr(10))) - 1)::BIGINT AS line_ends FROM documents")
def substring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.occurrences("text", "th").alias("n"), text.occurrences("text", "\n").alias("line_ends"))


@query(
    "2.9.13",
    "SELECT page_id, len(string_split(url, 'thth')) - 1 AS apart, len(list_filter(range(1, length(url) + 1), lambda x: url[x:x + 3] = 'thth')) AS overlapping FROM pages",
)
def overlapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.occurrences("url", "thth").alias("apart"), text.overlapping_occurrences("url", "thth").alias("overlapping"))


@query(
    "2.9.14",
    """WITH p AS (SELECT b.doc_id AS needle, a.doc_id, a.text AS h, b.text AS t, length(b.text) AS n FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 UNION ALL SELECT doc_id, doc_id, text[21:], text, length(text) FROM documents),
    s AS (SELECT *, range(0, greatest(n - 25, 0) + 1, greatest(1, floor((n - 24) / 20)::BIGINT))[1:20] AS starts FROM p)
    SELECT needle, doc_id, CASE WHEN n = 0 OR length(h) = 0 OR length(h) < n * 0.6 THEN false WHEN n <= 24 THEN contains(h, t) ELSE len(list_filter(starts, lambda x: contains(h, t[x + 1:x + 24]))) >= 0.5 * len(starts) END AS covered FROM s WHERE n IS NOT NULL AND h IS NOT NULL""",
)
def covered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text in the one before it, and in itself without its beginning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = docs.select(F.col("doc_id"), (F.col("doc_id") + 1).alias("needle"), F.col("text").alias("h"))
    pairs = before.join(docs.select(F.col("doc_id").alias("needle"), F.col("text").alias("t")), "needle")
    own = docs.select(F.col("doc_id").alias("needle"), "doc_id", F.expr("substring(text, 21)").alias("h"), F.col("text").alias("t"))
    every = pairs.select("needle", "doc_id", "h", "t").unionByName(own).where("h is not null and t is not null")
    return every.select("needle", "doc_id", reconcile.fragments_covered(F.col("t"), F.col("h")).alias("covered"))


@query("2.9.14", None)
def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a language against the benchmark item of the same number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"))
    pairs = docs.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("b")), "doc_id")
    return reconcile.line_coverage(pairs, "b", "a").select("doc_id", F.round("covered", 6).alias("covered"), F.size("missing").alias("missing"))


@query("2.9.15", None)
def chunked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "total_chunks", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


@query(
    "2.9.16",
    """SELECT doc_id, CASE WHEN src = 1 THEN lang ELSE lang || '@' || source END || CASE WHEN again > 1 THEN '#' || again ELSE '' END AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS again, dense_rank() OVER (PARTITION BY lang ORDER BY (source <> 'src3')::INT, source) AS src FROM documents)""",
)
def unique_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("source") != "src3").cast("int").alias("priority"))
    return chunking.unique_chunk_ids(docs, "lang", "source", "priority", "doc_id").select("doc_id", "chunk_id")


@query(
    "2.9.19",
    """WITH a AS (SELECT c_custkey, c_nationkey AS by_label, CASE c_custkey % 4 WHEN 1 THEN c_nationkey WHEN 2 THEN CASE WHEN c_nationkey < 24 THEN c_nationkey + 1 END END AS by_number, c_custkey % 4 > 0 AS has_number, c_custkey % 3 > 0 AS has_label FROM customer),
    o AS (SELECT *, CASE WHEN has_label AND has_number THEN CASE WHEN by_number IS NULL THEN 'unresolved' WHEN by_number = by_label THEN 'matched' ELSE 'mismatch' END WHEN has_label OR by_number IS NOT NULL THEN 'matched' ELSE 'unknown' END AS outcome FROM a)
    SELECT c_custkey, CASE WHEN outcome = 'matched' THEN 'v' || CASE WHEN has_label THEN by_label ELSE by_number END END AS version_id, outcome FROM o""",
)
def resolved_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for a nation by number, by label, by alias, or by two of them that may differ."""
    nation, key, home = F.col("n_nationkey").cast("string"), F.col("c_custkey"), F.col("c_nationkey")
    registry = table(spark, sf_dir, "nation").select(F.concat(F.lit("v"), nation).alias("version_id"), F.concat(F.lit("1."), nation).alias("numeric"), F.col("n_name").alias("label"), F.array(F.concat(F.lit("N"), nation)).alias("aliases"))
    numeric = F.when(key % 4 == 1, F.concat(F.lit("1."), home.cast("string"))).when(key % 4 == 2, F.concat(F.lit("1."), (home + 1).cast("string"))).when(key % 4 == 3, "9.9")
    label = F.when(key % 3 == 1, F.concat(F.lit("NATION_"), home.cast("string"))).when(key % 3 == 2, F.concat(F.lit("N"), home.cast("string")))
    asked = table(spark, sf_dir, "customer").select("c_custkey", numeric.alias("numeric"), label.alias("label"))
    return facts.resolve_versions(asked, registry).select("c_custkey", "version_id", "outcome")


@query(
    "2.9.19 2.9.31",
    """WITH r AS (SELECT n_nationkey AS k, n_nationkey * 7 % 20 AS n FROM nation) SELECT '1.' || n AS key, 'duplicate_numeric' AS problem FROM r GROUP BY n HAVING count(*) > 1
    UNION ALL SELECT 'v' || k, 'order' FROM r WHERE EXISTS (SELECT 1 FROM r l WHERE l.k > r.k AND l.n < r.n)""",
)
def registry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that repeat, and numbers that do not rise in the declared order."""
    key = F.col("n_nationkey")
    numeric = F.concat(F.lit("1."), (key * 7 % 20).cast("string"))
    registry = table(spark, sf_dir, "nation").select(F.concat(F.lit("v"), key.cast("string")).alias("version_id"), numeric.alias("numeric"), F.col("n_name").alias("label"), key.cast("int").alias("order"))
    return facts.registry_violations(registry)


@query(
    "2.9.20",
    """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE array_to_string(list_sort(list_filter(list_concat(string_split(p_name, ' '), [lower(p_type), 'v1.' || p_size, '山水', '水的']), lambda x: x <> 'red')), ',') END AS tokens FROM part""",
)
def fact_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" "), "p_type", F.lit(" 山水的 V1."), F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, raw).alias("raw"))
    return rows.select("p_partkey", F.array_join(F.sort_array(text.tokens_for_facts("raw", ["red"])), ",").alias("tokens"))


@query("2.9.22 2.9.26", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def json_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("2.9.22", "SELECT json_extract(props, '$.k')::INT % 10 AS bucket, count(*)::BIGINT AS n FROM events GROUP BY 1")
def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, sf_dir, "events").groupBy((value % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# The pointers of a JSON text's nodes, from the tree that the engine makes of it.
POINTERS = """, t AS MATERIALIZED (SELECT {ids}, k.id AS node, k.parent, k.key, k.type, k.value FROM j, json_tree(j.body) k),
    p AS (SELECT {ids}, node, '' AS pointer, type, value FROM t WHERE parent IS NULL
    UNION ALL SELECT {on}, t.node, p.pointer || '/' || replace(replace(t.key::VARCHAR, '~', '~0'), '/', '~1'), t.type, t.value FROM p JOIN t ON {same} AND t.parent = p.node),
    l AS (SELECT {ids}, pointer, CASE WHEN type IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(type) WHEN type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind, CASE WHEN type <> 'NULL' THEN value ->> '$' END AS value
    FROM p WHERE type NOT IN ('OBJECT', 'ARRAY') OR value::VARCHAR IN ('{{}}', '[]'))"""


@query("2.9.22 2.9.26", "WITH RECURSIVE j AS (SELECT event_id, props::JSON AS body FROM events)" + POINTERS.format(ids="event_id", on="t.event_id", same="t.event_id = p.event_id") + " SELECT event_id, pointer, kind, value FROM l")
def property_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of the properties by its pointer."""
    return nested.pointers(table(spark, sf_dir, "events"), ["event_id"], "props").select("event_id", "pointer", "kind", "value")


NESTED = """WITH RECURSIVE l0 AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
    x AS (SELECT conv_id, turn, list(json_object('chars', length(line), 'evidence', json_array(json_object('source_span_id', left(line, 3)), json_object('source_span_id', 'end', 'more', json_object('evidence', json_array(json_object('source_span_id', role)))))) ORDER BY pos) AS lines FROM l0 GROUP BY ALL),
    j AS (SELECT conv_id, turn, json_object('a/b', json_object('c~d', json_array(), 'lines', lines), 'evidence', json_array(json_object('source_span_id', 'turn ' || turn), json_object('else', true)), 'none', NULL) AS body FROM x)"""


def _nested_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON text for each turn: its lines with evidence at three depths, keys that a pointer must escape, an empty list and a null."""

    def line(x):
        deep = F.struct(F.array(F.struct(F.col("role").alias("source_span_id"))).alias("evidence"))
        items = F.array(F.struct(F.left(x, F.lit(3)).alias("source_span_id"), F.lit(None).cast("struct<evidence:array<struct<source_span_id:string>>>").alias("more")), F.struct(F.lit("end").alias("source_span_id"), deep.alias("more")))
        return F.struct(F.length(x).alias("chars"), items.alias("evidence"))

    lines = F.transform(F.split("text", "\n", -1), line)
    inner = F.struct(F.array().cast("array<string>").alias("c~d"), lines.alias("lines"))
    top = F.array(F.struct(F.concat(F.lit("turn "), F.col("turn")).alias("source_span_id"), F.lit(None).cast("boolean").alias("else")), F.struct(F.lit(None).cast("string").alias("source_span_id"), F.lit(True).alias("else")))
    body = F.concat(F.regexp_replace(F.to_json(F.struct(inner.alias("a/b"), top.alias("evidence"))), r"\}$", ""), F.lit(', "none": null}'))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", body.alias("body"))


@query("2.9.22 2.9.26", NESTED + POINTERS.format(ids="conv_id, turn", on="t.conv_id, t.turn", same="t.conv_id = p.conv_id AND t.turn = p.turn") + " SELECT conv_id, turn, pointer, kind, value FROM l")
def nested_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of nested texts by its pointer."""
    return nested.pointers(_nested_turns(spark, sf_dir), ["conv_id", "turn"], "body").select("conv_id", "turn", "pointer", "kind", "value")


@query(
    "2.9.22",
    """WITH l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
    e AS (SELECT conv_id, turn, unnest([left(line, 3), 'end', role]) AS span, pos * 3 + unnest([0, 1, 2]) AS o FROM l UNION ALL SELECT conv_id, turn, 'turn ' || turn, 0 FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(o)) AS place, span FROM e WHERE span <> '' GROUP BY conv_id, turn, span""",
)
def span_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the evidence lists of nested texts name, at any depth, in order and once."""
    return nested.span_citations(_nested_turns(spark, sf_dir), ["conv_id", "turn"], "body")


@query("2.9.23", None)
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_text("html").alias("text"))


@query(
    "2.9.24 2.9.25 2.9.37",
    "SELECT p_partkey, p_name AS name, p_brand AS weapon, 'see ' || p_type || ' here' AS clean, CASE WHEN p_partkey % 5 > 0 THEN 'the plot of ' || p_name END AS story FROM part",
)
def wiki_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as wiki pages and read again; every fifth has no section of that name."""
    heading = F.when(F.col("p_partkey") % 5 > 0, "story").otherwise("notes")
    raw = F.format_string(
        "{{role\n|name = %s\n|weapon = %s\n}}\nsee [[B|%s]] here<!-- no -->\n== %s ==\nthe plot of %s\n== end ==\n", F.col("p_name"), F.col("p_brand"), F.col("p_type"), heading, F.col("p_name")
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    fields = text.template_fields("raw")
    clean = text.stripped(F.get(F.split(text.without_markup("raw"), "=="), 0))
    return rows.select("p_partkey", fields["name"].alias("name"), F.trim(F.substring_index(fields["weapon"], "\n", 1)).alias("weapon"), clean.alias("clean"), text.section("raw", "story").alias("story"))


@query("2.9.26 2.9.28", "SELECT 'added' AS event, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT 'removed', count(*)::BIGINT FROM orders WHERE o_orderkey % 10 = 2 UNION ALL SELECT 'modified', count(*)::BIGINT FROM orders WHERE o_orderkey % 10 = 5")
def fingerprint_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = incremental.fingerprints(orders.where("o_orderkey % 10 <> 1"), "o_orderkey", ["o_orderstatus", "o_totalprice"])
    changed = orders.where("o_orderkey % 10 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 5, "?").otherwise(F.col("o_orderstatus")))
    new = incremental.fingerprints(changed, "o_orderkey", ["o_orderstatus", "o_totalprice"])
    return incremental.change_events(old, new, "o_orderkey").groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query(
    "2.9.27",
    """SELECT doc_id, substring(text, 11, 20) AS quote, CASE WHEN length(text) < 30 THEN 'partial' WHEN doc_id % 3 = 0 THEN 'stale' ELSE 'bound' END AS status FROM documents""",
)
def bound_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.when(F.col("doc_id") % 3 == 0, F.lit("?")).otherwise(F.sha2(F.substring("text", 11, 20).cast("binary"), 256))
    spans = docs.select("doc_id", F.lit(10).alias("start"), F.lit(30).alias("end"), digest.alias("quote_sha256"))
    return incremental.bound_citations(spans, docs.select("doc_id", "text"), "doc_id").select("doc_id", "quote", "status")


@query("2.9.32", "SELECT c_nationkey, arg_max(c_mktsegment, length(c_mktsegment) * 100000 - c_custkey) AS label FROM customer GROUP BY c_nationkey")
def longest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct(F.length("c_mktsegment"), -F.col("c_custkey"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max_by("c_mktsegment", order).alias("label"))


@query("2.9.34 2.11.2", "SELECT count(*)::BIGINT AS n FROM part WHERE p_type = 'PROMO'")
def phrase_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finite phrase grammar in front of a plan; other phrases are refused with null."""
    from corpusloom.plans.evolving import phrase_to_plan

    return phrase_to_plan(spark, sf_dir, "how many PROMO parts are there?")


@query(
    "2.9.35 2.7.10",
    r"""WITH r AS (SELECT doc_id, d.text, ['“' || substring(d.text, 5, 20) || '! ', substring(b.text, 3, 12)] AS quotes FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 10),
    s AS (SELECT *, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS body FROM r)
    SELECT doc_id, array_to_string(list_filter(quotes, lambda q: NOT contains(body, lower(regexp_replace(q, '[^\p{L}\p{N}]+', '', 'g')))), ',') AS unverified,
    concat_ws(',', CASE WHEN NOT contains(text, 'thand') THEN 'thand' END, CASE WHEN NOT contains(text, 'über') THEN 'über' END) AS missing FROM s""",
)
def checked_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two quotes of each text, its own with marks around it and one of a benchmark item, and two names it should hold."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.substring("text", 3, 12).alias("other"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 10).alias("item")).join(items, "item")
    quotes = F.array(F.concat(F.lit("“"), F.substring("text", 5, 20), F.lit("! ")), "other")
    names = F.array(F.lit("thand"), F.lit("über"))
    return docs.select("doc_id", F.array_join(incremental.unverified(quotes, F.col("text")), ",").alias("unverified"), F.array_join(incremental.missing_names(names, F.col("text")), ",").alias("missing"))


@query("2.9.39", "SELECT page_id, CASE WHEN contains(url, 'm.') THEN 'mobile' WHEN regexp_matches(url, '^https') THEN 'secure' ELSE 'plain' END AS type, nullif(regexp_extract(url, '/(en|de|fr|es)/', 1), '') AS region FROM pages")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("url").contains("m."), "mobile").when(F.col("url").rlike("^https"), "secure").otherwise("plain")
    region = F.regexp_extract("url", "/(en|de|fr|es)/", 1)
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("type"), F.when(region != "", region).alias("region"))


@query(
    "2.9.24 2.9.37",
    """WITH t AS (SELECT *, '{{item|' || p_brand || '|size=' || p_size || '}}' AS deep FROM part), m AS (SELECT *, '{{set|[[' || p_type || '|x]]|piece=' || deep || ' new}}' AS mid FROM t),
    r AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN '{{lost|a=' ELSE '{{role|name=' || p_name || '|kit=' END AS head FROM m)
    SELECT p_partkey, 0 AS depth, 'role' AS name, 'kit=' || mid || ';name=' || p_name AS fields, 0 AS start FROM r WHERE p_partkey % 5 > 0
    UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END, 'set', '1=[[' || p_type || '|x]];piece=' || deep || ' new', length(head) FROM r
    UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 2 END, 'item', '1=' || p_brand || ';size=' || p_size, length(head) + position('{{item' IN mid) - 1 FROM r""",
)
def nested_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates three levels deep, with links that hold bars; every fifth outer one is never closed and refused, its inner ones are kept."""
    deep = F.concat(F.lit("{{item|"), "p_brand", F.lit("|size="), "p_size", F.lit("}}"))
    mid = F.concat(F.lit("{{set|[["), "p_type", F.lit("|x]]|piece="), deep, F.lit(" new}}"))
    whole = F.concat(F.lit("{{role|name="), "p_name", F.lit("|kit="), mid, F.lit("}}"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("{{lost|a="), mid)).otherwise(whole).alias("raw"))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("parameters"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    return markup.with_templates(rows, ["p_partkey"], "raw").select("p_partkey", "depth", "name", fields.alias("fields"), "start")


@query(
    "2.9.31",
    """WITH c AS (SELECT event_id, props, event_id % (length(props) + 1) AS n FROM events)
    SELECT event_id, CASE WHEN n = 0 THEN NULL WHEN n <= 6 THEN '{}' WHEN n = length(props) THEN props ELSE left(props, n) || '}' END AS repaired,
    CASE WHEN n > 6 THEN regexp_extract(left(props, n), '[0-9]+')::INT END AS k FROM c""",
)
def cut_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties cut at every offset: the longest beginning that can be closed, and what it says."""
    cut = F.left("props", (F.col("event_id") % (F.length("props") + 1)).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", cut.alias("cut"))
    return markup.with_repaired(rows, ["event_id"], "cut").withColumn("k", F.get_json_object("repaired", "$.k").cast("int"))


RAW = """' 第二幕「' || p_name || '」（变体）·' || p_brand || '！ {{t|x}} [[a|' || p_type || ']] <i>*-_其二'"""


def _deleted(text: str, pattern: str, other: str = "") -> str:
    return f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{other}', 'g')"


def _normal_sql() -> str:
    """Each form as nested replacements of its own."""
    n = normal
    sp = n.SPACE
    flat = _deleted("r", "<[^>]+>")
    forms = {
        "base": "trim(regexp_replace(trim(" + _deleted("r", "[（(][^）)]*[）)]") + "), '·.*$', ''))",
        "title": _deleted("r", f"[{sp}{n.TITLE_MARKS}]"),
        "key": _deleted(flat, f"[{sp}{n.KEY_MARKS}]"),
        "sibling": _deleted(_deleted(_deleted("r", r"\{\{[^{}]*\}\}", " "), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1"), f"[{sp}{n.SIBLING_MARKS}]"),
        "cover": _deleted(_deleted("r", r"\{\{[^{}]*\}\}", " "), r"[^\p{L}\p{N}_]+"),
        "citation": _deleted("r", r"[^\p{L}\p{N}]+"),
        "spaceless": _deleted("r", f"[{sp}]+"),
        "listed": "ltrim(" + _deleted("r", f"[{sp}]+") + ", '*+-：:')",
        "act": "trim(" + _deleted(_deleted("r", f"[{sp}]+"), "^第[0-9一二三四五六七八九十百]+[幕章回]") + ", '「」『』')",
        "map": _deleted(flat, "[^0-9A-Za-z一-鿿]"),
        "map_loose": _deleted(_deleted(flat, "[（(][^（）()]*[）)]"), "[^0-9A-Za-z一-鿿]"),
        "shared_title": "lower(" + _deleted(_deleted(_deleted("r", "[（(][^）)]*[）)]"), "(?:·?其[一二三四五六七八九十]+|[上中下]篇?|[0-9]+)$"), f"[{sp}{n.KEY_MARKS}]") + ")",
        "bare": _deleted("r", f"[{sp}{n.DECORATION}]"),
        "voice": _deleted("trim(r, ' 「」『』《》\"''')", f"[{sp}]+"),
    }
    assert list(forms) == list(n.NORMALISERS)
    return f"WITH p AS (SELECT p_partkey, {RAW} AS r FROM part) SELECT p_partkey, " + ", ".join(f"{sql} AS {name}" for name, sql in forms.items()) + " FROM p"


@query("2.9.12", _normal_sql())
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fourteen normal forms of a decorated text."""
    raw = F.concat(F.lit(" 第二幕「"), "p_name", F.lit("」（变体）·"), "p_brand", F.lit("！ {{t|x}} [[a|"), "p_type", F.lit("]] <i>*-_其二"))
    return table(spark, sf_dir, "part").select("p_partkey", *[normal.normalised(raw, kind).alias(kind) for kind in normal.NORMALISERS])


@query(
    "2.9.29",
    """SELECT p_partkey, sha256(CASE p_partkey % 4 WHEN 0 THEN p_name || chr(10) || 'said ' || p_brand WHEN 1 THEN p_name WHEN 2 THEN 'said ' || p_brand ELSE '== stats ==' || chr(10) || p_size || chr(10) END) AS now,
    p_partkey % 4 < 3 AS same FROM part""",
)
def section_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes over story and voice only, of pages before and after their figures changed; a page without such sections is hashed whole."""
    place = F.col("p_partkey") % 4

    def page(figure):
        story = F.when(place.isin(0, 1), F.concat(F.lit("== story ==\n"), "p_name", F.lit("\n"))).otherwise("")
        voice = F.when(place.isin(0, 2), F.concat(F.lit("== voice ==\nsaid "), "p_brand", F.lit("\n"))).otherwise("")
        return F.concat(story, F.lit("== stats ==\n"), figure, F.lit("\n"), voice)

    rows = table(spark, sf_dir, "part").select("p_partkey", page(F.col("p_size").cast("string")).alias("now"), page(F.concat("p_size", F.lit("?"))).alias("old"))
    hashed = rows.select("p_partkey", normal.content_hash("now", ["story", "voice"]).alias("now"), normal.content_hash("old", ["story", "voice"]).alias("old"))
    return hashed.select("p_partkey", "now", (F.col("now") == F.col("old")).alias("same"))


@query(
    "2.9.34",
    """WITH q AS (SELECT p_partkey, p_partkey % 9 AS place, lower(p_type) AS a, lower(list_extract(['PROMO', 'SMALL', 'LARGE'], (p_partkey % 3 + 1)::INT)) AS b FROM part),
    k AS (SELECT p_partkey, CASE WHEN place IN (0, 1, 2, 7) THEN 'counted' WHEN place = 3 THEN 'ambiguous' WHEN place = 4 THEN 'missing' WHEN place = 5 THEN 'unsupported' END AS status,
    CASE WHEN place = 7 THEN (SELECT list(DISTINCT lower(p_type) ORDER BY lower(p_type)) FROM part) WHEN place < 3 THEN [a] WHEN place = 3 THEN list_sort(list_distinct([a, b])) END AS kinds FROM q),
    n AS (SELECT lower(p_type) AS kind, count(*) AS n FROM part GROUP BY 1)
    SELECT p_partkey, status, array_to_string(kinds, ',') AS kinds,
    CASE WHEN status = 'counted' THEN (SELECT sum(n)::BIGINT FROM n WHERE list_contains(k.kinds, n.kind)) END AS n FROM k""",
)
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question a part: counted kinds with their numbers, several kinds, none, an unknown one, one with conditions, and something else."""
    parts = table(spark, sf_dir, "part")
    place, a = F.col("p_partkey") % 9, F.col("p_type")
    b = F.element_at(F.array(F.lit("PROMO"), F.lit("SMALL"), F.lit("LARGE")), (F.col("p_partkey") % 3 + 1).cast("int"))
    text_ = (
        F.when(place == 0, F.concat(F.lit("How many "), a, F.lit(" parts are there?")))
        .when(place == 1, F.concat(F.lit("please list all "), F.lower(a), F.lit("  parts.")))
        .when(place == 2, F.concat(F.lit("Which "), a, F.lit(" parts exist")))
        .when(place == 3, F.concat(F.lit("how many "), a, F.lit(" and "), b, F.lit(" parts are there")))
        .when(place == 4, F.lit("how many parts are there?"))
        .when(place == 5, F.concat(F.lit("show me all "), "p_brand", F.lit(" parts")))
        .when(place == 6, F.concat(F.lit("how many parts cheaper than "), a, F.lit(" parts are there")))
        .when(place == 7, F.lit("how many all parts exist?"))
        .otherwise(F.lit("tell me a story"))
    )
    numbers = parts.groupBy(F.lower("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).where("kind is not null")
    words = F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))  # one row: the grammar's words with their numbers, all of which an answer may list
    each = numbers.agg(words.alias("each"), F.sum("n").alias("every")).withColumn("words", F.map_keys("each"))
    rows = parts.select("p_partkey", text_.alias("question")).crossJoin(F.broadcast(each))
    rows = rows.select("p_partkey", normal.request(F.col("question"), F.col("words")).alias("r"), "each", "every").select("p_partkey", "r.status", "r.kinds", "each", "every")
    total = F.when(F.size("kinds") > 1, F.col("every")).otherwise(F.try_element_at("each", F.try_element_at("kinds", F.lit(1))))  # one kind is counted, or all
    counted = F.when((F.col("status") == "counted") & (total > 0), total)
    return rows.select("p_partkey", "status", F.array_join("kinds", ",").alias("kinds"), counted.alias("n"))
