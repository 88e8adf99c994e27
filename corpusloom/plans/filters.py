"""Section 2.2: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import logic, text
from corpusloom.operators.ranking import first_rows
from corpusloom.plans.base import query, table


PLAIN = "translate(coalesce({}, ''), '「」『』”“''（）()【】《》', '')"


@query(
    "2.2.1 2.2.2",
    f"""SELECT doc_id FROM (SELECT doc_id, {PLAIN.format("text")} AS b FROM documents) WHERE contains(b, 'thand')::INT + contains(b, 'und')::INT + contains(b, 'nothing-like-it')::INT >= 2""",
)
def half_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(text.half_of_words_in("thand (und) nothing-like-it", "text")).select("doc_id")


#: Tables with their keys, text columns and what is asked of each.
SEARCHED = {
    "part": ("p_partkey", ["p_name", "p_type"], "small PROMO"),
    "customer": ("c_custkey", ["c_name", "c_mktsegment"], "「BUILDING」 000001"),
    "supplier": ("s_suppkey", ["s_name"], "Supplier 00007"),
    "nation": ("n_nationkey", ["n_name"], "IN A"),
    "region": ("r_regionkey", ["r_name"], "A"),
    "orders": ("o_orderkey", ["o_orderpriority", "o_orderstatus"], "1-URGENT F x"),
    "documents": ("doc_id", ["text", "source"], "thand src7"),
    "conversations": ("conv_id", ["role", "text"], "system sch"),
    "pages": ("page_id", ["url"], "https:// page= #top"),
    "benchmark": ("item_id", ["text"], "the（and） nowhere"),
}


def _searched_sql() -> str:
    parts = []
    for name, (key, columns, asked) in SEARCHED.items():
        words = [w.translate({ord(c): None for c in text.MARKS}) for w in asked.split()]
        body = PLAIN.format("concat_ws(' ', " + ", ".join(columns) + ")")
        hits = " + ".join(f"contains(b, '{w}')::INT" for w in words)
        parts.append(f"SELECT '{name}' AS part, {key}::BIGINT AS id FROM (SELECT {key}, {body} AS b FROM {name}) WHERE {hits} >= {max(1, (len(words) + 1) // 2)}")
    return " UNION ALL ".join(parts)


@query("2.2.13", _searched_sql())
def filtered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter over ten tables, each with its own columns and words."""
    found = None
    for name, (key, columns, asked) in SEARCHED.items():
        hits = table(spark, sf_dir, name).where(text.half_of_words_in(asked, F.concat_ws(" ", *columns))).select(F.lit(name).alias("part"), F.col(key).cast("long").alias("id"))
        found = hits if found is None else found.union(hits)
    return found


@query("2.2.2 2.2.3 2.9.1", "SELECT p_partkey, p_name || ' ' || p_brand AS clean, translate(p_name, 'smalring ', '') = '' AS stop FROM part")
def stop_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in quotes and brackets without them, and whether a name has none but stop characters and punctuation."""
    marked = F.concat(F.lit("「"), "p_name", F.lit("」 （"), "p_brand", F.lit("）"))
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_marks(marked).alias("clean"), text.only_stop_characters(F.concat(F.lit(" "), "p_name", F.lit("？")), "smalring").alias("stop"))


@query(
    "2.2.4 2.9.3",
    """SELECT d.doc_id, count(*)::BIGINT AS terms FROM documents d, (SELECT DISTINCT unnest(string_split(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), ' ')) AS w FROM part) t
    WHERE length(t.w) >= 2 AND t.w NOT IN ('red','blue') AND contains(d.text, t.w) GROUP BY d.doc_id""",
)
def rewritten_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of a dictionary, without stop words, found by one automaton."""
    from corpusloom.operators.mentions import mention_index

    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.trim("p_name"), r"\s+")).alias("name")).where((F.length("name") >= 2) & ~F.col("name").isin("red", "blue")).distinct()
    found = mention_index(table(spark, sf_dir, "documents"), words.select(F.col("name").alias("entity_id"), "name"))
    return found.groupBy(F.col("entry_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("terms"))


@query("2.2.5 2.2.35", "SELECT p_partkey, p_name, p_type FROM part WHERE p_type = 'PROMO'")
def equal_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_type") == "PROMO").select("p_partkey", "p_name", "p_type")


@query("2.2.6", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red w')")
def substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").contains("red w")).select("p_partkey", "p_name")


@query(
    "2.2.7 2.2.8 2.2.10",
    """SELECT asked, p_partkey, p_name FROM (SELECT c.asked, p.p_partkey, p.p_name, row_number() OVER (PARTITION BY c.asked ORDER BY p.p_partkey) rn
    FROM (VALUES ('ring'), ('blue bolt'), ('missing')) c(asked) JOIN part p ON contains(p.p_name, c.asked)) WHERE rn = 1""",
)
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few candidates against a table: the first row that contains each."""
    asked = F.explode(F.array(*map(F.lit, ("ring", "blue bolt", "missing")))).alias("asked")
    pairs = table(spark, sf_dir, "part").select("p_partkey", "p_name", asked).where(F.col("p_name").contains(F.col("asked")))
    return first_rows(pairs, ["asked"], ["p_partkey"]).select("asked", "p_partkey", "p_name")


@query("2.2.9", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(contains(text, 'thand')) OR bool_or(role = 'system' AND contains(text, 'the'))")
def nested_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword in one of the turns; only a flag of each conversation is shuffled."""
    hit = F.col("text").contains("thand") | ((F.col("role") == "system") & F.col("text").contains("the"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(hit).alias("hit")).where("hit").select("conv_id")


@query("2.2.11", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (1, 3) AND l_partkey BETWEEN 5 AND 60")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the alias sets of both ends."""
    return table(spark, sf_dir, "lineitem").where(F.col("l_suppkey").isin(1, 3) & F.col("l_partkey").between(5, 60)).select("l_orderkey", "l_partkey", "l_suppkey")


@query("2.2.12 2.2.14", "SELECT DISTINCT p_name FROM part WHERE contains(p_name, 'bolt') OR contains(p_type, 'ECON') OR contains(p_brand, '#17')")
def any_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = text.any_variant_in(["bolt", "ECON", "#17", ""], "p_name", "p_type", "p_brand")
    return table(spark, sf_dir, "part").where(hit).select("p_name").distinct()


@query(
    "2.2.15 2.9.7",
    """SELECT doc_id, replace(substring(text, greatest(1, instr(text, 'license') - 20), 60), chr(10), ' ') AS snippet, nullif(regexp_extract(text, 'version (\\d+(?:\\.\\d+)?)', 1), '') AS version
    FROM documents WHERE contains(text, 'license')""",
)
def keyword_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("license"))
    version = F.regexp_extract("text", r"version (\d+(?:\.\d+)?)", 1)
    return docs.select("doc_id", text.window_around("text", "license", 20, 60).alias("snippet"), F.when(version != "", version).alias("version"))


@query(
    "2.2.16",
    """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) rn FROM documents WHERE source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_name = 'NATION_3')) WHERE rn <= 4""",
)
def mapped_then_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name maps to a list of sources; the first four of their texts."""
    names = table(spark, sf_dir, "nation").where("n_name = 'NATION_3'").select(F.concat(F.lit("src"), "n_nationkey").alias("source"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(names, "source", "left_semi").orderBy("doc_id").limit(4).select("doc_id")


@query("2.2.17", "SELECT p_partkey FROM part WHERE length(p_name) > 0 AND (contains(p_name, 'small ring') OR contains('small ring of old', p_name))")
def contained_either_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("p_name").contains("small ring") | text.contains_either_way(F.lit("small ring of old"), "p_name")
    return table(spark, sf_dir, "part").where(hit & (F.length("p_name") > 0)).select("p_partkey")


@query(
    "2.2.19",
    """SELECT doc_id FROM documents WHERE contains(text, 'thand') AND source = 'src3' AND lang = 'en' ORDER BY doc_id LIMIT 12""",
)
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, region and version together: the first twelve by an explicit order."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("thand") & (F.col("source") == "src3") & (F.col("lang") == "en"))
    return docs.orderBy("doc_id").limit(12).select("doc_id")


@query(
    "2.2.20 2.2.21",
    """SELECT o_orderkey, o_orderkey % 2 = 0 OR o_orderstatus = 'F' AS authoritative, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS region FROM orders""",
)
def composite_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a source, and the first value of a key among `key/value` strings."""
    key = F.col("o_orderkey")
    source = F.concat_ws("+", F.when(key % 2 == 0, "F").otherwise("xF"), "o_orderstatus", "o_orderpriority")
    status, priority = (F.concat(F.lit("region/"), name) for name in ("o_orderstatus", "o_orderpriority"))
    pairs = F.when(key % 5 == 0, F.array(F.lit("type/x"))).when(key % 3 == 0, F.array(F.lit("type/x"), priority, status)).otherwise(F.array(status, priority))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", source.alias("source"), pairs.alias("filters"))
    region = F.try_element_at(text.first_value_per_key(F.col("filters")), F.lit("region"))
    return rows.select("o_orderkey", F.array_contains(text.source_parts("source"), "F").alias("authoritative"), region.alias("region"))


@query(
    "2.2.22 2.2.23 2.2.24 2.2.25 2.2.27",
    """SELECT event_id, CASE WHEN (event_type = 'error' AND value > 0) OR (user_id <> 7) THEN 'excluded' WHEN value IS NULL OR event_type = 'view' THEN 'unresolved' ELSE 'applicable' END AS state FROM events""",
)
def three_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of an observation against a question, combined."""
    kind = F.when(F.col("event_type") == "error", logic.EXCLUDED).when(F.col("event_type") == "view", logic.UNRESOLVED).otherwise(logic.APPLICABLE)
    user = logic.axis(F.col("user_id"), F.lit(7))
    states = F.array(kind, user, F.when(F.col("value").isNull(), logic.UNRESOLVED).otherwise(logic.APPLICABLE))
    return table(spark, sf_dir, "events").select("event_id", logic.all_of(states).alias("state"))


@query(
    "2.2.24 2.2.25",
    """WITH e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'excluded' WHEN 'signup' THEN 'unresolved' WHEN 'purchase' THEN 'applicable' END AS state, CASE WHEN value > 90 THEN event_id % 3 END AS side FROM events),
    g AS (SELECT user_id, list(DISTINCT state) FILTER (WHERE state IS NOT NULL) AS s, count(DISTINCT side) AS n, min(side) AS side FROM e GROUP BY user_id)
    SELECT user_id, CASE WHEN list_contains(s, 'excluded') THEN 'excluded' WHEN list_contains(s, 'unresolved') THEN 'unresolved' ELSE 'applicable' END AS every,
    CASE WHEN list_contains(s, 'applicable') THEN 'applicable' WHEN list_contains(s, 'unresolved') THEN 'unresolved' ELSE 'excluded' END AS one,
    CASE WHEN n > 1 OR side = 2 OR user_id % 4 = 3 THEN 'excluded' WHEN n = 0 THEN 'applicable' WHEN user_id % 4 = 2 THEN 'unresolved' WHEN side = user_id % 4 THEN 'applicable' ELSE 'excluded' END AS scope FROM g""",
)
def state_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of each user's events, all and any of them, and a scope of at most one legal choice; sets have three members at most."""
    kind, side = F.col("event_type"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("event_id") % 3 + 1).cast("int"))
    state = F.when(kind == "error", logic.EXCLUDED).when(kind == "signup", logic.UNRESOLVED).when(kind == "purchase", logic.APPLICABLE)
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(state).alias("states"), F.collect_set(F.when(F.col("value") > 90, side)).alias("scope"))
    turn = F.col("user_id") % 4
    scope = logic.choice(F.col("scope"), F.when(turn == 0, "a").when(turn == 1, "b").when(turn == 3, "z"), ("a", "b"))
    return users.select("user_id", logic.all_of(F.col("states")).alias("every"), logic.any_of(F.col("states")).alias("one"), scope.alias("scope"))


@query(
    "2.2.26",
    """SELECT event_id, NOT (user_id % 3 > 0 AND event_type = 'view' AND event_id % 3 = 0) AND NOT (user_id % 2 > 0 AND event_type = 'click' AND event_id % 3 > 0) AS inside FROM events""",
)
def boundary_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the view on and until the click, each bound open for some users."""
    turn, user = F.col("event_id") % 3, F.col("user_id")
    position = F.when(turn == 0, "before").when(turn == 1, "at").otherwise("after")
    bounds = F.when(user % 3 > 0, "view"), F.when(user % 2 > 0, "click")
    return table(spark, sf_dir, "events").select("event_id", logic.at_boundary(position, F.col("event_type"), *bounds).alias("inside"))


@query(
    "2.2.28 2.9.18",
    """SELECT p_partkey, CASE WHEN a IS NULL THEN NULL WHEN a > 3 OR a = 3 AND b > 9 THEN 1 WHEN a = 3 AND b = 9 THEN 0 ELSE -1 END::INT AS against_3_9, CASE WHEN a IS NULL THEN NULL ELSE a = 3 END AS inside
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size % 6 END AS a, p_partkey % 13 AS b FROM part)""",
)
def version_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted versions as integers: 3.10 comes after 3.9, 3.9.0 equals it; what has no dot is no version."""
    key = F.col("p_partkey")
    dotted = F.concat_ws(".", (F.col("p_size") % 6).cast("string"), (key % 13).cast("string"), F.when(key % 3 == 0, F.lit("0")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(key % 11 == 0, F.lit("3")).otherwise(dotted).alias("version"))
    inside = logic.in_version_range(F.col("version"), F.lit("3.0"), F.lit("4.0"))
    return rows.select("p_partkey", logic.version_order(F.col("version"), F.lit("3.9")).alias("against_3_9"), inside.alias("inside"))


@query(
    "2.2.29",
    """SELECT page_id FROM pages WHERE length(html) > 500 AND NOT contains(url, '#') AND (contains(html, 'nav') OR contains(url, 'en'))""",
)
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.where((F.length("html") > 500) & ~F.col("url").contains("#") & (F.col("html").contains("nav") | F.col("url").contains("en"))).select("page_id")


RULES = """SELECT doc_id, (length(text) >= 200 AND NOT contains(text, '@') AND lang IN ('en','de','fr','es')) AS ok,
    concat_ws(',', CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN contains(text, '@') THEN 'address' END, CASE WHEN lang NOT IN ('en','de','fr','es') THEN 'language' END) AS reasons FROM documents"""


@query("2.2.30 2.2.31", RULES)
def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(F.length("text") < 200, "short"), (F.col("text").contains("@"), "address"), (~F.col("lang").isin("en", "de", "fr", "es"), "language")]
    found = logic.first_reason(rules)
    return table(spark, sf_dir, "documents").select("doc_id", (F.size(found) == 0).alias("ok"), F.array_join(found, ",").alias("reasons"))


@query(
    "2.2.32 2.2.33 2.2.34",
    r"""WITH v AS (SELECT conv_id, turn, CASE turn % 6 WHEN 1 THEN '  ' WHEN 2 THEN role || ' = ' || turn WHEN 3 THEN '-' WHEN 4 THEN 'n/a' WHEN 5 THEN left(text, 9) || '|' ELSE text END AS v FROM conversations)
    SELECT conv_id, turn, CASE WHEN trim(v) = '' THEN 'empty' WHEN contains(v, '=') OR contains(v, '|') THEN 'dirty' ELSE 'filled' END AS class, regexp_matches(v, '[.!?]$') AS sentence, (v IN ('n/a', '-')) AS placeholder FROM v""",
)
def classified_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as field values: by their place blank, assigned, cut off, a placeholder or as they are."""
    place = F.col("turn") % 6
    value = F.when(place == 1, "  ").when(place == 2, F.concat("role", F.lit(" = "), "turn")).when(place == 3, "-").when(place == 4, "n/a").when(place == 5, F.concat(F.left("text", F.lit(9)), F.lit("|"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", value.alias("v"))
    kind = F.when(F.trim("v") == "", "empty").when(F.col("v").contains("=") | F.col("v").contains("|"), "dirty").otherwise("filled")
    return rows.select("conv_id", "turn", kind.alias("class"), F.col("v").rlike("[.!?]$").alias("sentence"), F.col("v").isin("n/a", "-").alias("placeholder"))


@query(
    "2.2.36",
    """SELECT page_id, nullif(regexp_extract(html, '<title>([^<]{0,240})', 1), '') AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang FROM pages""",
)
def labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(pattern: str):
        found = F.regexp_extract("html", pattern, 1)
        return F.when(found != "", found)

    return table(spark, sf_dir, "pages").select("page_id", part("<title>([^<]{0,240})").alias("title"), part('<html lang="([a-z]+)"').alias("lang"))
