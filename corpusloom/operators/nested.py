"""Walks over nested JSON of any depth: a fixpoint over VARIANT, one level a round.

A round explodes all objects and arrays of one depth beside their rows, without a shuffle, and writes what comes out to the shared
checkpoint folder; leaves leave, containers go on. So the number of rounds is the depth of the deepest text, however many rows there are.
Objects are walked in the order of their keys, as VARIANT keeps them. A text that is null or no JSON has no nodes; an
empty object or array is a leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir

STEP = "array<struct<pos:int,key:string>>"


def _kind(node: Column) -> Column:
    """object, array, string, boolean, null or number."""
    schema = F.schema_of_variant(node)
    named = F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array")
    return named.when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").otherwise("number")


def pointer(steps: Column) -> Column:
    """RFC 6901: keys with ~ and / escaped, positions of array items."""
    escaped = lambda step: F.replace(F.replace(F.coalesce(step["key"], step["pos"].cast("string")), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.array_join(F.concat(F.array(F.lit("")), F.transform(steps, escaped)), "/")


def leaves(rows: DataFrame, ids: list[str], json: str) -> DataFrame:
    """ids, steps (position, and key within an object, of every node on the way), kind and value (as text, null for a JSON null)."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    node = F.col("_node")
    level = rows.select(*ids, F.try_parse_json(json).alias("_node")).where(node.isNotNull()).select(*ids, F.array().cast(STEP).alias("steps"), node)
    level = level.withColumn("kind", _kind(node)).checkpoint()
    found = []
    while True:
        text = F.when(F.col("kind") == "string", F.variant_get(node, "$", "string")).when(F.col("kind") != "null", F.to_json(node))
        inner = F.col("kind").isin("object", "array") & ~F.to_json(node).isin("{}", "[]")
        found.append(level.where(~inner).select(*ids, "steps", "kind", text.alias("value")))
        level = level.where(inner)
        if level.isEmpty():
            return reduce(DataFrame.union, found)
        inside = level.withColumnRenamed("kind", "_above").lateralJoin(spark.tvf.variant_explode(node.outer()))
        step = F.struct("pos", F.when(F.col("_above") == "object", F.col("key")).alias("key"))
        level = inside.select(*ids, F.concat("steps", F.array(step)).cast(STEP).alias("steps"), F.col("value").alias("_node"))
        level = level.withColumn("kind", _kind(node)).checkpoint()


def pointers(rows: DataFrame, ids: list[str], json: str) -> DataFrame:
    """ids, place (1, 2, ... in the order of the walk), pointer, kind, value of every leaf."""
    place = F.row_number().over(Window.partitionBy(*ids).orderBy(F.transform("steps", lambda step: step["pos"])))
    return leaves(rows, ids, json).select(*ids, place.alias("place"), pointer(F.col("steps")).alias("pointer"), "kind", "value")


def span_citations(rows: DataFrame, ids: list[str], json: str, listed: str = "evidence", field: str = "source_span_id") -> DataFrame:
    """ids, place, span: what the items of `evidence` lists name, at any depth; a span's first place counts. An object's own list comes
    before everything else in it."""
    walked = leaves(rows, ids, json).where((F.size("steps") >= 3) & F.col("kind").isin("string", "number") & (F.col("value") != "") & (F.col("value") != "0"))
    key = lambda back: F.element_at("steps", -back)["key"]
    named = walked.where((key(1) == field) & key(2).isNull() & (key(3) == listed))
    last = F.size("steps") - 3  # the list's own step, which goes first
    order = F.transform("steps", lambda step, at: F.when(at == last, F.lit(-1)).otherwise(step["pos"]))
    first = named.groupBy(*ids, F.col("value").alias("span")).agg(F.min(order).alias("_order"))
    return first.select(*ids, F.row_number().over(Window.partitionBy(*ids).orderBy("_order")).alias("place"), "span")
