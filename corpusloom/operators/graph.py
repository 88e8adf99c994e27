"""Linked entries: nodes (entry_id, title, ...) and edges (source, position, target, name)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranking import first_rows
from corpusloom.session import ensure_checkpoint_dir


def edges_of(entries: DataFrame, links: str = "links") -> DataFrame:
    """source, position (from 0), target, name of an array of (target_id, target_name) structs."""
    exploded = entries.select(F.col("entry_id").alias("source"), F.posexplode(links).alias("position", "_link"))
    return exploded.select("source", "position", F.col("_link.target_id").alias("target"), F.col("_link.target_name").alias("name"))


def expand(edges: DataFrame, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """The first links of every source in stored order, with the target's title or null."""
    return first_rows(edges, ["source"], ["position"], limit).join(nodes.select(F.col("entry_id").alias("target"), F.col("title").alias("target_title")), "target", "left")


def backlinks(edges: DataFrame) -> DataFrame:
    """target, source, position: the first link of each pair, without links to oneself."""
    return edges.where("source <> target").groupBy("target", "source").agg(F.min("position").alias("position"))


def missing_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets without a node, with the name that the first link (by source and position) gives them."""
    known = nodes.select(F.col("entry_id").alias("target"))
    return edges.join(known, "target", "left_anti").groupBy("target").agg(F.min_by("name", F.struct("source", "position")).alias("name"))


def without_ambiguous_links(edges: DataFrame) -> DataFrame:
    """Links whose target has one name within its source; a target with several names loses all of them there."""
    single = edges.groupBy("source", "target").agg(F.min("name").alias("name"), F.max("name").alias("_other"), F.min("position").alias("position"))
    return single.where(F.col("name").eqNullSafe(F.col("_other"))).drop("_other")


def closure(edges: DataFrame, seeds: DataFrame, depth: int, source: str = "source", target: str = "target", gate: Column | None = None) -> DataFrame:
    """node, depth, seed: everything within `depth` steps of each seed (column node), at its least depth.

    A frontier join a step; what has been reached is written to the shared folder, so lineage stays short and a lost executor
    costs a step. Only whether the frontier is empty comes to the driver.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    steps = edges.where(gate) if gate is not None else edges
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt by node once and kept so: no level shuffles the links again, and a link that repeats goes with the frontier's repeats
    steps = steps.select(F.col(source).alias("node"), F.col(target).alias("_next")).repartition(parts, "node").sortWithinPartitions("node").checkpoint()
    reached = seeds.select("node", F.lit(0).alias("depth"), F.col("node").alias("seed")).distinct().checkpoint()
    frontier = reached
    for level in range(1, depth + 1):
        moved = frontier.join(steps, "node").select(F.col("_next").alias("node"), F.lit(level).alias("depth"), "seed").distinct()
        frontier = moved.join(reached.select("node", "seed"), ["node", "seed"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def marked_dirty(dependencies: DataFrame, changed: DataFrame, depth: int = 32) -> DataFrame:
    """node, seed, depth: consumers that a change (column node) reaches along (consumer, dependency); see `too_deep`."""
    return closure(dependencies, changed, depth, source="dependency", target="consumer")


def too_deep(reached: DataFrame, dependencies: DataFrame, depth: int = 32) -> DataFrame:
    """One row, full_rebuild: whether something beyond `depth` steps would have to follow."""
    edge = reached.where(F.col("depth") == depth).select(F.col("node").alias("dependency"))
    beyond = dependencies.join(edge, "dependency").join(reached.select(F.col("node").alias("consumer")), "consumer", "left_anti")
    return beyond.agg((F.count(F.lit(1)) > 0).alias("full_rebuild"))


def neighbours(edges: DataFrame, nodes: DataFrame, allowed: Sequence[str], type_col: str = "entry_type", limit: int = 100, cap: int = 20) -> DataFrame:
    """source, neighbour: nodes of allowed types next to each source in either direction, the first `cap` by id."""
    out = first_rows(edges, ["source"], ["position", "target"], limit).select("source", F.col("target").alias("neighbour"))
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("neighbour"))
    typed = nodes.where(F.col(type_col).isin(*allowed)).select(F.col("entry_id").alias("neighbour"))
    met = out.unionByName(back).where("source <> neighbour").join(typed, "neighbour").select("source", "neighbour")
    # links that repeat have one rank: tasks keep the first ranks by sorting, and only these rows are made distinct
    rank = F.dense_rank().over(Window.partitionBy("source").orderBy("neighbour"))
    return met.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank").distinct()


def series_links(nodes: DataFrame) -> DataFrame:
    """entry_id, series: another title that equals the first word of an alias or of the title."""
    heads = nodes.select("entry_id", "title", F.explode(F.array_distinct(F.transform(F.concat("aliases", F.array("title")), lambda a: F.substring_index(a, " ", 1)))).alias("series"))
    titles = nodes.select(F.col("title").alias("series")).distinct()
    return heads.where("series <> title").join(titles, "series").select("entry_id", "series").distinct()


def series_with_core(members: DataFrame, least: int = 8) -> DataFrame:
    """Members (series, entry_id, hits) of every series in which one member has at least `least` hits."""
    core = members.groupBy("series").agg(F.max("hits").alias("most")).where(F.col("most") >= least).select("series")
    return members.join(core, "series")


def default_kinds(entries: DataFrame, legal: Sequence[str], kind: str = "entry_kind", default: Column | None = None) -> DataFrame:
    """Adds `violation` where the kind is not legal and puts a legal one in its place."""
    bad = F.col(kind).isNull() | ~F.col(kind).isin(*legal)
    fill = default if default is not None else F.lit("unknown")
    return entries.withColumn("violation", F.coalesce(bad & (F.col(kind) != ""), F.lit(False))).withColumn(kind, F.when(bad, fill).otherwise(F.col(kind)))


def best_per_title(entries: DataFrame, title_key: Column, order: Sequence[Column]) -> DataFrame:
    """One entry for each normalised title: the first by order. Entries without a title key all stay."""
    keyed = entries.withColumn("_key", title_key)
    best = first_rows(keyed.where("_key <> ''"), ["_key"], list(order))
    return best.unionByName(keyed.where(F.coalesce(F.col("_key") == "", F.lit(True)))).drop("_key")


def entries_from_items(items: DataFrame, raw: str, schema: str, entry_id: Column, title: Column, links: Column) -> DataFrame:
    """Entries of raw JSON items: entry_id, title, sha1 of the item, links; malformed items are left out, the last item of an id wins nothing: the first stays."""
    parsed = items.withColumn("_item", F.from_json(raw, schema)).where(F.col("_item").isNotNull())
    rows = parsed.select(entry_id.alias("entry_id"), title.alias("title"), F.sha1(F.col(raw).cast("binary")).alias("sha1"), links.alias("links")).where("entry_id is not null")
    return first_rows(rows, ["entry_id"], ["sha1"])


def graph_profile(entries: DataFrame, edges: DataFrame, type_col: str = "entry_type") -> DataFrame:
    """entry_type, entries, links: counts by type; nodes and edges are counted before they meet."""
    links = edges.groupBy(F.col("source").alias("entry_id")).agg(F.count(F.lit(1)).alias("_n"))
    joined = entries.select("entry_id", type_col).join(links, "entry_id", "left")
    return joined.groupBy(type_col).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("_n"), F.lit(0)).alias("links"))


def majority_label(rows: DataFrame, group: str, label: str, least: int = 2) -> DataFrame:
    """group, label: the most frequent non-null label (the greater on a tie) if it has more than half of the labelled rows and at least `least`."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group).agg(F.max(F.struct("n", label)).alias("_best"), F.sum("n").alias("labelled"))
    return best.where((F.col("_best.n") * 2 > F.col("labelled")) & (F.col("_best.n") >= least)).select(group, F.col(f"_best.{label}").alias(label), F.col("_best.n").alias("n"), "labelled")


def paths_from(edges: DataFrame, root: DataFrame, depth: int) -> DataFrame:
    """Depth-first reading order of a tree: node, path (positions from the root), ordered by path; a node is visited once, on its least path."""
    ensure_checkpoint_dir(edges.sparkSession)
    level = root.select("node", F.array().cast("array<int>").alias("path")).checkpoint()
    every = level
    for _ in range(depth):
        level = level.join(edges.select(F.col("source").alias("node"), "position", "target"), "node")
        level = level.select(F.col("target").alias("node"), F.concat("path", F.array(F.col("position").cast("int"))).alias("path"))
        level = level.join(every.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")).checkpoint()
        if level.isEmpty():
            break
        every = every.unionByName(level)
    return every.orderBy("path")
