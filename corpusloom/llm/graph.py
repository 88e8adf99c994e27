"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir


def connected_components(links: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 100) -> DataFrame:
    """node, label: the smallest node reachable, for every node of a link.

    A node is its own neighbour, so that one join and one aggregation make a round: every node takes the smallest label next to
    it. From the third round on it then takes the label of its label, so that long chains shorten by halves. Rounds are written to
    the shared checkpoint folder; only the number of changed labels comes to the driver.
    """
    ensure_checkpoint_dir(links.sparkSession)
    pairs = links.select(F.explode(F.array(*(F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in ((left, right), (right, left), (left, left), (right, right))))).alias("p"))
    edges = pairs.select("p.*").distinct().checkpoint()
    labels = edges.groupBy("node").agg(F.min("other").alias("label"))
    for done in range(max_rounds):
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node")
        moved = near.agg(F.min("label").alias("label"), F.max(F.when(F.col("other") == F.col("node"), F.col("label"))).alias("old"))
        if done >= 2:
            moved = moved.checkpoint()
            jump = moved.select(F.col("node").alias("label"), F.col("label").alias("far"))
            moved = moved.join(jump, "label").select("node", F.least("label", "far").alias("label"), "old")
        moved = moved.checkpoint()
        labels = moved.select("node", "label")
        if not moved.where("label <> old").limit(1).count():
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
