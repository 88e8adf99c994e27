"""Windows over whole tables against plain Python."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import facts, ordered


def some_rows(spark, n):
    draw = random.Random(5)
    keys = draw.sample(range(10 * n), n)
    rows = [(k, draw.choice((None, k % 7, k, -k))) for k in keys]
    return rows, spark.createDataFrame(rows, "key long, value long").repartition(5)


def test_places(spark):
    rows, df = some_rows(spark, 500)
    got = {r["key"]: r["place"] for r in ordered.places(df, [F.desc("key")]).collect()}
    assert got == {k: i for i, (k, _) in enumerate(sorted(rows, reverse=True), 1)}
    assert ordered.places(df, ["key"], "n").columns == ["key", "value", "n"]


def test_least_after(spark):
    rows, df = some_rows(spark, 500)
    rows = sorted(rows)
    got = {r["key"]: r["least"] for r in ordered.least_after(df, ["key"], F.col("value"), "least").collect()}
    assert got == {k: min((v for _, v in rows[i + 1 :] if v is not None), default=None) for i, (k, _) in enumerate(rows)}


def test_nothing_and_one_row(spark):
    one = spark.createDataFrame([(4, None)], "key long, value long")
    assert [tuple(r) for r in ordered.least_after(ordered.places(one, ["key"]), ["key"], F.col("value"), "least").collect()] == [(4, None, 1, None)]
    assert ordered.places(one.where("false"), ["key"]).count() == ordered.least_after(one.where("false"), ["key"], F.col("value"), "least").count() == 0


def test_versions_that_fall(spark):
    names = ["1.0", "1.2", "1.10", "1.3", None, "x", "2.0", "1.9"]
    registry = spark.createDataFrame([(f"v{i}", n, f"l{i}", i) for i, n in enumerate(names)], "version_id string, numeric string, label string, order int")
    got = {r["key"] for r in facts.registry_violations(registry).where("problem = 'order'").collect()}
    assert got == {"v2", "v6"}
