"""Nested templates, cut JSON, models that fail."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import markup
from corpusloom.sources import models
from corpusloom.sources.paged import Paged, land


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{{a|x=1|{{b|y={{c}}|z}}|w=[[d|e]]}}", [(0, "a", {"x": "1", "2": "{{b|y={{c}}|z}}", "w": "[[d|e]]"}), (1, "b", {"y": "{{c}}", "2": "z"}), (2, "c", {})]),
        ("{{open|x=1 {{in|k=v}} no end", [(0, "in", {"k": "v"})]),
        ("}} {{a}} }} {{b|q|q=2|1=late}}", [(0, "a", {}), (0, "b", {"1": "q", "q": "2"})]),
        ("{{a|n={{b|m=1}}={{c}}}}", [(0, "a", {"n": "{{b|m=1}}={{c}}"}), (1, "b", {"m": "1"}), (1, "c", {})]),
        ("", []),
        (None, []),
    ],
)
def test_templates(text, want):
    assert [(t["depth"], t["name"], dict(t["parameters"])) for t in markup.templates(text)] == want


def test_every_cut_gives_the_longest_beginning():
    text = '{"a": [1, -2.5e3, {"b\\"}": null}, []], "c": {"d": true, "e": "x\\u00e9,]"}, "f": 12}'
    assert markup.repaired(text) == text
    for at in range(len(text)):
        found = markup.repaired(text[:at])
        if not at:
            assert found is None
            continue
        json.loads(found)
        body = found.rstrip("]}")
        assert text.startswith(body) and len(body) <= at
        closers = [c for c in ("", "]", "}", "]]", "]}", "}]", "}}", "]]}", "}]}", "]}}", "}}}")]
        longer = [text[:n] + c for n in range(len(body) + 1, at + 1) for c in closers]
        assert not any(_whole(x) for x in longer if x.rstrip("]}") != body), (text[:at], found)


def _whole(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


@pytest.mark.parametrize(("text", "want"), [("{bad", "{}"), ("tru", None), ("12", "12"), ("[1,", "[1]"), ("[1,]", "[1]"), ('{"a":1,}', '{"a":1}'), ("[}", "[]"), ('{"a" "b"}', "{}"), ("[] []", "[]")])
def test_broken_json(text, want):
    assert markup.repaired(text) == want


def test_models_are_asked_again(spark):
    def load():
        calls = []

        def model(rows):
            calls.append(len(rows))
            if len(calls) == 1:
                raise OSError("down")
            if len(calls) == 2:
                return [n * 2 for (n,) in rows][:1]
            return [None if n == 3 else n * 2 for (n,) in rows]

        return model

    rows = spark.createDataFrame([(i,) for i in range(5)], "n int").coalesce(1)
    assert {r.n: r.answer for r in models.answered(rows, ["n"], load, "int", tries=4).collect()} == {0: 0, 1: 2, 2: 4, 3: None, 4: 8}
    assert {r.answer for r in models.answered(rows, ["n"], lambda: lambda rows: None, "int").collect()} == {None}
    assert models.answered(rows.where("false"), ["n"], load, "int").count() == 0


def test_paged_responses_resume_and_report(spark, tmp_path):
    spark.dataSource.register(Paged)
    folder = f"{tmp_path}/in"
    pages = spark.range(60).select(F.col("id").alias("pageid"), F.concat(F.lit("t"), "id").alias("title"), (F.col("id") * 2).alias("lastrevid"), F.lit("x").alias("content"))

    def run():
        stream = spark.readStream.format("paged").option("path", folder).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    land(pages.where("pageid < 30"), folder, 10)
    assert run().count() == 30
    land(pages.where("pageid >= 30"), folder, 10)
    (tmp_path / "in/token=000000000009").mkdir()
    (tmp_path / "in/token=000000000009/bad.txt").write_text("{broken\n")
    found = run()
    assert found.where("error is null").count() == 60 == found.select("pageid").where("pageid is not null").distinct().count()
    assert found.where("error is not null").count() == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    batch = spark.read.format("paged").option("path", folder).load()
    assert sorted(r.pageid for r in batch.where("token = '000000000002' and lastrevid > 50").collect()) == [26, 27, 28, 29]
    assert spark.read.format("paged").option("path", f"{tmp_path}/nothing").load().count() == 0


def test_table_functions_refuse_bad_arguments(spark):
    from corpusloom.functions import table_functions

    spark.createDataFrame([(1, "a b a")], "id int, body string").createOrReplaceTempView("few")
    table_functions.register(spark)
    got = spark.sql("SELECT * FROM contexts(TABLE(few), 'body', 'a', 1)").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a "), (1, 4, " a")]
    for bad in ("contexts(TABLE(few), 'none', 'a', 1)", "contexts(TABLE(few), 'body', '', 1)", "sections(TABLE(few), 'body', 0)"):
        with pytest.raises(Exception, match="column none|constant"):
            spark.sql(f"SELECT * FROM {bad}").collect()
