"""Nulls, empty values and truth tables that the supplied tables do not hold."""

from pyspark.sql import functions as F

from corpusloom.functions import logic, text
from corpusloom.operators import chunking, graph, retrieval, stats


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_null_and_marked_texts(spark):
    df = spark.createDataFrame([(1, "\twhere \tis it\n"), (2, "a b （c） d？"), (3, None)], "id int, raw string")
    got = df.select("id", text.cleaned_prompt("raw"), text.cleaned_query("raw"))
    assert rows(got) == [(1, "where  is it", "where  is it"), (2, "a b （c） d？", "a b  d"), (3, "", "")]
    names = spark.createDataFrame([(1, "[Ann]、Bob/Cy，Ann"), (2, None), (3, "version=1;Dee；a-very-long-name-indeed")], "id int, raw string")
    assert rows(names.select("id", F.array_join(text.name_list("raw"), ","))) == [(1, "Ann,Bob,Cy"), (2, ""), (3, "Dee")]
    asked = spark.createDataFrame([(1, "Who is 山水的 v1.2"), (2, None)], "id int, raw string")
    assert rows(asked.select("id", F.array_join(F.sort_array(text.tokens_for_facts("raw", ["is"])), ","))) == [(1, "v1.2,who,山水,水的"), (2, "")]
    spoken = spark.createDataFrame([(1, "* Ann：hi\nBob (low): yes\nno one speaks\nAnn: bye"), (2, None)], "id int, raw string")
    assert rows(spoken.select("id", F.array_join(text.speakers("raw"), ","))) == [(1, "Ann,Bob,Ann"), (2, "")]
    counted = spark.createDataFrame([("aaaa",), ("banana",), ("",)], "raw string")
    assert rows(counted.select("raw", text.occurrences("raw", "aa"), text.overlapping_occurrences("raw", "aa"))) == [("", 0, 0), ("aaaa", 2, 3), ("banana", 0, 0)]


def test_states_of_nothing_and_scopes(spark):
    df = spark.createDataFrame(
        [(1, [], [], "a"), (2, ["excluded", "applicable"], ["a"], None), (3, ["unresolved"], ["a"], "b"), (4, [], None, "a")], "id int, states array<string>, scope array<string>, asked string"
    )
    got = df.select("id", logic.all_of(F.col("states")), logic.any_of(F.col("states")), logic.choice(F.col("scope"), F.col("asked"), ("a", "b")))
    assert rows(got) == [
        (1, "applicable", "excluded", "applicable"), (2, "excluded", "applicable", "unresolved"), (3, "unresolved", "unresolved", "excluded"), (4, "applicable", "excluded", "excluded")
    ]


def test_rankings_without_keys(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "c"], ["b", "a"], ["a", "z"]), (2, [], ["a"], [])], "id int, l array<string>, r array<string>, need array<string>")
    share, missing = retrieval.coverage(F.col("l"), F.col("need"))
    assert rows(df.select("id", retrieval.overlap_at(F.col("l"), F.col("r"), 5), share, F.array_join(missing, ","))) == [(1, 0.4, 0.5, "z"), (2, 0.0, 1.0, "")]


def test_grades_without_lists(spark):
    given = [(1, ["Ann"], "Ann was here"), (2, ["Bob"], "Ann: hello"), (3, None, "Ann: hello"), (4, None, "then Ann walked"), (5, [], "about Ann"), (6, None, "nobody"), (7, None, None)]
    graded = stats.graded_evidence(spark.createDataFrame(given, "id int, cast array<string>, body string"), ["Ann"], actions=("walked",))
    assert rows(graded.where("weight > 0").select("id", "level", "weight")) == [(1, "cast", 4), (3, "line", 3), (4, "action", 2), (5, "mention", 1)]


def test_ambiguous_names_and_trees_with_cycles(spark):
    names = spark.createDataFrame([("AnnBob",), ("AnnieBob",), ("Zed",), ("",), (None,)], "subject string")
    split = {r.subject: r.parts for r in chunking.segmentations(names, "subject", {"Ann": "Ann", "Annie": "Annie", "ie": "Ie", "Bob": "Bob"}).collect()}
    assert split == {"AnnBob": ["Ann", "Bob"], "AnnieBob": None, "Zed": None, "": None, None: None}
    edges = spark.createDataFrame([("root", 0, "a"), ("root", 1, "b"), ("a", 0, "c"), ("b", 0, "d"), ("d", 0, "root"), ("b", 1, "c")], "source string, position int, target string")
    paths = graph.paths_from(edges, spark.createDataFrame([("root",)], "node string"), 10)
    assert [(r.node, list(r.path)) for r in paths.collect()] == [("root", []), ("a", [0]), ("c", [0, 0]), ("b", [1]), ("d", [1, 0])]
