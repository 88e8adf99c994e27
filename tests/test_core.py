"""Operators against hand-written values, awkward rows and each other."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import logic, text
from corpusloom.operators import chains, chunking, graph, greedy, incremental, mentions, reconcile, retrieval, stats
from corpusloom.plans.evolving import entity_query, phrase_to_plan
from corpusloom.sources import files, vectors
from corpusloom.streaming import admission


def values(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())


def test_every_section_has_queries():
    rows = catalog.inventory()
    assert {row.rsplit(".", 1)[0] for row in rows} == {f"2.{n}" for n in range(1, 12)}


def test_half_of_words(spark):
    df = spark.createDataFrame([("a b",), ("「a」",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.half_of_words_in("a b c", "t")).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(text.half_of_words_in(" ", "t")).collect()] == [False] * 4


def test_three_valued_logic(spark):
    rows = [([], "applicable", "excluded"), (["excluded", "unresolved"], "excluded", "unresolved"), (["unresolved", "applicable"], "unresolved", "applicable")]
    df = spark.createDataFrame([(s,) for s, _, _ in rows], "s array<string>")
    got = [tuple(r) for r in df.select(logic.all_of(F.col("s")), logic.any_of(F.col("s"))).collect()]
    assert got == [(a, b) for _, a, b in rows]


@pytest.mark.parametrize(("a", "b", "order"), [("3.10", "3.9", 1), ("3.3", "3.3.0", 0), ("1.2", "1.2.1", -1), ("x", "1.0", None), (None, "1.0", None)])
def test_version_order(spark, a, b, order):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(logic.version_order(F.col("a"), F.col("b"))).first()[0] == order


def test_repeated_lines(spark):
    df = spark.createDataFrame([("x\nx\n \nhttps://a.b\nx\ny\nz y",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.without_repeated_lines("t")).collect()] == ["x\ny\nz y", "", None]


def test_bm25_prefers_more_and_shorter(spark):
    docs = spark.createDataFrame([(1, "abab"), (2, "ab" + "x" * 50), (3, "zz"), (4, None), (5, "")], "doc_id long, text string")
    assert [r["doc_id"] for r in retrieval.bm25(docs, "ab", 5).collect()] == [1, 2]
    assert retrieval.bm25(docs, "a", 5).count() == 0


def test_rank_fusion_counts_every_chunk(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, rank int")
    b = spark.createDataFrame([("m", 1)], "key string, rank int")
    summed = {r["key"]: r["score"] for r in retrieval.fuse_ranks([a, b]).collect()}
    assert summed == {"k": round(1 / 61 + 1 / 62, 9), "m": round(1 / 63 + 1 / 61, 9)}
    assert {r["key"]: r["score"] for r in retrieval.fuse_ranks([a, b], mode="max").collect()}["k"] == round(1 / 61, 9)


def test_knn_blocks_agree(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = table.where("vec_id < 6").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = values(retrieval.exact_knn(table, asked, 3), "query_id", "vec_id", "rank")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert values(retrieval.exact_knn(table, asked, 3), "query_id", "vec_id", "rank") == whole


def test_graph_rules(spark):
    edges = spark.createDataFrame([(1, 0, 1, "me"), (1, 1, 2, "b"), (1, 2, 2, "b2"), (2, 0, 9, "lost"), (3, 0, 9, "gone")], "source int, position int, target int, name string")
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "entry_id int, title string")
    assert values(graph.backlinks(edges), "target", "source", "position") == [(2, 1, 1), (9, 2, 0), (9, 3, 0)]
    assert values(graph.missing_targets(edges, nodes), "target", "name") == [(9, "lost")]
    assert values(graph.without_ambiguous_links(edges), "source", "target") == [(1, 1), (2, 9), (3, 9)]


def test_dirty_depth_limit(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(5)], "consumer int, dependency int")
    reached = graph.marked_dirty(edges, spark.createDataFrame([(0,)], "node int"), 3)
    assert values(reached, "node", "depth") == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert graph.too_deep(reached, edges, 3).first()[0]
    assert not graph.too_deep(graph.marked_dirty(edges, spark.createDataFrame([(0,)], "node int"), 9), edges, 9).first()[0]


def test_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string")
    assert values(graph.closure(edges, spark.createDataFrame([("a",)], "node string"), 20), "node", "depth") == [("a", 0), ("b", 1)]


def test_mentions_overlap_and_own_two_names(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (2, "x"), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([("e", "aa"), ("e", "aaa"), ("f", "a")], "entity_id string, name string")
    assert values(mentions.mention_index(docs, names), "entity_id", "entry_id", "pattern_hits", "first_start", "first_end") == [("e", 1, 5, 0, 2)]


def test_mention_blocks_agree(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = spark.createDataFrame([("e", "thand"), ("e", "the"), ("f", "über"), ("g", "tion")], "entity_id string, name string")
    columns = ("entity_id", "entry_id", "pattern_hits", "first_start", "first_end")
    whole = values(mentions.mention_index(docs, names), *columns)
    monkeypatch.setattr(mentions, "NAME_BLOCK", 2)
    assert values(mentions.mention_index(docs, names), *columns) == whole


def test_suppression_is_greedy(spark):
    rows = [("q", 1, "tale of ash", 100, ["a", "b", "c"]), ("q", 2, "tale of", 90, ["a", "b", "c"]), ("q", 3, "tale of", 40, ["a", "b", "c"]), ("q", 4, "other", 95, ["a", "b", "c"]), ("r", 2, "tale of", 90, None)]
    df = spark.createDataFrame(rows, "g string, id int, title string, size int, profile array<string>")
    assert values(greedy.without_variants(df, "g"), "g", "id") == [("q", 1), ("q", 3), ("q", 4), ("r", 2)]


def test_covered_text_goes(spark):
    long, short = "the quick brown fox jumps over the lazy dog " * 4, "the quick brown fox jumps over the lazy dog "
    df = spark.createDataFrame([("g", 1, long), ("g", 2, short), ("g", 3, "something else entirely, of some length")], "g string, id int, t string")
    assert values(greedy.without_covered(df, "g", "id", "t", least=1), "id") == [(1,), (3,)]


def test_packed_sections(spark):
    df = spark.createDataFrame([("a", i, 40) for i in range(5)] + [("b", 0, 500)], "k string, pos int, n long")
    assert values(chains.packed_sections(df, "k", ["pos"], "n", 100), "k", "pos", "bucket") == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 0, 0)]


def test_keyed_merge_counts_partners(spark):
    left = spark.createDataFrame([(1, "k", "x"), (2, "m", None), (3, "", None)], "l int, k string, c string")
    right = spark.createDataFrame([(7, "k", "x"), (8, "k", "y"), (9, "m", "z"), (10, "m", None), (11, "q", None)], "r int, k string, c string")
    got = {tuple(row) for row in reconcile.keyed_merge(left, right, "l", "r", "k", ["c"]).collect()}
    assert got == {(1, 7, "merged"), (2, 9, "review"), (3, None, "left_only"), (None, 8, "right_only"), (None, 11, "right_only")}


def test_diff_of_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, f string")
    one = spark.createDataFrame([(1, None)], "k int, f string")
    assert values(reconcile.snapshot_diff(empty, one, "k", "f"), "k", "change") == [(1, "new")]
    assert values(reconcile.snapshot_diff(one, one, "k", "f"), "k", "change") == [(1, "unchanged")]
    assert reconcile.snapshot_diff(empty, empty, "k", "f").count() == 0


def test_similar_names(spark):
    df = spark.createDataFrame([(1, "blue bolt"), (2, "blue bolts"), (3, "ring"), (4, None)], "id int, name string")
    assert [r["id"] for r in reconcile.similar_names(df, "id", "name", "blu bolt").collect()] == [1, 2]


def test_chunks_cover_the_text():
    body = "\n\n".join(f"paragraph {i}. " + "word " * (i * 40) for i in range(12))
    chunks = chunking.natural_chunks(body)
    assert all(len(c) <= chunking.TARGET for c in chunks)
    assert set(body.split()) <= {w for c in chunks for w in c.split()}
    assert chunking.natural_chunks("") == [] == chunking.natural_chunks(None)
    assert "".join(chunking.natural_chunks("x" * 4000, overlap=0)) == "x" * 4000


def test_chunk_ids_are_unique(spark):
    df = spark.createDataFrame([("t", "a", 0, 1), ("t", "a", 0, 2), ("t", "b", 1, 3), ("t", "b", 1, 4)], "base string, src string, prio int, pos int")
    got = values(chunking.unique_chunk_ids(df, "base", "src", "prio", "pos"), "pos", "chunk_id")
    assert got == [(1, "t"), (2, "t#2"), (3, "t@b"), (4, "t@b#2")]


def test_counts_state_their_completeness(spark):
    verdicts = spark.createDataFrame([("a", "include"), ("a", "unknown"), ("b", "include"), ("c", "unknown"), ("d", "conflict")], "g string, verdict string")
    got = values(stats.counted_with_status(verdicts, F.lit(True), ["g"]), "g", "status", "count")
    assert got == [("a", "lower_bound", 1), ("b", "exact", 1), ("c", "missing", None), ("d", "ambiguous", None)]


def test_admission_ignores_rejected_calls(spark):
    ts = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:06", "2024-01-01 00:10", "2024-01-01 00:12"])
    df = spark.createDataFrame(pd.DataFrame({"event_id": [1, 2, 3, 4], "user_id": 7, "ts": ts}))
    got = values(admission.admitted(df, "user_id", "ts", "event_id", 600, 1), "event_id", "accepted")
    assert got == [(1, True), (2, False), (3, True), (4, False)]


def test_streaming_dedup_and_days(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    once = admission.first_of_signature_stream(stream, ["user_id", "event_type"], "ts", "60 days")
    run = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert spark.table("once").count() == events.select("user_id", "event_type").distinct().count()
    days = admission.daily_counts_stream(stream, "user_id", "ts", "0 seconds")
    run = days.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    closed = spark.table("days").groupBy().agg(F.max("day")).first()[0]
    expected = events.where(F.to_date("ts") <= F.lit(closed)).groupBy("user_id", F.to_date("ts").alias("day")).count()
    assert values(spark.table("days"), "user_id", "day", "n") == values(expected, "user_id", "day", "count")


def test_fingerprints_see_nulls(spark):
    a = spark.createDataFrame([(1, None, "x")], "k int, a string, b string")
    b = spark.createDataFrame([(1, "x", None)], "k int, a string, b string")
    changed = incremental.change_events(incremental.fingerprints(a, "k", ["a", "b"]), incremental.fingerprints(b, "k", ["a", "b"]), "k")
    assert values(changed, "k", "event") == [(1, "modified")]


def test_missing_sources_are_empty(spark, tmp_path):
    assert files.keyed_json(spark, str(tmp_path / "no.json"), "a int").count() == 0
    assert vectors.collections(spark, str(tmp_path / "none")).count() == 0


def test_append_keeps_duplicate_ids(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.createDataFrame([("1", "d", [3.0, 4.0], "c"), ("2", "d", [0.0, 0.0], "c")], "id string, document string, embedding array<float>, collection string")
    vectors.add(rows, path)
    vectors.add(rows, path)
    back = vectors.collections(spark, path, ["c"])
    assert back.count() == 4
    assert values(back.distinct(), "id", "embedding") == [("1", [0.6000000238418579, 0.800000011920929]), ("2", [0.0, 0.0])]


def test_embedding_interface_keeps_unanswered_batches(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    assert values(vectors.embedded(rows, "text", lambda texts: None), "id", "embedding") == [(1, None), (2, None)]


def test_arguments_are_checked(spark, sf):
    with pytest.raises(ValueError, match="relation"):
        entity_query(spark, sf, "a", "other")
    with pytest.raises(ValueError, match="target"):
        entity_query(spark, sf, "a", "co_occur")
    assert phrase_to_plan(spark, sf, "tell me a story") is None


def test_landed_source(spark, tmp_path):
    from corpusloom.sources.landed import Landed, landed_pages

    (tmp_path / "p.jsonl").write_text('{"pageid": 1, "title": "a", "lastrevid": 2, "content": "x"}\n{broken\n', encoding="utf-8")
    spark.dataSource.register(Landed)
    rows = spark.read.format("landed").option("path", str(tmp_path)).load()
    assert values(rows.where("error is null"), "pageid", "title") == [(1, "a")]
    assert rows.where("error is not null").count() == 1
    assert values(landed_pages(spark, str(tmp_path)).where("error is null"), "pageid", "title") == [(1, "a")]


def test_html_text(spark):
    html = "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><p>one&amp;two<br>three</p><!-- no --><ul><li>four</li></ul></body></html>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(text.html_text("h")).collect()] == ["T\none&two\nthree\nfour", "", ""]


def test_best_window(spark):
    df = spark.createDataFrame([(1, "aa " * 30 + "x bb aa"), (2, "none"), (3, None)], "doc_id long, text string")
    got = chunking.best_windows(df, ["aa", "bb", "x"], width=10).collect()
    assert [(r["doc_id"], r["found"], r["snippet"]) for r in got] == [(1, 3, "aa aa x bb")]


def test_line_coverage(spark):
    df = spark.createDataFrame([("the first line\nanother long line\nlost forever", "The first line!\nanother long line")], "a string, b string")
    row = reconcile.line_coverage(df, "a", "b").first()
    assert row["missing"] == ["lost forever"] and row["covered"] == pytest.approx(2 / 3)


def test_same_rows_is_a_multiset_test(spark):
    one, two = spark.createDataFrame([(1,), (1,), (2,)], "a int"), spark.createDataFrame([(2,), (1,), (1,)], "a int")
    assert files.same_rows(one, two) and not files.same_rows(one, two.distinct())


def test_manifest_reasons(spark):
    bodies = spark.createDataFrame([("a", bytearray(b"one\r\ntwo")), ("b", bytearray(b" ")), ("c", bytearray(b"TODO")), ("d", bytearray(b"x"))], "name string, content binary").withColumn("sha256", F.sha2("content", 256))
    manifest = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", "0"), ("e", None)], "name string, sha256 string")
    got = {r["name"]: r["reason"] for r in files.imported(manifest, bodies).collect()}
    assert got == {"a": None, "b": "empty", "c": "placeholder", "d": "hash", "e": "missing"}


def test_empty_tables_give_empty_results(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert retrieval.bm25(docs, "the", 5).count() == chunking.chunked(docs).count() == chunking.best_windows(docs, ["a"]).count() == 0
    names = spark.createDataFrame([], "entity_id string, name string")
    assert mentions.mention_index(docs, names).count() == 0
    vectors_table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([], "query_id long, query array<float>")
    assert retrieval.exact_knn(vectors_table, asked, 3).count() == 0
    assert reconcile.keyed_merge(docs.toDF("l", "k"), docs.toDF("r", "k"), "l", "r", "k").count() == 0
