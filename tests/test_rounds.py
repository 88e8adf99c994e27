"""Operators that take several rounds or keep state, against the folds that they replace."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chains, greedy, nested
from corpusloom.streaming import sinks, stateful

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(2, 9))) for _ in range(300)]
START = datetime(2024, 1, 1)


def values(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)


def test_pointers_of_awkward_json(spark):
    rows = [(1, '{"b":{"a/b~c":[1,2.5,[true,null,{}]]},"":"x"}'), (2, '"just"'), (3, None), (4, "{bad"), (5, "[]"), (6, '{"0":[7]}')]
    got = values(nested.pointers(spark.createDataFrame(rows, "id int, j string"), ["id"], "j"), "id", "place", "pointer", "kind", "value")
    want = [(1, 1, "/", "string", "x"), (1, 2, "/b/a~1b~0c/0", "number", "1"), (1, 3, "/b/a~1b~0c/1", "number", "2.5"), (1, 4, "/b/a~1b~0c/2/0", "boolean", "true"), (1, 5, "/b/a~1b~0c/2/1", "null", None)]
    want += [(1, 6, "/b/a~1b~0c/2/2", "object", "{}"), (2, 1, "", "string", "just"), (5, 1, "", "array", "[]"), (6, 1, "/0/0", "number", "7")]
    assert got == sorted(want, key=repr)


def test_span_citations_at_any_depth(spark):
    text = '{"b":{"evidence":[{"source_span_id":"s2"},{"x":1}]},"evidence":[{"source_span_id":"s1"},{"source_span_id":"s2","evidence":[{"source_span_id":"s3"}]},{"source_span_id":""}]}'
    rows = [(1, text), (2, '{"evidence":{"0":{"source_span_id":"an object is no list"}}}'), (3, '[[[{"evidence":[{"source_span_id":"deep"}]}]]]'), (4, None)]
    got = values(nested.span_citations(spark.createDataFrame(rows, "id int, j string"), ["id"], "j"), "id", "place", "span")
    assert got == [(1, 1, "s1"), (1, 2, "s2"), (1, 3, "s3"), (3, 1, "deep")]


def by_group(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return groups.items()


def not_covered(rows, ratio=1.2, fragment=24, share=0.5):
    out = []
    for g, members in by_group(rows):
        kept = []
        bodies = [(i, re.sub(r"[^\w]+", "", re.sub(r"\{\{[^{}]*\}\}", " ", t or ""))) for _, i, t in members]
        for i, body in sorted(bodies, key=lambda x: (-len(x[1]), x[0])):
            pieces = [body[k : k + fragment] for k in range(0, len(body) - fragment, fragment)]
            if len(body) < 4 * fragment or not any(len(o) >= ratio * len(body) and sum(p in o for p in pieces) >= share * len(pieces) for o in kept):
                kept.append(body)
                out.append((g, i))
    return sorted(out)


def no_variant(rows):
    out = []
    for g, members in by_group(rows):
        kept = []
        for _, i, t, s, p in sorted(members, key=lambda x: (-x[3], x[1])):
            mine = set(p or [])
            alike = lambda o, n, theirs: min(s, n) / max(s, n) >= 0.6 and len(mine & theirs) / max(1, len(mine | theirs)) >= 0.7  # noqa: B023, E731
            if not any(len(t) >= 3 and s and (t in o or (len(o) >= 3 and o in t)) and alike(o, n, theirs) for o, n, theirs in kept):
                kept.append((t, s, mine))
                out.append((g, i))
    return sorted(out)


@pytest.fixture
def few_leaders(monkeypatch):
    """So few that several rounds are needed."""
    plain = greedy.first_that_stay
    monkeypatch.setattr(greedy, "first_that_stay", lambda *args: plain(*args, leaders=2))


def test_coverage_is_the_fold(spark, few_leaders):
    base = [[" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(20, 200))) for _ in range(4)] for _ in range(2)]
    rows = [(0, 1000, None), (0, 1001, ""), (0, 1002, "short"), (1, 1003, "{{gone}} " + base[1][0])]
    for i in range(90):
        body = RNG.choice(base[i % 2])
        a = RNG.randint(0, len(body) // 2)
        rows.append((i % 2, i, body[a : RNG.randint(a, len(body))] + " " + " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(0, 20)))))
    found = greedy.without_covered(spark.createDataFrame(rows, "g int, i int, t string").repartition(3), "g", "i", "t")
    want = not_covered(rows)
    assert values(found, "g", "i") == sorted(want, key=repr) and 10 < len(want) < 90


def test_variants_are_the_fold(spark, few_leaders):
    rows = [(0, 900, "title", 0, []), (0, 901, "title", 100, None), (0, 902, "title", 100, []), (1, 903, "ti", 100, WORDS[:12])]
    for i in range(150):
        k = RNG.randint(0, 5)
        profile = [w for w in WORDS[12 * k : 12 * k + 12] if RNG.random() > 0.08] + [RNG.choice(WORDS) for _ in range(RNG.randint(0, 3))]
        rows.append((i % 2, i, ("title" + "x" * (k % 3))[: RNG.randint(2, 8)], RNG.randint(50, 140), profile))
    df = spark.createDataFrame(rows, "g int, id int, title string, size int, profile array<string>").repartition(3)
    want = no_variant(rows)
    assert values(greedy.without_variants(df, "g"), "g", "id") == sorted(want, key=repr) and 20 < len(want) < 120


def test_equal_rows_need_few_pairs(spark):
    """A group of copies: the first stays, and each other meets only the leaders."""
    df = spark.createDataFrame([("g", i, "same title", 100, WORDS[:20]) for i in range(400)], "g string, id int, title string, size int, profile array<string>")
    assert values(greedy.without_variants(df, "g"), "id") == [(0,)]


@pytest.mark.parametrize("most", [100, 1, 10_000])
def test_sections_are_the_fold(spark, most):
    rows = [(None if i % 50 == 0 else (1 if RNG.random() < 0.7 else RNG.randint(2, 5)), i, RNG.choice([0, 0, 5, 30, 70, 101, None, 250])) for i in range(400)]
    state, want = {}, []
    for k, i, n in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        n = n or 0
        if k not in state:
            state[k] = [0, 0]
        elif state[k][0] + n > most:
            state[k] = [0, state[k][1] + 1]
        state[k][0] += n
        want.append((k, i, state[k][1]))
    df = spark.createDataFrame(rows, "k int, i int, n int").repartition(5)
    assert values(chains.packed_sections(df, "k", ["i"], "n", most), "k", "i", "bucket") == sorted(want, key=repr)
    assert chains.packed_sections(df.where("false"), "k", ["i"], "n", most).count() == 0


@pytest.mark.parametrize("apart", [7, 5000])
def test_spacing_is_the_fold(spark, apart):
    rows = [(1 if RNG.random() < 0.8 else 2, i, START + timedelta(seconds=RNG.randint(0, 1500)) if i % 40 else None) for i in range(400)]
    last, want = {}, [(k, i, False) for k, i, ts in rows if not ts]
    for k, i, ts in sorted((r for r in rows if r[2]), key=lambda r: (r[0], r[2], r[1])):
        accepted = k not in last or ts >= last[k] + timedelta(seconds=apart)
        last[k] = ts if accepted else last[k]
        want.append((k, i, accepted))
    df = spark.createDataFrame(rows, "k int, i int, ts timestamp").repartition(5)
    assert values(chains.spaced(df, "k", "ts", ["i"], apart), "k", "i", "accepted") == sorted(want, key=repr)


def test_streamed_admission_with_a_limit(spark, tmp_path):
    """Three in five minutes, over a stream that starts again; a key that was silent is admitted anew."""
    rows = [(i, i % 2, START + timedelta(seconds=40 * i + (3600 if i > 30 else 0))) for i in range(45)]
    kept, want = {0: [], 1: []}, []
    for i, k, ts in rows:
        kept[k] = [t for t in kept[k] if t > ts - timedelta(minutes=5)]
        want.append((i, len(kept[k]) < 3))
        kept[k] += [ts] if want[-1][1] else []
    df = spark.createDataFrame(rows, "event_id long, user_id int, ts timestamp")
    found = stateful.run_over(spark, df, "ts", str(tmp_path), lambda s: stateful.judged(s, "user_id", stateful.Admission("ts", "event_id", 300, 3)), 2)
    assert values(found, "event_id", "accepted") == sorted(want, key=repr)


def test_judges():
    minute = 60_000_000
    breaker = stateful.Breaker("ts", "i", "failed", 2)
    import pandas as pd

    rows = pd.DataFrame({"failed": [True, False, True, True, False]})
    assert breaker.judge([], [], rows) == ([False, False, False, True, True], [2])
    assert breaker.judge([1], [], rows[:1]) == ([True], [2])
    cache = stateful.Expiring("ts", "i", 300)
    assert cache.judge([], [0, minute, 5 * minute, 9 * minute], None) == ([True, False, True, False], [5 * minute])


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """The writer fails after it has written; the stream starts again and writes the batch once more."""
    rows = spark.createDataFrame([(i, i % 5, START + timedelta(seconds=i), i % 3 == 0) for i in range(30)], "event_id long, k long, ts timestamp, valid boolean")
    table = sinks.KeyedTable(spark, str(tmp_path / "table"), ["k"], ["event_id"], "event_id long, k long, ts timestamp, valid boolean")
    assert table.rows().count() == 0 and table.base_epoch() == -1
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    failed = []

    def write(batch, epoch):
        table.upsert(batch, epoch)
        sinks.append_events(batch, epoch, str(tmp_path / "log"))
        if not failed:
            failed.append(epoch)
            raise RuntimeError("the driver is lost")

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="driver is lost"):
        run()
    run()
    assert failed == [0] and spark.read.parquet(str(tmp_path / "log")).count() == 30
    assert values(table.rows(), "k", "event_id") == [(0, 25), (1, 26), (2, 27), (3, 28), (4, 29)]
    assert values(sinks.pending(table, "valid"), "k") == [(0,), (1,), (3,), (4,)]


def test_compaction_keeps_the_table(spark, tmp_path):
    table = sinks.KeyedTable(spark, str(tmp_path), ["k"], ["n"], "k long, n long, v string")

    def batch(*rows):
        return spark.createDataFrame(rows, "k long, n long, v string")

    table.upsert(batch((1, 1, "a"), (2, 1, "b"), (1, 2, "c")), 0)
    table.upsert(batch((2, 5, None), (3, 1, "d")), 1)
    before = values(table.rows(), "k", "n", "v")
    assert before == [(1, 2, "c"), (2, 5, None), (3, 1, "d")]
    table.compact(1)
    table.upsert(batch((2, 5, None), (3, 1, "d")), 1)  # an old epoch once more
    assert values(table.rows(), "k", "n", "v") == before and table.base_epoch() == 1
    table.upsert(batch((1, 1, "late"), (3, 9, "e")), 2)
    assert values(table.rows(), "k", "n", "v") == [(1, 2, "c"), (2, 5, None), (3, 9, "e")]


def test_pieces_land_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, START + timedelta(seconds=i)) for i in range(40)] + [(99, None)], "i long, ts timestamp")
    seen = []
    for _ in stateful.landed_in_order(rows, "ts", str(tmp_path / "in"), 3):
        seen.append(spark.read.parquet(str(tmp_path / "in")).agg(F.count(F.lit(1)), F.max("i")).first())
    assert [r[0] - 1 for r in seen] == [r[1] for r in seen] and seen[-1][0] == 40
