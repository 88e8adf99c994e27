"""Cases of the fifth round."""

import os
import random
from datetime import datetime, timedelta

from corpusloom import catalog
from corpusloom.operators import content, greedy
from corpusloom.session import ensure_checkpoint_dir
from corpusloom.streaming import stateful

SF = "/root/testdata/sf0.01"
T0 = datetime(2026, 1, 1)


def _held(spark):
    """Bytes in the folder that executors share."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(folder) for name in names)


def _grown(spark, name):
    """What a query leaves in the shared folder, in bytes of the documents table."""
    before = _held(spark)
    catalog.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    return (_held(spark) - before) / os.path.getsize(f"{SF}/documents.parquet")


def test_suppressed_variants_keeps_little(spark):
    assert _grown(spark, "suppressed_variants") < 5


def test_content_tiers_keeps_little(spark):
    assert _grown(spark, "content_tiers") < 4


def test_content_tiers_across_blocks(spark):
    """A tag that opens in one block and closes in the next is lost in the page and stays in the blocks; pages without id or blocks do no harm."""
    pages = [(1, ["alpha beta <gamma", "delta> epsilon zeta", "plain line of text"]), (2, None), (None, ["another page here"]), (3, [None, "lonely words (aside) stay"])]
    asked = [(1, "alpha beta epsilon"), (2, "alpha beta <gamma"), (3, "plain line\nof text"), (4, "another page"), (5, "lonely words stay"), (6, None), (7, "absent words")]
    df = spark.createDataFrame(asked, "id int, text string")
    got = {r.id: (r.tier, r.page, r.status) for r in content.content_tiers(df, "id", "text", spark.createDataFrame(pages, "page int, blocks array<string>"), "page", "blocks").collect()}
    assert got[1] == ("page_exact", 1, "matched") and got[2] == ("block_exact", 1, "matched") and got[3] == ("block_exact", 1, "matched")
    assert got[4] == ("block_contains", None, "matched") and got[5] == ("block_loose", 3, "matched")
    assert got[6] == got[7] == (None, None, "missing")


def test_variants_of_nested_titles(spark):
    """Titles that stand in one another, of all lengths, missing ones and missing groups, against a fold."""
    rng, rows = random.Random(5), []
    for at in range(160):
        words = rng.sample("abcdefgh", rng.randint(0, 8)) if at % 3 else list("abcdefgh")
        title = rng.choice(["red", "red fox", "a red fox", "fo", "fox", "x", None, "a red fox runs on"])
        rows.append((rng.choice(["p", "q", None]), at, title, rng.choice([0, 9, 10, 12, 30]), words))
    stay = []
    for group, key, title, size, words in sorted(rows, key=lambda r: (-r[3], r[1])):
        for g, _, other, most, theirs in stay:
            family = title and other and len(title) >= 3 and (title in other or (len(other) >= 3 and other in title))
            if g == group and family and size > 0 and size >= 0.6 * most and words and 10 * len(set(words) & set(theirs)) >= 7 * len(set(words) | set(theirs)):
                break
        else:
            stay.append((group, key, title, size, words))
    df = spark.createDataFrame(rows, "g string, id int, title string, size int, profile array<string>")
    assert sorted(r.id for r in greedy.without_variants(df, "g").collect()) == sorted(r[1] for r in stay)


def test_state_travels_with_the_rows(spark, tmp_path):
    """A key's state comes with its rows and not by calls of its own; three pieces judge as one."""
    rows = [(i, i % 7, T0 + timedelta(hours=i // 2), i % 5 < 3) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, k long, ts timestamp, failed boolean")
    plans = []

    def plan(stream):
        found = stateful.judged(stream, "k", stateful.Breaker("ts", "i", "failed", 3))
        plans.append(found._jdf.queryExecution().logical().toString())
        return found

    got = {r.i: r.opened for r in stateful.run_over(spark, df, "ts", str(tmp_path), plan, 3).collect()}
    strikes, want = {}, {}
    for i, k, _, failed in rows:
        if strikes.get(k, 0) < 3:
            strikes[k] = strikes.get(k, 0) + 1 if failed else 0
        want[i] = strikes[k] >= 3
    assert got == want
    assert all("TransformWithState" not in text for text in plans)


def test_typed_neighbours_makes_few_rows_distinct(spark):
    """Links are cut to the first of each source before anything gathers them in memory."""
    plan = catalog.queries()["typed_neighbours"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.index("Aggregate [") < plan.index("dense_rank")
