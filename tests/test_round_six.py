"""Cases of the sixth round."""

import random

from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.operators import content, reconcile
from tests.compare import oracle, spark_rows

LEAST = -(2**63)


def test_best_scored_match_names_a_supplier_with_a_key(spark, tmp_path):
    """Against its SQL: a supplier without a key has the best score, alone, with others near it or far from it, or the key is the least long."""
    customers = [(1, 1, 100.0), (2, 1, 140.0), (3, 2, 100.0), (4, 3, 100.0), (5, 4, 100.0), (None, 4, 130.0)]
    suppliers = [(None, 1, 100.0), (6, 1, 120.0), (7, 1, 1500.0), (None, 2, 100.0), (8, 2, 900.0), (None, 3, 100.0), (LEAST, 4, 100.0), (9, 4, 120.0)]
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/spark/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/spark/supplier.parquet")
    for name in ("customer", "supplier"):
        next((tmp_path / "spark" / f"{name}.parquet").glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    got = spark_rows(catalog.queries()["best_scored_match"](spark, str(tmp_path)))
    assert got == oracle(catalog.oracle_sql()["best_scored_match"], str(tmp_path)) and len(got[1]) == 6


def test_best_match_takes_the_least_of_equal_ones(spark):
    scored = spark.createDataFrame([(1, "b", 0.9), (1, "a", 0.9), (1, None, 0.95), (2, "c", 0.5), (2, "a", 0.4), (3, None, 0.7), (4, "d", None)], "id int, other string, score double")
    got = {r.id: tuple(r)[1:] for r in reconcile.best_match(scored, "id", "other", "score").collect()}
    assert got == {1: ("a", 0.95, "review"), 2: ("c", 0.5, "merged"), 3: (None, 0.7, "merged")}


def test_answered_questions_knows_every_kind(spark, tmp_path):
    """Against its SQL, with more kinds than a thousand, one without a part's type and one in two spellings."""
    parts = [(i, "name", "Brand#1", "PROMO" if i % 500 == 0 else None if i == 7 else f"{'Type' if i % 2 else 'type'}{chr(65 + i % 26)} {i // 2 % 1200}") for i in range(2600)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/spark")
    next((tmp_path / "spark").glob("part-*.parquet")).rename(tmp_path / "part.parquet")
    got = spark_rows(catalog.queries()["answered_questions"](spark, str(tmp_path)))
    assert got == oracle(catalog.oracle_sql()["answered_questions"], str(tmp_path))


def test_pages_are_read_twice_for_any_number_of_tokens(spark, monkeypatch):
    """Before, the pages were read once for each block of tokens asked for."""
    monkeypatch.setattr(content, "TOKEN_BLOCK", 10, raising=False)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = [f"{i} and {i * i} make up text {i + 7}, which is long enough to have windows" for i in range(120)]
    pages = spark.createDataFrame([(i, [text, text.upper()]) for i, text in enumerate(texts)], "row long, texts array<string>").mapInArrow(count, "row long, texts array<string>")
    few = spark.createDataFrame([(str(i), text[3:40]) for i, text in enumerate(texts)] + [("none", "nowhere to be found")], "id string, text string")
    found = {tuple(row) for row in content._met(few, pages, 6).collect()}
    assert {(str(i), i) for i in range(120)} <= found and "none" not in {key for key, _ in found}
    assert read.value == 2 * len(texts)


def test_a_sieve_passes_what_is_asked_for(spark, monkeypatch):
    """With a bit for many tokens, more pass that nobody asks for, and the result is the same."""
    texts = [f"page {i} of {i * i} and more" for i in range(300)]
    few = spark.createDataFrame([(str(i), text) for i, text in enumerate(texts[::3])], "id string, text string")
    pages = spark.createDataFrame([(i, [text]) for i, text in enumerate(texts)], "row long, texts array<string>")
    wide = {tuple(row) for row in content._met(few, pages, 6).collect()}
    monkeypatch.setattr(content, "MOST_BITS", 11)
    assert {tuple(row) for row in content._met(few, pages, 6).collect()} == wide >= {(str(i), 3 * i) for i in range(100)}


def test_norm_keeps_letters_digits_and_ideographs(spark):
    import re

    text = "".join(chr(i) for i in [*range(1, 0xD800), *range(0xE000, 0x20000, 7), 0x10FFFF] if i not in (0x3C, 0x3E))
    got = spark.createDataFrame([(text,)], "t string").select(content.norm(F.col("t")).alias("n")).first().n
    assert got == re.sub("[^0-9A-Za-z一-鿿]", "", text)


def test_closest_match_is_best_match_of_all_pairs(spark):
    """Values close together, equal, far apart, infinite and none; several rows of an id; ids and keys that are missing."""
    rng = random.Random(11)
    values = [round(rng.uniform(-900, 900), 2) for _ in range(40)] + [rng.uniform(3000, 3000.2) for _ in range(30)] + [64.0, 128.0, 0.0, -0.0, 24.0, 1e300, -1e18, 9000.0, None, float("inf"), float("-inf")]
    near = lambda: rng.choice([rng.choice(values), (rng.choice(values) or 0.0) + rng.choice([0.01, -0.01, 24.0, 3990.0, -4000.0])])
    left = [(rng.choice([*range(150), None]), rng.choice([1, 2, 3, 4, 5, None]), near()) for _ in range(400)] + [(900, 1, float("nan")), (901, 4, float("nan")), (902, 7, 1.0), (903, 2, 5e4)]
    right = [(rng.choice([*range(-60, 60), None]), rng.choice([1, 2, 3, None]), near()) for _ in range(220)] + [(None, 4, 10.0), (7, 4, 12.5), (None, 5, float("nan")), (3, 3, float("nan")), (8, 5, 1.0), (9, 4, 3000.1)]
    a = spark.createDataFrame(left, "c long, k int, x double")
    b = spark.createDataFrame(right, "s long, j int, y double")
    score = lambda distance: F.round(1 / (1 + distance / 1000), 6)
    pairs = a.join(b, F.col("k") == F.col("j")).select("c", "s", score(F.abs(F.col("x") - F.col("y"))).alias("score"))
    want = reconcile.best_match(pairs, "c", "s", "score", floor=0.2)
    got = reconcile.closest_match(a, b, "c", "s", ("k", "j"), ("x", "y"), score, "score", near=0.05, floor=0.2, blur=0.03)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.status for r in want.collect()} == {"merged", "review"}


def test_best_scored_match_lists_no_pairs(spark):
    """The join of all customers and suppliers of a nation grows with their product."""
    plan = catalog.queries()["best_scored_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("c_nationkey" in line and "s_nationkey" in line for line in joins)


def test_a_common_run_makes_no_candidates(spark):
    """Long texts that share a frequent run with every page are met by what is rare in them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    common = "thisrunstandsoneverypageofthetable" * 4
    texts = [word() + word() + common + word() + word() for _ in range(200)]
    few = spark.createDataFrame([(str(i), text[4:-4]) for i, text in enumerate(texts)], "id string, text string")
    pages = spark.createDataFrame([(i, [text]) for i, text in enumerate(texts)], "row long, texts array<string>")
    assert len({tuple(row) for row in content._met(few, pages, 6).collect()} ^ {(str(i), i) for i in range(200)}) < 20
