"""Fuzzy names against the full scan of all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from corpusloom.operators import fuzzy
from corpusloom.plans.ranked import SOUNDS, fuzzy_names

ALIKE = ("石时史", "飞绯匪", "匪废", "ae", "dt")


def scanned(asked, names, n, floor, alike):
    found = set()
    for a in {x for x in asked if x}:
        scored = []
        for b in {x for x in names if x}:
            ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
            same = sum(x == y for x, y in zip(a, b, strict=False))
            sounds = len(a) == len(b) and same and all(x == y or any(x in g and y in g for g in alike) for x, y in zip(a, b, strict=True))
            if ratio >= floor:
                scored.append((-ratio, len(b), b))
            elif sounds:
                scored.append((-(0.6 + 0.3 * same / len(a)), len(b), b))
        found |= {(a, b, round(-score, 9), at) for at, (score, _, b) in enumerate(sorted(scored)[:n], 1)}
    return found


def some_names(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choices("aabcdet石时飞绯匪 ", k=draw.choice((1, 2, 2, 3, 4, 6, 9, 15, 40)))) for _ in range(n)]


@pytest.mark.parametrize("floor", [0.3, 0.6, 0.75, 1.0])
def test_as_the_full_scan(spark, floor):
    asked, names = [*some_names(1, 80), None, "", "飞石", "飞石"], [*some_names(2, 300), *some_names(1, 10), None, "", "废石", "绯时", "匪石"]
    left = spark.createDataFrame([(x, i) for i, x in enumerate(asked)], "own string, name int").repartition(3)
    right = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "label string, asked int").repartition(3)
    for alike in ((), ALIKE):
        got = {(r["asked"], r["name"], round(r["score"], 9), r["rank"]) for r in fuzzy.similar_to_each(left, "own", right, "label", 3, floor, alike).collect()}
        assert got == scanned(asked, names, 3, floor, alike)


def test_groups_that_share_a_letter_are_one_class_but_not_alike():
    at = dict(zip(*fuzzy.classes(ALIKE), strict=True))
    assert at["飞"] == at["匪"] == at["废"] != at["石"] and at["a"] == at["e"]
    groups = [frozenset(g) for g in ALIKE]
    assert fuzzy.aligned_score("飞石", "废石", groups) == 0.0
    assert fuzzy.aligned_score("飞石", "匪石", groups) == fuzzy.aligned_score("匪石", "废石", groups) == 0.75
    assert fuzzy.aligned_score("飞石", "匪时", groups) == fuzzy.aligned_score("飞石", "飞石x", groups) == 0.0


def test_only_close_pairs_meet(spark):
    names = spark.createDataFrame([(x,) for x in sorted(set(some_names(3, 400)))], "name string")
    met = fuzzy.candidates(names, names, 0.8).count()
    assert met < names.count() ** 2 / 4


def test_nothing(spark):
    empty = spark.createDataFrame([], "name string")
    one = spark.createDataFrame([("x",)], "name string")
    assert [fuzzy.similar_to_each(a, "name", b, "name", alike=("xy",)).count() for a, b in ((empty, one), (one, empty), (one, one))] == [0, 0, 1]


def test_parts(spark):
    rows = spark.createDataFrame([("a, b，c", None), ("\n c\n", "d"), (None, "")], "x string, y string")
    assert sorted(r["name"] for r in fuzzy.name_parts(rows, ["x", "y"]).collect()) == ["a", "b", "c", "d"]


def test_query_is_the_full_scan(spark, sf):
    """Over the whole tables; both a ratio and the sound decide some rows."""
    got = {(r["asked"], r["name"], round(r["score"], 9), r["rank"]) for r in fuzzy_names(spark, sf).collect()}
    names = {x for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").collect() for x in (r[0], *r[0].split(" "))}
    other, none = str.maketrans(*SOUNDS), dict.fromkeys(map(ord, "aeiou"))
    asked = {y for x in names for y in (x.translate(other), x.translate(none))} | {r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_name").collect()}
    assert got == scanned(asked, names, 3, 0.6, ("aeiou", "dt", "gk", "lr"))
    ratios = {SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.6 for a, b, _, _ in got}
    assert ratios == {True, False}
