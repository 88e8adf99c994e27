"""Content tiers against a plain reading of their rules."""

from __future__ import annotations

import random
import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from corpusloom.operators import content

RNG = random.Random(8)


def norm(text):
    return re.sub("[^0-9A-Za-z一-鿿]", "", re.sub("<[^>]+>", "", text or ""))


def loose(text):
    return norm(re.sub("[（(][^（）()]*[）)]", "", re.sub("<[^>]+>", "", text or "")))


def tier_of(text, pages, share):
    n, o = norm(text), loose(text)
    if len(n) < 6:
        return None
    lines = [x for x in map(norm, text.split("\n")) if len(x) >= 6]
    found = {tier: [] for tier in content.TIERS}
    for page, blocks in pages:
        both = [(norm(b), loose(b)) for b in blocks]
        flat = next(((i, "block_exact" if n == bn else "block_loose") for i, (bn, bo) in enumerate(both) if n == bn or (len(o) >= 6 and o == bo)), None)
        inside = [(i, len(bn) if n in bn else len(bo)) for i, (bn, bo) in enumerate(both) if n in bn or (len(o) >= 6 and o in bo)]
        if flat:
            found[flat[1]].append((0, page, [flat[0]]))
        elif len(inside) == 1:
            found["block_contains"].append((inside[0][1], page, [inside[0][0]]))
        elif len(lines) >= 2:
            hits = [[i for i, (bn, _) in enumerate(both) if line in bn] for line in lines]
            if all(len(h) == 1 for h in hits):
                order = list(dict.fromkeys(h[0] for h in hits))
                if len(order) == 1:
                    found["block_contains"].append((len(both[order[0]][0]), page, order))
                else:
                    found["multi_blocks"].append((0, page, order))
        whole = "\n".join(blocks)
        if n in norm(whole):
            found["page_exact"].append((0, page, []))
        elif len(o) >= 6 and o in loose(whole):
            found["page_loose"].append((0, page, []))
    if share and not any(found.values()) and len(n) >= 16:
        middle = max(0, len(n) // 2 - 4)
        for page, blocks in pages:
            whole = norm("\n".join(blocks))
            if any(x in whole for x in (n[:8], n[middle : middle + 8], n[-8:])) and sum(b.size for b in SequenceMatcher(None, n, whole).get_matching_blocks()) >= share * len(n):
                found["page_fragment"].append((0, page, []))
    for tier in content.TIERS:
        if found[tier]:
            best = [x for x in found[tier] if x[0] == min(found[tier])[0]]
            return (tier, best[0][1], best[0][2], "matched") if len(best) == 1 else (tier, None, None, "ambiguous")
    return None


def test_all_tiers_by_brute_force(spark):
    def words(n):
        return " ".join("".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(3, 7))) for _ in range(n))

    pages = [(i, [words(RNG.randint(2, 9)) + (" (aside)" if RNG.random() < 0.3 else "") for _ in range(RNG.randint(1, 4))]) for i in range(40)]
    pages += [(40, list(pages[3][1])), (41, [pages[4][1][0], pages[4][1][0]]), (42, []), (43, ["x", None])]
    pages = [(i, [b for b in blocks if b]) for i, blocks in pages]
    texts = ["tiny", "", None, "nowhere to be found at all", "(all in brackets only)"]
    for _, blocks in pages[:42]:
        b = RNG.choice(blocks)
        texts += [b, "<i>" + b.replace(" ", ", ") + "</i>", b[: len(b) // 2] + "(or not)" + b[len(b) // 2 :], b[3 : 3 + len(b) // 2], "\n".join(blocks), "\n".join(blocks[::-1][:2]), " ".join(blocks)[5:-5], b[: len(b) // 2] + "q" + b[len(b) // 2 :], b[:9] + "\n" + b[12:]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    held = spark.createDataFrame(pages, "page int, blocks array<string>").repartition(3)
    got = {r.id: (r.tier, r.page, r.blocks, r.status) for r in content.content_tiers(df, "id", "text", held, "page", "blocks").collect()}
    want = {i: tier_of(t, pages, 0.85) or (None, None, None, "missing") for i, t in rows}
    assert got == want
    assert {tier for tier, *_ in want.values()} == {*content.TIERS, None} - ({"page_loose"} - {t for t, *_ in want.values()})
    assert Counter(x[3] for x in want.values())["ambiguous"] > 5


def test_containment_of_every_length(spark):
    body = "".join(RNG.choice("abcdefgh") for _ in range(400))
    asked = [body[a : a + n] for a, n in ((0, 6), (10, 7), (20, 12), (33, 23), (40, 24), (5, 395), (0, 400))] + ["zzzzzzz", "short"]
    texts = [body, body[:200], body[30:60], "zzz"]
    found = content.contained(spark.createDataFrame([(x,) for x in asked], "text string"), spark.createDataFrame([(x,) for x in texts * 3], "text string"))
    names = {r.d: r.text for r in spark.createDataFrame([(x,) for x in {*asked, *texts}], "text string").select(F.md5("text").alias("d"), "text").collect()}
    assert {(names[r.asked], names[r.searched]) for r in found.collect()} == {(a, t) for a in asked for t in texts if a in t and len(a) >= 6}


def test_cascade_of_lookups(spark):
    from corpusloom.operators.cascade import cascaded_cast

    entries = [
        (1, "A", None, [], None), (2, "B 「x」", None, [], None), (3, "none", "Deed", [], None), (4, "none", "Act (1)", [], None), (5, "none", "Walk", ["Fair", "Fair Walk"], None),
        (6, "none", "Run", ["Fair"], None), (7, "none", None, ["Fair", "gone"], None), (8, "gone", None, [], ["own"]), (9, "void", None, [], ["own"]), (10, "void", None, [], None), (11, None, "", None, None),
    ]
    records = [("A", ["a"], "metadata"), ("Bx", ["b"], "metadata"), ("Deed·1", ["d", "e"], "metadata"), ("Deed·2", ["e", "f"], "speaker_lines"), ("Act1·1", ["g"], "metadata"), ("Fair", ["h"], "metadata"), ("Fair Walk", ["i"], "metadata"), ("void", [], "metadata")]
    e = spark.createDataFrame(entries, "id int, title string, act string, aliases array<string>, listed array<string>")
    r = spark.createDataFrame(records, "key string, cast array<string>, source string")
    got = {row["id"]: (row.tier, row["cast"], row.source) for row in cascaded_cast(e, r).collect()}
    want = {1: (1, ["a"], "metadata"), 2: (2, ["b"], "metadata"), 3: (5, ["d", "e", "f"], "speaker_lines"), 4: (5, ["g"], "metadata"), 5: (6, ["i"], "metadata"), 6: (7, ["h"], "activity_inherited")}
    want |= {7: (6, ["h"], "metadata"), 8: (8, ["own"], "infobox_text"), 9: (8, ["own"], "infobox_text"), 10: (1, [], ""), 11: (None, [], "")}
    assert got == want
    assert cascaded_cast(e.where("false"), r).count() == 0 and cascaded_cast(e, r.where("false")).count() == 11
