"""Two sources or two snapshots of the same things: diffs, merges, fallbacks and duplicates."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranking import first_rows


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fingerprint: str, baseline: Column | None = None) -> DataFrame:
    """key, change: new, changed, unchanged, deleted; or baseline where the old row has none to compare with."""
    a = old.select(F.col(key), F.col(fingerprint).alias("_old"), F.lit(True).alias("_was"), *([baseline.alias("_base")] if baseline is not None else []))
    b = new.select(F.col(key), F.col(fingerprint).alias("_new"), F.lit(True).alias("_is"))
    both = a.join(b, key, "full_outer")
    base = F.coalesce(F.col("_base"), F.lit(False)) if baseline is not None else F.lit(False)
    change = (
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_is").isNull(), "deleted")
        .when(base, "baseline")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("changed")
    )
    return both.select(key, change.alias("change"))


def manifest_compare(manifest: DataFrame, observed: DataFrame, channel: str, key: str, fingerprint: str, status: str) -> DataFrame:
    """channel, key, change: new, updated (fingerprint differs or is missing, or the status is bad), removed (unless stale already), unchanged."""
    m = manifest.select(channel, key, F.col(fingerprint).alias("_old"), F.col(status).alias("_status"), F.lit(True).alias("_was"))
    o = observed.select(channel, key, F.col(fingerprint).alias("_new"), F.lit(True).alias("_is"))
    change = (
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_is").isNull(), F.when(F.col("_status") == "stale", "unchanged").otherwise("removed"))
        .when(F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")) | ~F.coalesce(F.col("_status") == "ok", F.lit(False)), "updated")
        .otherwise("unchanged")
    )
    return m.join(o, [channel, key], "full_outer").select(channel, key, change.alias("change"))


def updated_manifest(manifest: DataFrame, observed: DataFrame, key: str, fingerprint: str, fetched: str) -> DataFrame:
    """The manifest after a fetch: what has disappeared stays as stale, the first fetch time is kept."""
    m = manifest.select(key, F.col(fingerprint).alias("_f"), F.col(fetched).alias("_t"))
    o = observed.select(key, fingerprint, fetched, F.lit("ok").alias("_ok"))
    both = m.join(o, key, "full_outer")
    return both.select(key, F.coalesce(F.col(fingerprint), F.col("_f")).alias(fingerprint), F.coalesce("_t", fetched).alias(fetched), F.coalesce("_ok", F.lit("stale")).alias("status"))


def update_class(old: Column, new: Column, old_size: Column, new_size: Column, major: Sequence[str]) -> Column:
    """MAJOR, MINOR or META by headings added or removed (arrays) and by the change of length."""
    moved = F.concat(F.array_except(new, old), F.array_except(old, new))
    change = F.abs(new_size - old_size) / F.greatest(old_size, F.lit(1))
    important = F.exists(moved, lambda h: F.coalesce(F.lit(False) if not major else h.rlike("|".join(major)), F.lit(False)))
    return F.when(important | (change > 0.05), "MAJOR").when((F.size(moved) > 0) | (change > 0.01), "MINOR").otherwise("META")


def coalesced(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left rows with the right's values where those are not blank."""
    r = right.select(key, *[F.col(c).alias(f"_{c}") for c in columns])

    def solid(name: str) -> Column:
        return F.when(F.trim(F.col(name).cast("string")) != "", F.col(name))

    return left.join(r, key, "left").select(*[F.coalesce(solid(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in left.columns])


def backfilled(rows: DataFrame, fixes: DataFrame, key: str, column: str, bad: Column) -> DataFrame:
    """Rows whose column is bad get the fix for their key, if there is one."""
    f = fixes.select(key, F.col(column).alias("_fix"))
    return rows.join(f, key, "left").withColumn(column, F.when(bad, F.coalesce("_fix", column)).otherwise(F.col(column))).drop("_fix")


def by_priority(rows: DataFrame, row_id: str, attempts: Sequence[tuple[Column, DataFrame, str, str]]) -> DataFrame:
    """Adds target and tier: the first attempt (key expression, lookup, its key column, its value column) that finds something.

    Each attempt is an equi-join; candidates are ranked by tier and value, so a row has one target at most.
    """
    found = None
    for tier, (key, lookup, key_col, value_col) in enumerate(attempts, 1):
        side = lookup.select(F.col(key_col).alias("_key"), F.col(value_col).alias("target")).where("_key is not null")
        part = rows.select(row_id, key.alias("_key")).join(side, "_key").select(row_id, "target", F.lit(tier).alias("tier"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(row_id).agg(F.min(F.struct("tier", "target")).alias("_best"))
    return rows.join(best.select(row_id, "_best.tier", "_best.target"), row_id, "left")


def keyed_merge(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str, residual: Sequence[str] = ()) -> DataFrame:
    """left_id, right_id, status of a full merge on a key: left_only, merged (one partner), review (several), right_only.

    Residual columns must agree where both sides have them. A reviewed row names its least partner. Right rows without any
    candidate pair are right_only. Candidate pairs are counted, never listed, for each left row.
    """
    a = left.select(F.col(left_id), F.col(key).alias("_key"), *[F.col(c).alias(f"_l_{c}") for c in residual])
    b = right.select(F.col(right_id), F.col(key).alias("_key"), *[F.col(c).alias(f"_r_{c}") for c in residual])
    agree = F.lit(True)
    for c in residual:
        agree = agree & F.coalesce(F.col(f"_l_{c}") == F.col(f"_r_{c}"), F.lit(True))
    pairs = a.where("_key <> ''").join(b, "_key").where(agree)
    counted = pairs.groupBy(left_id).agg(F.count(F.lit(1)).alias("_n"), F.min(right_id).alias(right_id))
    lefts = left.select(left_id).join(counted, left_id, "left").select(
        left_id, right_id, F.when(F.col("_n").isNull(), "left_only").when(F.col("_n") == 1, "merged").otherwise("review").alias("status")
    )
    lonely = right.select(right_id).join(pairs.select(right_id).distinct(), right_id, "left_anti")
    kind = dict(left.dtypes)[left_id]
    return lefts.unionByName(lonely.select(F.lit(None).cast(kind).alias(left_id), right_id, F.lit("right_only").alias("status")))


def best_match(scored: DataFrame, left_id: str, right_id: str, score: str, near: float = 0.05, floor: float = 0.0) -> DataFrame:
    """left_id, right_id, score, status: the best candidate; review if another one is within `near` of it.

    The best one that has an id is named, the least of equal ones; those without an id count for score and status.
    """
    window = Window.partitionBy(left_id)
    good = scored.where(F.col(score) >= floor).withColumn("_best", F.max(score).over(window))
    first = F.min(F.when(F.col(right_id).isNotNull(), F.struct((-F.col(score)).alias("_score"), F.col(right_id).alias("_id"))))
    close = good.where(F.col(score) >= F.col("_best") - near).groupBy(left_id).agg(first.alias("_first"), F.max(score).alias(score), F.count(F.lit(1)).alias("_n"))
    return close.select(left_id, F.col("_first._id").alias(right_id), score, F.when(F.col("_n") > 1, "review").otherwise("merged").alias("status"))


def _carried(rows: DataFrame, width: float, wanted: dict[str, tuple[Column, bool, int]]) -> DataFrame:
    """rows (k, v, kind) with columns by name: (what, later, until) is the last `what` that is not null among the earlier rows of the same k in the order of
    v and kind (later: the next one among the later rows), until the row before (-1) or itself (0). A task holds a cell of `width` of one k at a time."""
    rows = rows.select("*", F.floor(F.col("v") / width).alias("cell"), *[what.alias(f"_{name}") for name, (what, _, _) in wanted.items()])
    ends = [(F.min_by if later else F.max_by)(f"_{name}", F.when(F.col(f"_{name}").isNotNull(), F.struct("v", "kind"))).alias(name) for name, (_, later, _) in wanted.items()]

    def order(later: bool, *names: str) -> list[Column]:
        return [F.desc(name) if later else F.asc(name) for name in names]

    beyond = {name: F.last(name, True).over(Window.partitionBy("k").orderBy(*order(later, "cell")).rowsBetween(Window.unboundedPreceding, -1)) for name, (_, later, _) in wanted.items()}
    cells = rows.groupBy("k", "cell").agg(*ends).select("k", "cell", *[value.alias(f"_beyond_{name}") for name, value in beyond.items()])
    here = {name: F.last(f"_{name}", True).over(Window.partitionBy("k", "cell").orderBy(*order(later, "v", "kind")).rowsBetween(Window.unboundedPreceding, until)) for name, (_, later, until) in wanted.items()}
    found = rows.select("*", *[value.alias(f"_here_{name}") for name, value in here.items()]).join(cells, ["k", "cell"])
    return found.select("k", "v", "kind", *[F.coalesce(f"_here_{name}", f"_beyond_{name}").alias(name) for name in wanted])


def closest_match(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: tuple[str, str], value: tuple[str, str], score: Callable[[Column], Column], name: str, near: float, floor: float, blur: float, width: float = 64.0
) -> DataFrame:
    """What best_match gives for all pairs of equal keys, whose score is a function of how far their values (doubles) lie apart; no pair is listed.

    The score never rises with the distance, is below the floor for an infinite one and NaN for NaN; two distances more than `blur` apart have different
    scores, as far as these reach the floor. The best scores of a row are those of the two nearest values on either side, which equal values and
    windows over cells of `width` tell; the least of equally good ids stands within `blur` beyond the nearest value that has one.
    """
    a = left.select(F.col(left_id).alias("left"), F.col(key[0]).alias("k"), (F.col(value[0]) + F.lit(0.0)).alias("v")).where("k is not null and v is not null")
    b = right.select(F.col(right_id).alias("id"), F.col(key[1]).alias("k"), (F.col(value[1]) + F.lit(0.0)).alias("v")).where("k is not null and v is not null")
    infinite = float("inf")
    finite = F.abs("v") < infinite
    points = b.where(finite).groupBy("k", "v").agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("n"), F.min("id").alias("id")).withColumn("kind", F.lit(0))
    one, named = F.struct("v", "n"), F.when(F.col("id").isNotNull(), F.col("v"))
    linked = _carried(points, width, {"prev": (one, False, -1), "next": (one, True, -1), "below": (named, False, 0), "above": (named, True, 0), "n": (F.col("n"), False, 0)})
    asked = a.where(finite).select("k", "v").distinct().select("k", "v", F.lit(1).alias("kind"), F.lit(None).cast("struct<v:double,n:int,prev:struct<v:double,n:int>,next:struct<v:double,n:int>,below:double,above:double>").alias("p"))
    every = asked.unionByName(linked.select("k", "v", "kind", F.struct("v", F.col("n").cast("int").alias("n"), F.col("prev").cast("struct<v:double,n:int>").alias("prev"), F.col("next").cast("struct<v:double,n:int>").alias("next"), "below", "above").alias("p")))
    around = _carried(every, width, {"low": (F.col("p"), False, 0), "high": (F.col("p"), True, -1)}).where("kind = 1")

    def scored(x: Column) -> Column:
        return score(F.abs(F.col("v") - x))

    def good(x: Column) -> Column:
        return F.when(x >= floor, x)

    beside = [F.col("low"), F.col("low.prev"), F.col("high"), F.col("high.next")]
    best = F.flatten(F.array(*[F.coalesce(F.array_repeat(good(scored(x["v"])), x["n"]), F.array().cast("array<double>")) for x in beside]))
    best = F.slice(F.sort_array(F.filter(best, lambda x: x.isNotNull()), asc=False), 1, 2)
    away = F.least(F.col("v") - F.col("low.below"), F.col("high.above") - F.col("v"))
    around = around.select("k", "v", best.alias("best"), good(score(away)).alias("s"), away.alias("d")).where(F.size("best") > 0)

    # where the least id of equal scores may stand: cells of twice the blur
    def fine(x: Column) -> Column:
        return F.floor(x / (2 * blur))

    v, d = F.col("v"), F.col("d")
    spots = F.array_distinct(F.concat(F.sequence(fine(v - d - 1.25 * blur), fine(v - d + blur / 4)), F.sequence(fine(v + d - blur / 4), fine(v + d + 1.25 * blur))))
    spots = around.where("s is not null").select("k", "v", "s", F.explode(spots).alias("spot"))
    held = points.where("id is not null").select("k", fine(F.col("v")).alias("spot"), F.col("v").alias("w"), "id")
    least = spots.join(held, ["k", "spot"]).where(scored(F.col("w")) == F.col("s")).groupBy("k", "v").agg(F.min("id").alias("id"))
    found = around.drop("d").join(least, ["k", "v"], "left")

    # scores that are no number: of values that are none, and of infinite ones of one sign
    odd = {"nan": F.isnan("v"), "up": F.col("v") == infinite, "down": F.col("v") == -infinite, "any": F.lit(True)}
    odds = b.groupBy("k").agg(*[f.alias(f"{kind}_{what}") for kind, is_ in odd.items() for what, f in (("n", F.count(F.when(is_, 1))), ("id", F.min(F.when(is_, F.col("id")))))])
    rows = a.join(found, ["k", "v"], "left").join(odds, "k", "left")
    nan = F.lit(float("nan"))
    n = F.when(F.isnan("v"), F.col("any_n")).otherwise(F.col("nan_n") + F.when(v == infinite, F.col("up_n")).when(v == -infinite, F.col("down_n")).otherwise(0))
    odd_id = F.when(F.isnan("v"), F.col("any_id")).otherwise(F.least("nan_id", F.when(v == infinite, F.col("up_id")).when(v == -infinite, F.col("down_id"))))
    rows = rows.select("left", "best", "s", "id", n.alias("n"), odd_id.alias("odd"))
    is_odd = F.coalesce(F.col("n") > 0, F.lit(False))
    rows = rows.select("left", F.when(is_odd, F.array_repeat(nan, F.least("n", F.lit(2)).cast("int"))).otherwise(F.col("best")).alias("best"), F.when(is_odd, nan).otherwise(F.col("s")).alias("s"), F.when(is_odd, F.col("odd")).otherwise(F.col("id")).alias("id")).where(F.size("best") > 0)

    # rows that share an id share their candidates
    rows = rows.withColumn("m", F.max(F.col("best")[0]).over(Window.partitionBy("left")))
    named = F.when(F.col("id").isNotNull() & (F.col("s") >= F.col("m") - near), F.struct((-F.col("s")).alias("s"), "id"))
    close = rows.groupBy("left").agg(F.min(named).alias("first"), F.max("m").alias(name), F.sum(F.size(F.filter("best", lambda x: x >= F.col("m") - near))).alias("n"))
    return close.select(F.col("left").alias(left_id), F.col("first.id").alias(right_id), name, F.when(F.col("n") > 1, "review").otherwise("merged").alias("status"))


def tiered_match(rows: DataFrame, row_id: str, candidates: DataFrame, candidate_id: str, tiers: Sequence[Column]) -> DataFrame:
    """row_id, tier, candidate_id, status: candidates (row and candidate joined beforehand) of the lowest tier that holds; ambiguous if several."""
    tier = F.coalesce(*[F.when(condition, F.lit(i)) for i, condition in enumerate(tiers, 1)])
    placed = candidates.withColumn("tier", tier).where("tier is not null")
    counts = placed.groupBy(row_id, "tier").agg(F.count(F.lit(1)).alias("_n"), F.min(candidate_id).alias(candidate_id))
    best = first_rows(counts, [row_id], ["tier"])
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("matched")
    return rows.select(row_id).join(best, row_id, "left").select(row_id, "tier", F.when(F.col("_n") == 1, F.col(candidate_id)).alias(candidate_id), status.alias("status"))


def distinct_on_first(rows: DataFrame, key: str, order: str, content: Sequence[str]) -> DataFrame:
    """Drops rows that equal the first row of their key; others stay, even if they repeat each other."""
    window = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_sig", F.xxhash64(*content)).withColumn("_first", F.first("_sig").over(window)).withColumn("_rn", F.row_number().over(window))
    return marked.where((F.col("_rn") == 1) | (F.col("_sig") != F.col("_first"))).drop("_sig", "_first", "_rn")


def union_last_wins(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """All rows by key; a later table's row replaces an earlier one's."""
    every = None
    for i, table in enumerate(tables):
        part = table.withColumn("_table", F.lit(i))
        every = part if every is None else every.unionByName(part)
    return first_rows(every, [key], [F.desc("_table")]).drop("_table")


def with_series(hits: DataFrame, items: DataFrame, item_id: str, series: str) -> DataFrame:
    """Hits, and the other items of their series: adds `added`."""
    wanted = hits.join(items.select(item_id, series), item_id).where(F.col(series).isNotNull()).select(series).distinct()
    more = items.join(wanted, series, "left_semi").join(hits.select(item_id), item_id, "left_anti").select(item_id, F.lit(True).alias("added"))
    return hits.select(item_id, F.lit(False).alias("added")).unionByName(more)


def set_report(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Adds only_left, only_right and common: sorted array differences."""
    return rows.select(
        "*",
        F.sort_array(F.array_except(left, right)).alias("only_left"),
        F.sort_array(F.array_except(right, left)).alias("only_right"),
        F.sort_array(F.array_intersect(left, right)).alias("common"),
    )


def similar_names(names: DataFrame, id_col: str, name_col: str, asked: str, n: int = 3, floor: float = 0.6) -> DataFrame:
    """The n names most like the asked one by matching-block ratio: id, name, score; ties by length, name and id."""

    def ratio(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = difflib.SequenceMatcher(autojunk=False)
        matcher.set_seq2(asked)
        for frame in frames:
            scores = []
            for name in frame[name_col]:
                matcher.set_seq1(name or "")
                good = matcher.real_quick_ratio() >= floor and matcher.quick_ratio() >= floor
                scores.append(round(matcher.ratio(), 6) if good else 0.0)
            yield frame.assign(score=scores)

    kinds = dict(names.dtypes)
    scored = names.select(id_col, name_col).mapInPandas(ratio, f"`{id_col}` {kinds[id_col]}, `{name_col}` {kinds[name_col]}, score double")
    return scored.where(F.col("score") >= floor).orderBy(F.desc("score"), F.length(name_col), name_col, id_col).limit(n)


def line_coverage(pairs: DataFrame, needle: str, haystack: str, least: float = 0.85, min_line: int = 4) -> DataFrame:
    """Adds covered (share of the needle's lines found in the haystack, exactly or by matching-block ratio) and missing (lines that are not)."""

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shares, missing = [], []
            for a, b in zip(frame[needle], frame[haystack], strict=True):
                lines = [x.strip() for x in (a or "").split("\n") if len(x.strip()) >= min_line]
                others = [x.strip() for x in (b or "").split("\n") if x.strip()]
                whole = "\n".join(others)
                lost = [x for x in lines if x not in whole and not any(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= least for y in others if abs(len(x) - len(y)) <= (1 - least) * (len(x) + len(y)))]
                shares.append(1 - len(lost) / len(lines) if lines else 0.0)
                missing.append(lost)
            yield frame.assign(covered=shares, missing=missing)

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in pairs.dtypes)
    return pairs.mapInPandas(judge, f"{kinds}, covered double, missing array<string>")


def fragments_covered(needle: Column, haystack: Column, samples: int = 20, size: int = 24, share: float = 0.5) -> Column:
    """Whether enough of up to `samples` evenly spaced fragments of the needle occur in a haystack that is not much shorter."""
    n, h = F.length(needle), F.length(haystack)
    step = F.greatest(F.lit(1), F.floor((n - size) / samples).cast("int"))
    starts = F.slice(F.sequence(F.lit(0), F.greatest(n - size - 1, F.lit(0)), step), 1, samples)
    hits = F.filter(starts, lambda s: haystack.contains(F.substring(needle, s + 1, F.lit(size))))
    return (
        F.when((n == 0) | (h == 0) | (h < n * 0.6), False)
        .when(n <= size, haystack.contains(needle))
        .otherwise(F.size(hits) >= share * F.size(starts))
    )
