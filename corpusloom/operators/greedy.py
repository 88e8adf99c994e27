"""Greedy suppression over many tasks: in a given order a row stays unless a row that stays before it covers it.

A fold over a group would decide row after row in one task. Here rows that could cover each other meet in an inverted index, and a row is
decided as soon as all that could cover it are. A round looks at the first few rows of each token (`leaders`), so a token that a third
of all rows share makes few pairs a row and not all pairs of a group: its first rows decide most of the others. A row stays if its tokens
show all that come before it and none of these that stays covers it; it goes if one that stays does. What is left open meets four times
as many leaders in the next round, so the result is that of the fold, whatever the data. Rounds are written to the shared checkpoint
folder; only "is something open" comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.ranking import first_rows
from corpusloom.session import ensure_checkpoint_dir, kept

Cover = Callable[[DataFrame], DataFrame]

#: The most frequent elements of profiles, which come last.
FREQUENT = 4096
#: The power of the bits of a profile's signature: a bit is the parity of the elements that fall on it.
SIGN_BITS = 10


def first_that_stay(nodes: DataFrame, index: DataFrame, probes: DataFrame, cover: Cover, leaders: int = 32) -> DataFrame:
    """node: the rows that stay.

    nodes: node, place (unique and ordered), need (shared tokens without which nothing covers the row). index: token, node (tokens by which a
    row covers). probes: token, node, n (tokens by which a row is covered, how often; each is in the row's index too). cover: of candidate
    pairs (u before v) those where u covers v.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    state = nodes.select("node", "place", "need", F.lit(None).cast("boolean").alias("stays")).checkpoint()
    while True:
        there = state.where("stays is null or stays")
        top = first_rows(index.join(there.select("node", "place"), "node"), ["token"], ["place"], leaders)
        shown = top.groupBy("token").agg(F.collect_list(F.struct("place", "node")).alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("size")).checkpoint()
        open_ = state.where("stays is null").select("node", "place", "need")
        met = probes.join(open_, "node").join(shown, "token").select("node", "place", "need", "n", "first", "last", "size").checkpoint()
        hidden = met.where((F.col("size") == leaders) & (F.col("last") < F.col("place"))).select("node").distinct().withColumn("hidden", F.lit(True)).checkpoint()
        pairs = met.withColumn("u", F.explode("first")).where(F.col("u.place") < F.col("place"))
        pairs = pairs.groupBy(F.col("u.node").alias("u"), F.col("node").alias("v")).agg(F.sum("n").alias("n"), F.first("need").alias("need")).where("n >= need")
        edges = cover(pairs.select("u", "v").checkpoint()).select("u", "v").checkpoint()
        state = state.join(hidden, "node", "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))
        state = _settled(state, edges)
        if state.where("stays is null").isEmpty():
            return state.where("stays").select("node")
        leaders *= 4


def _settled(state: DataFrame, edges: DataFrame) -> DataFrame:
    """State after every row is decided that the edges decide."""
    state = state.checkpoint()
    while True:
        above = edges.join(state.select(F.col("node").alias("u"), "stays"), "u").groupBy(F.col("v").alias("node"))
        above = above.agg(F.coalesce(F.bool_or("stays"), F.lit(False)).alias("covered"), F.bool_or(F.col("stays").isNull()).alias("waits"))
        goes = F.coalesce("covered", F.lit(False))
        stays = ~F.coalesce("waits", F.lit(False)) & ~F.col("hidden")
        after = F.when(F.col("stays").isNotNull(), F.col("stays")).when(goes, False).when(stays, True)
        moved = state.join(above, "node", "left").select("node", "place", "need", "hidden", after.alias("after"), "stays").checkpoint()
        state = moved.select("node", "place", "need", "hidden", F.col("after").alias("stays"))
        if moved.where("stays is null and after is not null").isEmpty():
            return state.drop("hidden")


def _numbered(rows: DataFrame, size: Column, order: str) -> DataFrame:
    """Adds node, and place: longest first, then by order, then as numbered."""
    ensure_checkpoint_dir(rows.sparkSession)
    numbered = rows.withColumn("node", F.monotonically_increasing_id()).checkpoint()
    return numbered.withColumn("place", F.struct((-size).alias("size"), F.col(order).alias("order"), F.col("node").alias("node"))).checkpoint()


def _title_keys(heads: DataFrame, group: str, title: str) -> DataFrame:
    """group, title, _keys: hashes of the titles of the group (three characters at least) that stand in a title, itself too, where two rows or more
    have one. Rows of one family share the shorter title's key; a title without keys has no family."""
    titles = heads.where(F.length(title) >= 3).groupBy(group, title).agg(F.count(F.lit(1)).alias("_rows"))
    titles = kept(titles.withColumn("_g", F.xxhash64(group)).withColumn("_key", F.xxhash64(group, title)))
    sizes = [row[0] for row in titles.select(F.length(title)).distinct().collect()]  # the lengths that titles have
    most = max(sizes, default=0)

    def runs_of(length: int) -> Column:
        """All runs of so many characters of a longer title."""
        runs = F.transform(F.sequence(F.lit(1), F.length(title) - length + 1), lambda at: F.substring(F.col(title), at, F.lit(length)))
        return F.when(F.length(title) > length, runs).otherwise(F.array().cast("array<string>"))

    runs = [runs_of(length) for length in sizes if length < most]
    own = titles.select(group, title, "_key", "_rows")
    if runs:
        inner = titles.select(group, title, "_g", "_rows", F.explode(F.array_distinct(F.concat(*runs))).alias("_inner"))
        short = titles.where(F.length(title) < most).select(F.col("_g").alias("_h"), F.col(title).alias("_short"), "_key")
        own = own.unionByName(inner.join(short, (F.col("_g") == F.col("_h")) & (F.col("_inner") == F.col("_short"))).select(group, title, "_key", "_rows"))
    own = kept(own)
    shared = own.groupBy("_key").agg(F.sum("_rows").alias("_n")).where("_n > 1").select("_key")
    return kept(own.join(shared, "_key").groupBy(group, title).agg(F.collect_set("_key").alias("_keys")))


def without_variants(rows: DataFrame, group: str, id_col: str = "id", title: str = "title", size: str = "size", profile: str = "profile", jaccard: float = 0.7, min_ratio: float = 0.6) -> DataFrame:
    """Longest first, a row of a group goes if one that stays has a title of the same family (one within the other), a comparable size and
    a profile (an array) that is alike. Titles under three characters, empty bodies and empty profiles are never variants.

    Titles are looked at first: a row whose title has no family stays, and its profile goes nowhere. Of the others, alike profiles share one
    of their first elements in any one order: of k elements the first k - ceil(jaccard * k) + 1, frequent ones last, are the tokens. The order is
    by how many rows have an element for the `FREQUENT` most frequent and by hash for the rest, so no row is put together from its elements.
    """
    columns = rows.columns
    titles = _title_keys(rows.select(group, title), group, title)
    # rows stand in one place from here on, so that their numbers stay
    titles = titles.select(F.col(group).alias("_g"), F.col(title).alias("_t"), "_keys")
    nodes = kept(rows.join(titles, F.col(group).eqNullSafe(F.col("_g")) & (F.col(title) == F.col("_t")), "left").drop("_g", "_t").withColumn("node", F.monotonically_increasing_id()))
    family = nodes.where("_keys is not null").withColumn("_set", F.array_distinct(F.filter(profile, lambda x: x.isNotNull()))).where(F.size("_set") > 0)
    place = F.struct((-F.coalesce(size, F.lit(0))).alias("size"), F.col(id_col).alias("order"), F.col("node").alias("node"))
    codes_of = F.transform("_set", lambda x: F.xxhash64(x))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [codes.values.to_numpy() for codes in batch.column(5)]
            bits = [np.bincount(codes.view(np.uint64) >> np.uint64(64 - SIGN_BITS), minlength=1 << SIGN_BITS) % 2 for codes in own]
            signs = [pa.array(np.packbits(x.astype(np.uint8)).view(np.int64)) for x in bits]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([len(x) for x in own], pa.int32()), pa.array([x.tolist() for x in signs], pa.list_(pa.int64()))], [*batch.schema.names[:5], "k", "sign"])

    heads = family.select("node", place.alias("place"), F.col(group).alias("group"), F.col(title).alias("title"), F.col(size).alias("size"), codes_of.alias("codes"))
    small = kept(heads.mapInArrow(signed, StructType([*heads.schema.fields[:5], *StructType.fromDDL("k int, sign array<long>").fields])))
    coded = family.select("node", "_keys", codes_of.alias("codes"))
    often = coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "code").limit(FREQUENT).collect()
    codes, counts = (np.array([row[i] for row in often], np.int64) for i in (0, 1))
    counts = counts[np.argsort(codes)]
    codes = np.sort(codes)

    def first_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                keys, own = (batch.column(i)[at].values.to_numpy(zero_copy_only=False) for i in (1, 2))
                weight = np.zeros(len(own), np.int64)
                if len(codes):
                    found = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                    weight = np.where(codes[found] == own, counts[found], 0)
                first = own[np.lexsort((own, weight))][: len(own) - math.ceil(round(jaccard * len(own), 9)) + 1].view(np.uint64)
                tokens = np.unique((keys.view(np.uint64)[:, None] * MIX ^ first[None, :]) * MIX).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.full(len(tokens), batch.column(0)[at].as_py()))], ["token", "node"])

    tokens = kept(coded.mapInArrow(first_tokens, "token long, node long"))
    # a token of one row shows nobody to anybody
    tokens = kept(tokens.join(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("token"), "token"))
    able = small.where((F.length("title") >= 3) & (F.col("size") > 0)).select("node")
    sets = family.select("node", "_set")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(name if c == "node" else f"{name}_{c}") for c in df.columns])

    def cover(pairs: DataFrame) -> DataFrame:
        heads = small.drop("place")
        close = pairs.join(side(heads, "u"), "u").join(side(heads, "v"), "v")
        u, v = F.col("u_title"), F.col("v_title")
        near = F.contains(u, v) | ((F.length(u) >= 3) & F.contains(v, u))
        ratio = F.least("u_size", "v_size") / F.greatest("u_size", "v_size")
        # no more elements differ than alike profiles allow: by their numbers, and by the bits that differ, which are never more
        both = F.col("u_k") + F.col("v_k")
        differ = F.aggregate(F.zip_with("u_sign", "v_sign", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        most = both * (1 - jaccard) / (1 + jaccard) + 1e-6
        near = near & (F.abs(F.col("u_k") - F.col("v_k")) <= most) & (differ <= most)
        close = close.where(F.col("u_group").eqNullSafe(F.col("v_group")) & near & (ratio >= min_ratio)).select("u", "v").join(side(sets, "u"), "u").join(side(sets, "v"), "v")
        return close.where(F.size(F.array_intersect("u__set", "v__set")) / F.size(F.array_union("u__set", "v__set")) >= jaccard)

    open_ = small.join(tokens.select("node").distinct(), "node", "left_semi").select("node", "place", F.lit(1).alias("need"))
    stay = first_that_stay(open_, tokens, tokens.join(able, "node").select("token", "node", F.lit(1).alias("n")), cover)
    gone = open_.select("node").join(stay, "node", "left_anti")
    return nodes.join(gone, "node", "left_anti").select(*columns)


#: Characters of the grams that choose a fragment's token.
GRAM = 8
MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens_by_width(text: str, fragments: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each of the rising fragments that fits and the tokens of its windows (window_tokens), neighbours that are equal too."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gram = have = 0
    for fragment in fragments:
        if len(points) < fragment:
            return
        if gram != min(GRAM, fragment):
            gram, have = min(GRAM, fragment), 1
            n = len(points) - gram + 1
            marks = np.zeros(n, np.uint64)
            for at in range(gram):
                marks = marks * MIX + points[at : at + n]
            marks ^= marks >> np.uint64(29)
            marks *= MIX
            marks ^= marks >> np.uint64(32)
        spread = fragment - gram + 1
        while 2 * have <= spread:
            marks, have = np.minimum(marks[:-have], marks[have:]), 2 * have
        yield fragment, marks if have == spread else np.minimum(marks[: -(spread - have)], marks[spread - have :])


def window_tokens(text: str, fragment: int) -> np.ndarray:
    """For each run of `fragment` characters the least hash of its grams: equal runs have equal ones, and neighbours mostly share theirs."""
    return next((found for _, found in tokens_by_width(text, (fragment,))), np.zeros(0, np.uint64))


def cover_text(text: str) -> Column:
    """A text without templates, marks and blanks, as coverage compares it."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\{\{[^{}]*\}\}", " "), r"[^\p{L}\p{N}_]+", "")


def without_covered(rows: DataFrame, group: str, id_col: str, text: str, ratio: float = 1.2, fragment: int = 24, share: float = 0.5, least: int = 4) -> DataFrame:
    """Longest first, a text of a group goes if at least `share` of its fragments stand in a text that stays and is `ratio` times longer.

    Fragments follow each other, `fragment` characters each; texts of fewer than `least` are never covered.
    Whole texts are compared, without templates, marks and blanks.
    """
    columns = rows.columns
    cleaned = rows.withColumn("_body", cover_text(text))
    nodes = _numbered(cleaned, F.length("_body"), id_col)
    n_pieces = F.floor((F.length("_body") - fragment - 1) / fragment) + 1
    able = F.length("_body") > F.greatest(F.lit(fragment), F.lit(least * fragment - 1))
    nodes = nodes.withColumn("need", F.when(able, F.ceil(F.round(share * n_pieces, 9)))).checkpoint()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, body, able in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = window_tokens(body, fragment)
                own, counts = np.unique(found[: len(body) - fragment : fragment], return_counts=True)
                every = np.unique(found)
                n = np.zeros(len(every), np.int64)
                if able:
                    n[np.searchsorted(every, own)] = counts
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(every), node)), pa.array(every.view(np.int64)), pa.array(n)], ["node", "mark", "n"])

    marks = nodes.select("node", "_body", F.col("need").isNotNull().alias("able")).mapInArrow(tokens, "node long, mark long, n long")
    marks = marks.join(nodes.select("node", F.xxhash64(group).alias("g")), "node").select("node", F.xxhash64("g", "mark").alias("token"), "n").checkpoint()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for u, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                pieces = [v[at : at + fragment] for at in range(0, len(v) - fragment, fragment)]
                good.append(sum(piece in u for piece in pieces) >= share * len(pieces))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def cover(pairs: DataFrame) -> DataFrame:
        sizes = nodes.select("node", F.length("_body").alias("size"))
        long = pairs.join(sizes.toDF("u", "u_size"), "u").join(sizes.toDF("v", "v_size"), "v").where(F.col("u_size") >= ratio * F.col("v_size")).select("u", "v")
        bodies = nodes.select("node", "_body")
        return long.join(bodies.toDF("u", "u_body"), "u").join(bodies.toDF("v", "v_body"), "v").select("u", "v", "u_body", "v_body").mapInArrow(judge, "u long, v long")

    stay = first_that_stay(nodes.select("node", "place", "need"), marks.select("token", "node"), marks.where("n > 0"), cover)
    return nodes.join(stay, "node").select(*columns)
