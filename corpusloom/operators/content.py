"""Matching by content: which texts contain which, and tiers from equal blocks down to pages that cover most of a text.

No pair is compared that shares nothing. A text that contains another one has all tokens of its windows (`greedy.window_tokens`), so a
text asked for meets only those that hold its rarest token; one that has a token nobody holds is done. Equal texts are asked and searched
once. Candidates are confirmed by comparison.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.greedy import MIX, tokens_by_width
from corpusloom.session import kept

#: Characters that a text must have to be matched, and the windows by which longer ones are found.
LEAST, WINDOWS = 6, (6, 12, 24)
#: Tokens of a text that is asked for, of which the rarest counts. Wider windows would give fewer to choose from, each of them no rarer.
OWN = 24
#: The power of the bits of the sieve that tells off tokens nobody asks for (EACH bits a token, between these), and tokens that a task gathers.
SIEVE_BITS, MOST_BITS, EACH, GATHER = 20, 30, 32, 1_000_000
#: Pages that a task searches before it gives out what it found.
PAGES = 200
#: What is no letter, digit or ideograph (一-鿿); as a negated class it takes seven times as long.
OTHER = r"[\x00-/:-@\[-`{-\x{4DFF}\x{A000}-\x{10FFFF}]+"
TIERS = ("block_exact", "block_loose", "block_contains", "multi_blocks", "page_exact", "page_loose", "page_fragment")


def norm(text: Column) -> Column:
    """Letters, digits and ideographs outside of tags."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""), OTHER, "")


def loose(text: Column) -> Column:
    """As norm, without what stands in brackets."""
    return norm(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""), "[（(][^（）()]*[）)]", ""))


def _tokens(text: str, widths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """The tokens of a text's windows of each of these rising widths, mixed so that their first bits tell them apart; repeats next to each other once."""
    for width, found in tokens_by_width(text, widths):
        yield found[np.append(True, found[1:] != found[:-1])] * (np.uint64(2 * width + 1) * MIX)


def _own(texts: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """id, token: some tokens of each text (id, text) among those of the widest windows that fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], [np.zeros(0, np.uint64)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for own in _tokens(text, tuple(w for w in widths if w <= len(text))[-1:]):
                    found.append(np.unique(own)[:OWN])
                    keys += [key] * len(found[-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.concatenate(found).view(np.int64))], ["id", "token"])

    return texts.select("id", "text").mapInArrow(run, "id string, token long")


def _sieve(tokens: DataFrame) -> np.ndarray:
    """Bits, by eights, of which a token's first bits name one: it is set for each of the tokens, and for few others. Its size is bounded; where there
    are more tokens than it tells apart, more pass that nobody asks for, and do no harm."""
    bits = min(MOST_BITS, max(SIEVE_BITS, (EACH * tokens.count()).bit_length()))
    size = 1 << bits - 8  # bits of each of 256 parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, None
        for batch in batches:
            token, slices = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for a, b in zip(cuts := np.flatnonzero(np.append(True, slices[1:] != slices[:-1])), [*cuts[1:], len(slices)], strict=True):
                if now != slices[a]:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])
                    now, part = int(slices[a]), np.zeros(size, bool)
                part[(token[a:b] >> np.uint64(64 - bits)).astype(np.int64) & size - 1] = True
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    dealt = tokens.select("token", F.shiftrightunsigned("token", 56).alias("slice")).repartition("slice").sortWithinPartitions("slice")
    found = np.zeros((256, size // 8), np.uint8)
    for row in dealt.mapInArrow(run, "slice long, bits binary").toLocalIterator():
        found[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return found.ravel()


def _sifted(pages: DataFrame, tokens: DataFrame, widths: tuple[int, ...], count: bool) -> DataFrame:
    """The tokens of each page (row, texts) that pass the sieve of those asked for, all that are asked for and a few others: token and df, the pages
    that have it, summed up within a task; or row and token. The pages are read once, and nothing else leaves their tasks."""
    shared = pages.sparkSession.sparkContext.broadcast(_sieve(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        shift, low = np.uint64(64 - (8 * len(sieve)).bit_length() + 1), np.uint64(7)

        def passed(own: np.ndarray) -> np.ndarray:
            place = own >> shift
            return own[(sieve[place >> np.uint64(3)] >> (place & low).astype(np.uint8) & 1).astype(bool)]

        def put(rows: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            every = np.concatenate(found)
            if count:
                every, n = np.unique(every, return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(n)], ["token", "df"])
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(rows, np.int64), [len(x) for x in found])), pa.array(every.view(np.int64))], ["row", "token"])

        rows, found, size = [], [], 0
        for batch in batches:
            for row, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = [passed(own) for text in texts for own in _tokens(text, widths)]
                if not mine:
                    continue
                rows.append(row)
                found.append(np.unique(np.concatenate(mine)))
                size += len(found[-1])
                if size >= GATHER:
                    yield put(rows, found)
                    rows, found, size = [], [], 0
        if found:
            yield put(rows, found)

    return pages.select("row", "texts").mapInArrow(run, "token long, df long" if count else "row long, token long")


def _met(few: DataFrame, pages: DataFrame, least: int) -> DataFrame:
    """id, row: each text (id, text) with the pages (row, texts) that have the rarest of its tokens; all that contain it are among them."""
    shortest = few.agg(F.min(F.length("text"))).first()[0] or least
    every = sorted({least, *(w for w in WINDOWS if w > least)})
    widths = tuple(w for w, above in zip(every, (*every[1:], None), strict=True) if above is None or shortest < above)
    own = kept(_own(few, widths))
    common = _sifted(pages, own, widths, True).groupBy("token").agg(F.sum("df").alias("df"))
    rarest = own.join(common, "token", "left").groupBy("id").agg(F.min_by("token", F.struct("df", "token")).alias("token"), F.bool_or(F.col("df").isNull()).alias("alone"))
    chosen = kept(rarest.where("not alone").select("id", "token"))
    return chosen.join(_sifted(pages, chosen, widths, False), "token").select("id", "row")


def contained(asked: DataFrame, searched: DataFrame, least: int = LEAST) -> DataFrame:
    """asked, searched: digests of texts (column text) of which the second contains the first, at least `least` characters; no null."""
    few = kept(asked.where(F.length("text") >= least).select(F.md5("text").alias("id"), "text").distinct())
    many = kept(searched.where(F.length("text") >= least).select("text").distinct().withColumn("row", F.monotonically_increasing_id()))
    pairs = _met(few, many.select("row", F.array("text").alias("texts")), least)
    held = pairs.join(few.toDF("id", "small"), "id").join(many.select("row", F.col("text").alias("large")), "row")
    return kept(held.where(F.contains("large", "small")).select(F.col("id").alias("asked"), F.md5("large").alias("searched")))


def _sheet(pages: DataFrame, page_col: str, blocks_col: str) -> DataFrame:
    """row, page and the two forms of its blocks (bn, bl) and of its whole text (pn, pl); bl, pn and pl are null where they follow from those before."""
    blocks = F.coalesce(F.col(blocks_col), F.array().cast("array<string>"))
    rows = pages.select(F.col(page_col).alias("page"), blocks.alias("b"), F.array_join(blocks_col, "\n").alias("whole"))
    rows = rows.select("*", F.rlike("whole", F.lit("[<(（]")).alias("marked"))  # without tags and brackets both forms are one, and a page is its blocks
    found = rows.select("page", F.transform("b", norm).alias("bn"), *[F.when(F.col("marked"), x).alias(name) for name, x in (("bl", F.transform("b", loose)), ("pn", norm(F.col("whole"))), ("pl", loose(F.col("whole"))))])
    pn, pl = (F.when(F.col(p) != F.array_join(b, ""), F.col(p)).alias(p) for p, b in (("pn", "bn"), ("pl", "bl")))
    return kept(found.select("page", "bn", F.when(F.col("bl") != F.col("bn"), F.col("bl")).alias("bl"), pn, pl).withColumn("row", F.monotonically_increasing_id()))


def _forms(sheet: DataFrame) -> DataFrame:
    """A sheet with all forms in full; cut_n and cut_l say that a whole text is not its blocks one after the other."""
    full = sheet.withColumn("bl", F.coalesce("bl", "bn")).withColumn("cut_n", F.col("pn").isNotNull()).withColumn("cut_l", F.col("pl").isNotNull())
    return full.withColumn("pn", F.coalesce("pn", F.array_join("bn", ""))).withColumn("pl", F.coalesce("pl", F.array_join("bl", "")))


class _Places:
    """Lists of blocks and their sizes as one Arrow column."""

    def __init__(self):
        self.ends, self.blocks, self.sizes = [0], [], []

    def add(self, found: list[tuple[int, int]]) -> None:
        for block, size in found:
            self.blocks.append(block)
            self.sizes.append(size)
        self.ends.append(len(self.blocks))

    def arrow(self) -> pa.Array:
        rows = pa.StructArray.from_arrays([pa.array(self.blocks, pa.int32()), pa.array(self.sizes, pa.int32())], ["block", "size"])
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), rows)


def _finder(blocks: list[str]) -> Callable[[str], list[tuple[int, int]]]:
    """Which of the blocks contain a text, and their sizes; the blocks, which hold no NUL, are searched as one."""
    starts, text = list(accumulate((len(block) + 1 for block in blocks), initial=0)), "\0".join(blocks)

    def find(small: str) -> list[tuple[int, int]]:
        found, at = [], text.find(small)
        while at >= 0:
            block = bisect_right(starts, at) - 1
            found.append((block, starts[block + 1] - starts[block] - 1))
            at = text.find(small, starts[block + 1])
        return found

    return find


def _hits(few: DataFrame, sheet: DataFrame, least: int = LEAST) -> DataFrame:
    """id, page, in_bn, in_bl (block, size of those blocks that contain the text of this id), in_pn, in_pl (whether the whole does)."""
    full = _forms(sheet)
    # a block stands in its page, unless the page as a whole loses parts of it
    alone = [F.when(F.col(cut), F.filter(b, lambda x: F.length(x) >= least)).otherwise(F.array().cast("array<string>")) for cut, b in (("cut_n", "bn"), ("cut_l", "bl"))]
    pairs = _met(few, full.select("row", F.array_distinct(F.concat(F.array("pn", "pl"), *alone)).alias("texts")), least)
    held = pairs.join(few.toDF("id", "small"), "id").groupBy("row").agg(F.collect_list("id").alias("ids"), F.collect_list("small").alias("smalls"))
    both = held.join(sheet, "row").select("page", "ids", "smalls", "bn", "bl", "pn", "pl")  # a page moves once, to all that may stand in it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                some = batch.slice(start, PAGES)
                places, ids, whole, parts_n, parts_l = [], [], [], _Places(), _Places()
                for at, (names, smalls, bn, bl, pn, pl) in enumerate(zip(*(column.to_pylist() for column in some.columns[1:]), strict=True)):
                    in_n, joined_n = _finder(bn), "".join(bn)
                    in_l, joined_l = (in_n, joined_n) if bl is None else (_finder(bl), "".join(bl))
                    pn, pl = joined_n if pn is None else pn, joined_l if pl is None else pl
                    for name, small in zip(names, smalls, strict=True):
                        found_n = in_n(small)
                        found_l = found_n if bl is None else in_l(small)
                        in_pn = small in pn
                        in_pl = in_pn if pl is pn else small in pl
                        if found_n or found_l or in_pn or in_pl:
                            places.append(at)
                            ids.append(name)
                            whole.append((in_pn, in_pl))
                            parts_n.add(found_n)
                            parts_l.add(found_l)
                pages_ = some.column(0).take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pages_, parts_n.arrow(), parts_l.arrow(), *(pa.array([x[i] for x in whole], pa.bool_()) for i in (0, 1))], ["id", "page", "in_bn", "in_bl", "in_pn", "in_pl"])

    kind = "array<struct<block:int,size:int>>"
    return kept(both.mapInArrow(run, f"id string, page {dict(both.dtypes)['page']}, in_bn {kind}, in_bl {kind}, in_pn boolean, in_pl boolean"))


def _covered(pairs: DataFrame, share: float) -> DataFrame:
    """Those pairs (asked, page, small, large) whose common blocks make up at least `share` of the small text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for small, large in zip(batch.column("small").to_pylist(), batch.column("large").to_pylist(), strict=True):
                keep.append(sum(block.size for block in SequenceMatcher(None, small, large).get_matching_blocks()) >= share * len(small))
            yield batch.select(["asked", "page"]).filter(pa.array(keep, pa.bool_()))

    kinds = dict(pairs.dtypes)
    return pairs.select("asked", "page", "small", "large").mapInArrow(run, f"asked string, page {kinds['page']}")


def content_tiers(texts: DataFrame, id_col: str, text_col: str, pages: DataFrame, page_col: str, blocks_col: str, share: float | None = 0.85) -> DataFrame:
    """id, tier, page, blocks (indexes), status (matched, ambiguous, missing) of each text against pages of blocks.

    In this order: a block that equals the text, one that does without brackets, the shortest block that contains it, several blocks that contain
    its lines one each, a page that contains it, one that does without brackets, and one that holds an end or the middle of it and covers
    `share` (none: this tier is left out). The first tier that any page reaches decides; several pages in it are ambiguous.
    """
    own = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = own.select("text").distinct().select(F.md5("text").alias("asked"), norm(F.col("text")).alias("n"), loose(F.col("text")).alias("l"), F.split("text", "\n").alias("lines"))
    asked = kept(asked.where(F.length("n") >= LEAST))
    lines = kept(asked.select("asked", F.explode(F.array_distinct(F.transform("lines", norm))).alias("s")).where(F.length("s") >= LEAST))
    # lines that are equal count once, as they meet the same block
    size = F.length("n")
    middle = F.greatest(F.lit(0), F.floor(size / 2).cast("int") - 4)
    ends = F.array(F.substring("n", 1, 8), F.col("n").substr(middle + 1, F.lit(8)), F.col("n").substr(size - 7, F.lit(8)))
    pieces = asked.where(size >= 16).select("asked", F.explode(F.array_distinct(ends)).alias("s"))

    sheet = _sheet(pages, page_col, blocks_col)
    probes = asked.select(F.explode(F.array("n", "l")).alias("text")).union(lines.select("s"))
    probes = probes.union(pieces.select("s")) if share is not None else probes
    hits = _hits(kept(probes.where(F.length("text") >= LEAST).distinct().select(F.md5("text").alias("id"), "text")), sheet)

    def met(left: DataFrame, value: str, where: str) -> DataFrame:
        """Rows of left and the blocks or pages whose text in this form contains left's."""
        a = left.select("asked", F.md5(value).alias("id"), *([F.col("s")] if "s" in left.columns else []))
        there = hits.select("id", "page", F.inline(where)) if where in ("in_bn", "in_bl") else hits.where(where).select("id", "page")
        return a.join(there, "id").drop("id")

    in_norm = met(asked, "n", "in_bn").withColumn("strict", F.lit(True))
    in_loose = met(asked.where(F.length("l") >= LEAST), "l", "in_bl").withColumn("strict", F.lit(False))
    lengths = asked.select("asked", F.length("n").alias("_n"), F.length("l").alias("_l"))
    inside = in_norm.union(in_loose).groupBy("asked", "page", "block").agg(F.max_by("size", "strict").alias("size"), F.max(F.when(F.col("strict"), F.col("size"))).alias("n_size"), F.max(F.when(~F.col("strict"), F.col("size"))).alias("l_size"))
    inside = inside.join(lengths, "asked").withColumn("same", F.when(F.col("n_size") == F.col("_n"), 1).when(F.col("l_size") == F.col("_l"), 2))
    inside = kept(inside)

    per_page = inside.groupBy("asked", "page").agg(F.min(F.when(F.col("same").isNotNull(), F.struct("block", "same"))).alias("hit"), F.count(F.lit(1)).alias("n"), F.min_by("block", "block").alias("only"), F.min("size").alias("size"))
    flat = per_page.where("hit is not null").select("asked", "page", F.col("hit.same").alias("tier"), F.array("hit.block").alias("blocks"), F.lit(0).alias("size"))
    single = per_page.where("hit is null and n = 1").select("asked", "page", F.lit(3).alias("tier"), F.array("only").alias("blocks"), "size")
    decided = flat.union(single)

    wanted = lines.groupBy("asked").agg(F.count(F.lit(1)).alias("wanted"))
    several = asked.select("asked", F.size(F.filter(F.transform("lines", norm), lambda x: F.length(x) >= LEAST)).alias("given")).where("given >= 2").join(wanted, "asked")
    placed = met(lines, "s", "in_bn").groupBy("asked", "page", "s").agg(F.count(F.lit(1)).alias("n"), F.first("block").alias("block"), F.first("size").alias("size")).where("n = 1")
    order = asked.select("asked", F.transform("lines", norm).alias("norms"))
    cover = placed.groupBy("asked", "page").agg(F.count(F.lit(1)).alias("found"), F.collect_set(F.struct("s", "block", "size")).alias("at")).join(several, "asked").where("found = wanted").join(order, "asked")
    ranked = F.array_sort(F.transform("at", lambda x: F.struct(F.array_position("norms", x["s"]).alias("pos"), x["block"].alias("block"), x["size"].alias("size"))))
    cover = cover.withColumn("blocks", F.array_distinct(F.transform(ranked, lambda x: x["block"]))).withColumn("first", F.element_at(ranked, 1)["size"])
    cover = cover.join(decided.select("asked", "page"), ["asked", "page"], "left_anti")
    multi = cover.select("asked", "page", F.when(F.size("blocks") > 1, 4).otherwise(3).alias("tier"), "blocks", F.when(F.size("blocks") > 1, 0).otherwise(F.col("first")).alias("size"))

    none = F.array().cast("array<int>")
    strict_page = met(asked, "n", "in_pn").select("asked", "page")
    loose_page = met(asked.where(F.length("l") >= LEAST), "l", "in_pl").select("asked", "page").join(strict_page, ["asked", "page"], "left_anti")
    every = decided.union(multi)
    for tier, found in ((5, strict_page), (6, loose_page)):
        every = every.union(found.select("asked", "page", F.lit(tier), none, F.lit(0)))
    every = kept(every)
    if share is not None:
        open_ = asked.join(every.select("asked").distinct(), "asked", "left_anti").select("asked", F.col("n").alias("small"))
        near = met(pieces, "s", "in_pn").select("asked", "page").distinct().join(open_, "asked").join(_forms(sheet).select("page", F.col("pn").alias("large")), "page")
        every = every.union(_covered(near, share).select("asked", "page", F.lit(7), none, F.lit(0)))

    first = F.dense_rank().over(Window.partitionBy("asked").orderBy("tier", "size"))
    best = every.withColumn("_rank", first).where("_rank = 1").groupBy("asked").agg(F.first("tier").alias("tier"), F.count(F.lit(1)).alias("n"), F.first("page").alias("page"), F.first("blocks").alias("blocks"))
    one = F.col("n") == 1
    named = best.select("asked", F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier")).alias("tier"), F.when(one, F.col("page")).alias("page"), F.when(one, F.col("blocks")).alias("blocks"), F.when(one, "matched").otherwise("ambiguous").alias("status"))
    return own.select("id", F.md5("text").alias("asked")).join(named, "asked", "left").select("id", "tier", "page", "blocks", F.coalesce("status", F.lit("missing")).alias("status"))


def place_match(rows: DataFrame, id_col: str, place: str, region: str, titles: DataFrame, title_id: str, title: str, inner: str, title_region: str) -> DataFrame:
    """id, title_id, kind: the first title (by its id) whose region agrees, where both are known, and which has the place in its brackets
    (exact) or contains it (base), places of two characters at least. Distinct places meet titles through an index."""
    places = rows.where(F.length(place) >= 2).select(F.col(place).alias("text")).distinct()
    inside = contained(places, titles.select(F.col(title).alias("text")), least=2)
    named = titles.select(F.col(title_id).alias("_t"), F.md5(title).alias("_d"), F.col(inner).alias("_inner"), F.col(title_region).alias("_r"))
    loose_ = inside.join(named, F.col("searched") == F.col("_d")).select(F.col("asked").alias("_p"), "_t", "_r", F.lit("base").alias("kind"))
    exact = named.where("_inner is not null").select(F.md5("_inner").alias("_p"), "_t", "_r", F.lit("exact").alias("kind"))
    known = loose_.union(exact).groupBy("_p", "_t", "_r").agg(F.max("kind").alias("kind"))
    pairs = rows.select(id_col, F.md5(place).alias("_p"), F.col(region).alias("_region")).join(known, "_p")
    agree = F.coalesce(F.col("_region") == F.col("_r"), F.lit(True))
    first = pairs.where(agree).groupBy(id_col).agg(F.min(F.struct("_t", "kind")).alias("_best"))
    return rows.select(id_col).join(first, id_col, "left").select(id_col, F.col("_best._t").alias(title_id), F.col("_best.kind").alias("kind"))
