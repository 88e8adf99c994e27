"""Near-duplicate detection by b-bit MinHash.

A document is its set of distinct word shingles, as 64-bit hashes. 128 minima (multiply-shift permutations) make a signature;
bands of four minima give bucket keys; of every minimum only the lowest four bits are kept, packed into eight longs. Two
documents that meet in a bucket are compared by counting equal nibbles: with k minima and b bits, the share of equal ones is
J + (1 - J) / 2^b, which is solved for J. Pairs whose estimate is within five standard errors of the threshold, or above it,
are confirmed on their full sets.

Copies first collapse into one node per distinct set (by 128 bits of its hash), so thousands of equal documents cost one. In a bucket every node is
paired with the one that meets most others in all its buckets (the star, close to the original of a group of near copies); the
verified links give first components. Only buckets that still hold several components are then searched for pairs across
components, in blocks of bounded size: the packed estimate first, then the sets folded to bitmaps of 2^16 bits. Of the pairs
that are clearly similar one for each two components goes on, near the threshold all do, and full sets decide; where the one
that went on fails, all candidates of its two components are tried after it, so that no estimate settles anything. No pair within
a component is emitted beyond the star and no bucket is capped. With 32 bands of four, a pair at 0.8 misses all buckets with a
probability of 5e-8.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A text of fewer words than a shingle is one shingle; without words it
is empty and linked with nothing. Null text is empty. Rows that repeat an id and a text are one document. A null id is smaller
than no other: a component's id is its smallest id that is there, and a group without one has none. Very long texts are one set
like any other; an empty table gives no rows. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import coded, doc_bytes, keyed, row_keys, windows_hashed
from corpusloom.llm.graph import connected_components
from corpusloom.session import ensure_checkpoint_dir

ROWS, BANDS, BITS = 4, 32, 4
MINIMA = ROWS * BANDS
#: Standard errors below the threshold at which an estimate still counts as a candidate.
MARGIN = 5
#: Members of a bucket that one task compares with each other.
BLOCK = 512
#: The largest set that is folded to sixteen bits a hash, and what a comparison of such sets may be off by.
FOLDED, SLACK = 4000, 0.01
STEP = 1 << 15


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    return random.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


FACTORS, SHIFTS = _permutations()


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    codes, counts = coded([doc_bytes(text).lower() for text in texts])
    hashes, starts = windows_hashed(codes, counts, words)
    ends = np.cumsum(counts)
    cuts = np.searchsorted(starts, ends)
    sets = [np.unique(hashes[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
    for i in np.flatnonzero((counts > 0) & (counts < words)):  # the whole sequence is one shingle
        whole, _ = windows_hashed(codes[ends[i] - counts[i] : ends[i]], counts[i : i + 1], int(counts[i]))
        sets[i] = whole + np.uint64(counts[i])
    return sets


def minima_of(hashes: np.ndarray) -> np.ndarray:
    """The signature: the smallest 32-bit value of each permutation."""
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), STEP):
        part = hashes[at : at + STEP]
        for k in range(MINIMA):
            low = ((part * FACTORS[k] + SHIFTS[k]) >> np.uint64(32)).min()
            if low < best[k]:
                best[k] = low
    return best


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each set; short sets share the passes."""
    out = np.full((len(sets), MINIMA), 0xFFFFFFFF, np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(some):
        group, size = [], 0
        while at < len(some) and (not group or size + len(sets[some[at]]) <= STEP):
            group.append(some[at])
            size += len(sets[some[at]])
            at += 1
        if len(group) == 1 and size > STEP:
            out[group[0]] = minima_of(sets[group[0]])
            continue
        every = np.concatenate([sets[i] for i in group])
        starts = np.cumsum([0, *(len(sets[i]) for i in group[:-1])])
        for k in range(MINIMA):
            out[group, k] = np.minimum.reduceat((every * FACTORS[k] + SHIFTS[k]) >> np.uint64(32), starts).astype(np.uint32)
    return out


def bands_of(minima: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band."""
    parts = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(minima), 1))
    for r in range(ROWS):
        keys = (keys ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def packed_of(minima: np.ndarray) -> np.ndarray:
    """The lowest bits of all minima, sixteen to a long."""
    low = (minima & np.uint32(15)).astype(np.uint64).reshape(len(minima), -1, 16)
    return np.bitwise_or.reduce(low << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def floor_estimate(similarity: float) -> float:
    """The least estimate that still makes a candidate."""
    share = similarity + (1 - similarity) / 2**BITS
    return similarity - MARGIN * math.sqrt(share * (1 - share) / MINIMA) / (1 - 2.0**-BITS)


def _identity(hashes: np.ndarray) -> tuple[int | None, int | None]:
    """Two signed longs with 128 bits of a set's hash; nulls for the empty set."""
    if not len(hashes):
        return None, None
    whole = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (whole >> 64) - (1 << 63), (whole & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _sign(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, doc_key, doc_check, n_shingles, set_high and set_low (128 bits of the set; null if empty), bands, packed."""
    names = ["n_shingles", "set_high", "set_low", "bands", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = shingle_sets(part.column(3).to_pylist(), words)
                minima = signatures(sets)
                high, low = (pa.array(x, pa.int64()) for x in zip(*map(_identity, sets), strict=True))
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))
                    for rows in (bands_of(minima), packed_of(minima))
                ]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], sizes, high, low, *lists], ["doc_id", "doc_key", "doc_check", *names])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, doc_key long, doc_check long, n_shingles long, set_high long, set_low long, bands array<long>, packed array<long>"
    return docs.select("doc_id", "doc_key", "doc_check", "text").mapInArrow(run, schema)


def estimate(left: str, right: str) -> Column:
    """Collision-corrected similarity of two packed signatures, by counting bits."""

    def unequal(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        return F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))

    n = F.aggregate(F.zip_with(left, right, unequal), F.lit(0), lambda total, x: total + x)
    return ((MINIMA - n) / F.lit(float(MINIMA)) - 2.0**-BITS) / (1 - 2.0**-BITS)


def _full_sets(docs: DataFrame, nodes: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """node, hashes (the set as packed 64-bit values) of the needed nodes; the texts of one document of each are shuffled once."""
    keys = needed.join(nodes.select("node", "set_high", "set_low", "of.doc_key", "of.doc_check"), "node")
    texts = docs.join(keys, ["doc_key", "doc_check"]).dropDuplicates(["doc_key", "doc_check"]).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [hashes.tobytes() for hashes in shingle_sets(part.column(1).to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["node", "hashes"])

    return texts.mapInArrow(sets, "node long, hashes binary")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    both = both.join(full.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b").select("a", "b", "ha", "hb")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(value.as_buffer(), np.uint64) for value in (left, right))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(confirm, "a long, b long")


def _with_folds(full: DataFrame) -> DataFrame:
    """node, fold: the set's hashes folded to sixteen bits, distinct and packed; empty for a set of more than FOLDED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = []
            for value in batch.column(1):
                hashes = np.frombuffer(value.as_buffer(), np.uint64)
                folds.append(np.unique((hashes >> np.uint64(40)).astype(np.uint16)).tobytes() if len(hashes) <= FOLDED else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folds, pa.binary())], ["node", "fold"])

    return full.mapInArrow(run, "node long, fold binary")


def _worth_trying(i: np.ndarray, j: np.ndarray, label: np.ndarray, folds: list[bytes], least: float, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (i, j) to confirm on full sets, and which of these stand for others of their two components.

    Folded sets, as bitmaps, tell the similarity to about 0.005. What is clearly below `least` goes. Of the pairs clearly above
    it only the best one for each pair of components stays, and the pairs near the threshold stay where there is no such pair, as
    do all of sets too large to fold; with `every`, all stay that are not clearly below.
    """
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    bits = np.zeros((len(used), 1 << 10), np.uint64)
    for row, member in enumerate(used):
        plain = np.zeros(1 << 16, bool)
        plain[np.frombuffer(folds[member], np.uint16)] = True
        bits[row] = np.packbits(plain).view(np.uint64)
    size = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    left, right = at[: len(i)], at[len(i) :]
    common = np.empty(len(i), np.int64)
    for start in range(0, len(i), 2048):
        part = slice(start, start + 2048)
        common[part] = np.bitwise_count(bits[left[part]] & bits[right[part]]).sum(axis=1, dtype=np.int64)
    known = (size[left] > 0) & (size[right] > 0)
    near = common / np.maximum(size[left] + size[right] - common, 1)
    keep = ~known | ((near >= least - SLACK) & (near < least + SLACK))
    stands = np.zeros(len(i), bool)
    sure = np.flatnonzero(known & (near >= least + SLACK))
    if every:
        keep[sure] = True
    elif len(sure):
        ends = np.sort(np.stack([label[i[sure]], label[j[sure]]], axis=1), axis=1)
        order = np.lexsort((-near[sure], ends[:, 1], ends[:, 0]))
        ends = ends[order]
        first = np.ones(len(order), bool)
        first[1:] = (ends[1:] != ends[:-1]).any(axis=1)
        settled = ends[first]
        keep[sure[order[first]]] = stands[sure[order[first]]] = True
        done = set(map(tuple, settled.tolist()))
        for k in np.flatnonzero(known & (near >= least - SLACK) & (near < least + SLACK)):
            keep[k] = tuple(sorted((label[i[k]], label[j[k]]))) not in done
    return keep, stands


def _across(members: DataFrame, floor: float, least: float, every: bool = False) -> DataFrame:
    """Distinct pairs (a, b), a < b, of different components that share a bucket, pass the estimate and are worth a confirmation; x and y
    are the components of a pair that stands for others, else null.

    members: band, node, label, packed, fold of buckets with several components. A bucket larger than BLOCK is cut into blocks,
    and a member goes to each pair of blocks that its own takes part in.
    """
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    sized = members.join(sizes, "band").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = sized.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = own.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("own", "mate").alias("lo"), F.greatest("own", "mate").alias("hi"), "own", "node", "label", "packed", "fold")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(parts, "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")

    def compare(rows: list[np.ndarray], folds: list[bytes]) -> Iterator[list[np.ndarray]]:
        own, lo, hi, node, label, packed = rows
        first = np.flatnonzero(own == lo[0])
        second = first if lo[0] == hi[0] else np.flatnonzero(own == hi[0])
        for at in range(0, len(first), 256):
            left = first[at : at + 256]
            bits = packed[left][:, None, :] ^ packed[second][None, :, :]
            bits |= bits >> np.uint64(1)
            bits |= bits >> np.uint64(2)
            n = np.bitwise_count(bits & np.uint64(0x1111111111111111)).sum(axis=2, dtype=np.int64)
            close = ((MINIMA - n) / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS) >= floor
            close &= label[left][:, None] != label[second][None, :]
            if lo[0] == hi[0]:
                close &= left[:, None] < second[None, :]
            i, j = np.nonzero(close)
            if len(i):
                i, j = left[i], second[j]
                keep, stands = _worth_trying(i, j, label, folds, least, every)
                i, j = i[keep], j[keep]
                yield [f(of[i], of[j]) for of in (node, label) for f in (np.minimum, np.maximum)] + [stands[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        folds: list[bytes] = []
        key = None

        def flush():
            rows = [np.concatenate([part[i] for part in held]) for i in range(6)] if held else [()]
            if len(rows[0]) > 1:
                for a, b, x, y, stands in compare(rows, folds):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(x, mask=~stands), pa.array(y, mask=~stands)], ["a", "b", "x", "y"])

        for batch in batches:
            band, lo, hi, own, node, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            packed = batch.column(6).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
            sets = batch.column(7).to_pylist()
            cut = np.flatnonzero((band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for start, end in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if start == end:
                    continue
                this = (band[start], lo[start], hi[start])
                if this != key:
                    yield from flush()
                    held, folds, key = [], [], this
                held.append(tuple(column[start:end] for column in (own, lo, hi, node, label, packed)))
                folds += sets[start:end]
        yield from flush()

    return grouped.mapInArrow(run, "a long, b long, x long, y long").groupBy("a", "b").agg(F.max("x").alias("x"), F.max("y").alias("y"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, doc_key, doc_check, n_shingles, node (its set), component_id (smallest doc_id reachable), kept."""
    ensure_checkpoint_dir(docs.sparkSession)
    docs = keyed(docs, id_col, text_col)
    floor = floor_estimate(percent / 100)
    signed = _sign(docs, words).checkpoint()
    nodes = (
        signed.where("set_high is not null")
        .groupBy("set_high", "set_low")
        .agg(F.min("doc_id").alias("smallest"), F.min(F.struct("doc_key", "doc_check")).alias("of"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
        .withColumn("node", F.monotonically_increasing_id())  # unique, and fixed by what is written
        .checkpoint()
    )
    rows = nodes.select("node", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").checkpoint()  # written, as is each small table below, so that Spark can split a hot bucket's join
    shared = rows.join(buckets, "band").checkpoint()
    met = shared.groupBy("node").agg(F.sum("n").alias("met")).checkpoint()
    full = _full_sets(docs, nodes, met.select("node"), words).checkpoint()
    packed = nodes.select("node", "packed")

    known = shared.join(met, "node")
    stars = known.groupBy("band").agg(F.max(F.struct("met", "node")).alias("_s")).select("band", F.col("_s.node").alias("star")).checkpoint()
    star = shared.join(stars, "band").where("node <> star").select(F.least("star", "node").alias("a"), F.greatest("star", "node").alias("b")).distinct()
    star = star.join(packed.toDF("a", "pa"), "a").join(packed.toDF("b", "pb"), "b").where(estimate("pa", "pb") >= floor).select("a", "b").checkpoint()
    labels = connected_components(_verified(star, full, percent))

    labelled = shared.select("band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band").checkpoint()
    members = labelled.join(mixed, "band")
    folds = _with_folds(full.join(members.select("node").distinct(), "node").select("node", "hashes"))
    members = members.join(packed, "node").join(folds, "node").select("band", "node", "label", "packed", "fold").checkpoint()
    tried = _across(members, floor, percent / 100).checkpoint()
    links = _verified(tried.join(star, ["a", "b"], "left_anti").select("a", "b"), full, percent).checkpoint()
    failed = failed_components(tried, links)
    if failed.limit(1).count():
        again = _again(members, failed, floor, percent / 100).join(tried, ["a", "b"], "left_anti").join(star, ["a", "b"], "left_anti")
        links = links.union(_verified(again, full, percent)).checkpoint()
    if links.limit(1).count():
        of = links.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        above = connected_components(of).toDF("label", "above")
        every = labels.union(of.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))).distinct()
        labels = every.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label")).checkpoint()

    roots = nodes.select("node", "smallest").join(labels, "node").groupBy("label").agg(F.min("smallest").alias("component_id"))
    placed = labels.join(roots, "label").select("node", "component_id")
    found = nodes.join(placed, "node", "left").select("set_high", "set_low", "node", F.coalesce("component_id", "smallest").alias("component_id"))
    joined = signed.drop("bands", "packed").join(found, ["set_high", "set_low"], "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "doc_key", "doc_check", "n_shingles", "node", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def failed_components(tried: DataFrame, links: DataFrame) -> DataFrame:
    """x, y: components whose standing pair is no link. A star's pair between two components counts too: had it been a link, they would be one."""
    return tried.where("x is not null").join(links, ["a", "b"], "left_anti").select("x", "y").distinct().checkpoint()


def _again(members: DataFrame, failed: DataFrame, floor: float, least: float) -> DataFrame:
    """All candidates of the pairs of components whose standing pair was no link."""
    concerned = failed.select(F.explode(F.array("x", "y")).alias("label")).distinct()
    every = _across(members.join(concerned, "label").select("band", "node", "label", "packed", "fold"), floor, least, every=True).select("a", "b")
    of = members.select("node", "label").distinct()
    sided = every.join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b").withColumns({"x": F.least("la", "lb"), "y": F.greatest("la", "lb")})
    return sided.join(failed, ["x", "y"], "left_semi").select("a", "b")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns: that of the smallest doc_id, once even if its row is repeated. Documents without a word all stay."""
    keys = near_duplicates(docs, words, percent).where("kept").select(F.col("doc_key").alias("_key"), F.col("doc_check").alias("_check")).distinct()
    everything = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row")
    key, check = row_keys()
    rows = docs.select(everything, key.alias("_key"), check.alias("_check"))
    return rows.join(keys, ["_key", "_check"]).dropDuplicates(["_key", "_check"]).select("_row.*")
