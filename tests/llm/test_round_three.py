"""The archive, centroid clustering and importance resampling against brute force and their SQL."""

from __future__ import annotations

import gzip
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import archive, clustering, resampling
from corpusloom.llm.common import ALNUM_WORD, doc_bytes, documents, scratch_folder
from tests.compare import oracle, spark_rows
from tests.llm.conftest import CLASHING


def clashing(df, *taken):
    return df.select("*", *[F.lit(name).alias(name) for name in (*CLASHING, "header", "digest", "owner", "cluster", "distance", "codes", "word", "chunk", "tuple", "n") if name not in taken])


@pytest.fixture(scope="module")
def pages(spark):
    big, edge = "<p>" + "long é " * 400, "x" * 1000
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, "http://b/\r\nX: 1", big), (2, None, edge), (4, "u", edge), (5, "u", "y" * 999), (6, "u", "y" * 999), (8, "u", None), (9, "u", ""), (None, "n", big), (None, "n", "only null" * 200), (None, "n", "only null" * 200), (7, "http://a/7", big), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (11, "u", "🙂" * 250)]
    return clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))


def test_archive_by_brute_force(spark, pages):
    rows = [(r.page_id, doc_bytes(r.html)) for r in pages.collect()]
    groups = {}
    for page, payload in rows:
        groups.setdefault(payload, []).append(page)
    want = []
    for page, payload in rows:
        known = [x for x in groups[payload] if x is not None]
        top = max(known) if known else None
        again = len(payload) >= 1000 and page != top
        want.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", top if again else None))
    got = archive.archive_report(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(x[3] == "revisit" for x in want) == 4


def test_archive_stores_once_and_restores_exactly(spark, pages):
    archive.write_archive(pages, folder := scratch_folder(spark, "archive"))
    stored = spark.read.parquet(f"{folder}/payloads")
    assert stored.count() == len({doc_bytes(r.html) for r in pages.collect()})
    whole = b"".join(bytes(r.record) for r in archive.restore(spark, folder).select(archive.record_bytes().alias("record")).collect())
    found = list(archive.split_records(whole))
    assert len(found) == pages.count()
    for header, payload in found:
        if payload is not None:
            assert f"sha1:{hashlib.sha1(payload).hexdigest()}".encode() in header
    assert b"%0D%0AX: 1" in whole and b"\r\nX: 1" not in whole


def test_archive_finds_changed_payloads(spark, pages):
    import zstandard

    archive.write_archive(pages, folder := scratch_folder(spark, "archive"))
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("frame", F.lit(zstandard.compress(b"something else")))
    bad.write.parquet(other := scratch_folder(spark, "archive") + "/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(other.removesuffix("payloads") + "headers")
    with pytest.raises(Exception, match="is not what its digest"):
        archive.restore(spark, other.removesuffix("/payloads")).collect()


def test_import_of_warc_files(spark, tmp_path):
    def record(kind, more, block):
        return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x:1>\r\n" + more + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"Content-Type: application/http; msgtype=response\r\n"
    records = [
        record(b"warcinfo", b"Content-Type: application/warc-fields\r\n", b"software: x\r\n"),
        record(b"response", http, b"HTTP/1.0 200 OK\r\nA: \xff\r\n\r\n<p>one</p>"),
        record(b"response", http, b"HTTP/1.1 404 Not Found\r\n\r\n<p>one</p>"),
        record(b"revisit", http, b"HTTP/1.0 200 OK\r\n\r\n"),
        record(b"response", http, b"HTTP/1.0 204 No Content\r\n\r\n"),
        record(b"resource", b"Content-Type: text/plain\r\n", b"WARC/1.0\r\n\r\n not a header"),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes(b"".join(records[:3]))
    (tmp_path / "in/b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in records[3:]))
    archive.import_warc(spark, str(tmp_path / "in"), folder := scratch_folder(spark, "imported"))
    got = [bytes(r.record) for r in archive.restore(spark, folder).select(archive.record_bytes().alias("record")).collect()]
    assert sorted(got) == sorted(records)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    with pytest.raises(ValueError, match="no record at byte"):
        list(archive.split_records(records[0] + b"rubbish"))


def test_empty_archive(pages):
    assert archive.archive_report(pages.where("false")).collect() == []


def vectors_of(rows):
    return [[math.floor(256 * x) for x in v] for _, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]


def test_clusters_by_brute_force(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(9, 64))
    rows = [(i, (middles[i % 9] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 420)] + [rows[0], rows[0], (None, rows[1][1]), (420, [0.0] * 64), (421, [-0.001] * 64)]
    bad = [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 63 + [None]), (504, [1.0] * 63 + [math.nan]), (505, [math.inf] + [1.0] * 63), (506, [0.5] * 65)]
    table = clashing(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(4))
    kept = [(i, np.array(v, np.int64)) for (i, _), v in zip(rows, vectors_of(rows), strict=True)]
    order = sorted(kept, key=lambda x: (hashlib.sha256(f"2:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1].tolist()))
    centroids = [v for _, v in order[:40]]

    def near(v):
        return min((int(((v - c) ** 2).sum()), at) for at, c in enumerate(centroids))

    for _ in range(5):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [np.array([int(x) // len(groups[at]) for x in sum(groups[at])]) if at in groups else c for at, c in enumerate(centroids)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, at, d in last:
        inertia[at] += d
    want = [(i, at, d, inertia[at], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[at].tolist())).encode()).hexdigest()) for i, at, d in last]
    got = clustering.cluster_report(table)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("spread", [1, 60, 100_000])
def test_bounds_never_exceed_distances(spread):
    rng = np.random.default_rng(spread)
    centroids = rng.integers(-spread, spread + 1, (17, 61))
    vectors = np.vstack([rng.integers(-spread, spread + 1, (200, 61)), centroids, centroids + 1, np.zeros((1, 61), np.int64)])
    form = clustering.compressed(vectors)
    true = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
    assert (clustering.lower_bounds(form, centroids) <= true).all()
    cluster, distance, compared = clustering.nearest(vectors, form, centroids)
    assert (cluster == true.argmin(1)).all() and (distance == true.min(1)).all()
    assert compared <= true.size


def test_screening_leaves_out_most_distances(spark, sf):
    stored = clustering.store(spark.read.parquet(f"{sf}/embeddings.parquet"))
    vectors = np.array([np.frombuffer(r.components, "<i4") for r in stored.collect()], np.int64)
    compared = clustering.nearest(vectors, clustering.compressed(vectors), clustering.fit(stored))[2]
    assert compared < 0.25 * len(vectors) * 40


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.distance) for r in clustering.cluster_report(table).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert clustering.cluster_report(table.where("false")).collect() == []
    with pytest.raises(Exception, match="beyond"):
        clustering.store(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


def resampled_by_hand(docs, target, max_n, percent=10, least=20, buckets=10_000):
    def features(text):
        words = ALNUM_WORD.findall(doc_bytes(text).lower())
        return len(words), [b" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    bucket = lambda x: zlib.crc32(x) % buckets
    held = [(r.doc_id, *features(r.text)) for r in docs]
    s, t = Counter(bucket(x) for _, _, f in held for x in f), Counter(bucket(x) for r in target for x in features(r.text)[1])
    raw, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (raw + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in s}
    rows = []
    for doc, words, f in held:
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        rows.append((doc, words, len(f), weight, weight + resampling.noise("2024", doc)))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    left = Counter(rows) - Counter(drawn)
    return [(r[0], *r[2:], at + 1) for at, r in enumerate(drawn)] + [(r[0], *r[2:], None) for r in left.elements()]


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling_by_brute_force(spark, sf, awkward, max_n, monkeypatch):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    target = clashing(target.union(spark.createDataFrame([(None, None), (99, "")], target.schema)))
    found = resampling.resampled(awkward, target, percent=50, max_n=max_n)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(resampled_by_hand(awkward.collect(), target.collect(), max_n, 50), key=repr)


def test_tuples_of_small_chunks():
    codes, counts = np.array([0, 1, 0, 1, 2, 0, 1, 2]), np.array([4, 0, 4])
    found = Counter()
    for tuples, ends, docs, n in resampling.tuples_of(codes, counts, 2):
        for row, a, b in zip(tuples.tolist(), np.append(0, ends[:-1]), ends, strict=True):
            for doc, times in zip(docs[a:b], n[a:b], strict=True):
                found[tuple(row), int(doc)] += int(times)
    want = Counter()
    for doc, words in ((0, [0, 1, 0, 1]), (2, [2, 0, 1, 2])):
        for length in (1, 2):
            want.update((tuple(words[i : i + length]), doc) for i in range(len(words) - length + 1))
    assert found == want


def test_resampling_without_rows_or_target(spark, sf, nothing):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert resampling.resampled(nothing, target).collect() == []
    docs = documents(spark, sf)
    got = resampling.resampled(docs, target.where("false")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(resampled_by_hand(docs.collect(), [], 1), key=repr)


def test_ranks_over_many_tasks(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("score"), "id")
    got = resampling.ranked(rows, [F.desc("score"), F.asc("id")], 5).collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [r.id for r in sorted(got, key=lambda r: (-r.score, r.id))]
    assert sorted(r["rank"] for r in got) == list(range(1, 1001))


@pytest.mark.parametrize("name", ["op11_archive", "op12_clusters", "op13_resampling"])
def test_registered(spark, sf, name):
    from corpusloom.llm import registry

    assert spark_rows(registry.queries()[name](spark, sf)) == oracle(registry.oracle_sql()[name], sf)
