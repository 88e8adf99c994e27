"""Centroid clustering of integer vectors with block-norm screening.

A vector is kept if it has exactly `dims` components, none null or not finite; component x becomes the integer floor(scale * x). Each is
written once to the shared folder together with its compressed form: codes of `CODE_BITS` bits with one step a vector, its squared norm,
and the norm of what the codes leave of each segment of `SEGMENT` components. With q the codes times the step, e = x - q the rest, and
segments numbered s, the inequality of Cauchy and Schwarz gives for a centroid c

    |x - c|^2 = |x|^2 + |c|^2 - 2 q.c - 2 e.c >= |x|^2 + |c|^2 - 2 q.c - 2 sum over s of |e_s| |c_s|.

So the codes and the norms bound all distances of a batch from below. The exact integer distance to the centroid of the least bound comes
first; only centroids whose bound (less a slack for rounding) does not exceed it receive exact distances too. The answer is that of
comparing all of them.

A round is one job: tasks assign their rows and add up components and counts of each centroid, Spark adds up the tasks' sums, and the
driver divides them; it holds k centroids and no vector. A lost executor costs its tasks, as every round reads what was written.

Null lists, other lengths, nulls, NaN and infinity among the components: no row. Rows that repeat an id, or all of a row, are vectors of
their own; where start hashes tie, the smaller components come first. A null id takes part, hashed like an empty one. Fewer than k kept
vectors give as many centroids, none gives no rows. Ties between centroids go to the smaller number; an empty centroid stays where it is.
Sums and distances are exact while every |scale * x| stays below 2^27, beyond that the job ends with an error. Other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import parts, scratch_folder

#: Components of a segment; bits of a code; pairs that receive exact distances at a time; the largest component.
SEGMENT, CODE_BITS, PAIRS, LARGEST = 8, 6, 1 << 16, 1 << 27
#: Share of the squared norms by which rounding may lift a bound: norms of rests are kept in 24 bits.
SLACK = 1e-6
FORM = ["components", "codes", "step", "square", "rests"]


class Compressed:
    """Codes, steps, squared norms and segment norms of the rests, a row each."""

    def __init__(self, codes: np.ndarray, step: np.ndarray, square: np.ndarray, rests: np.ndarray):
        self.codes, self.step, self.square, self.rests = codes, step, square, rests


def segment_norms(rows: np.ndarray) -> np.ndarray:
    """The norm of each segment; the last one may be shorter."""
    return np.sqrt(np.add.reduceat(rows.astype(np.float64) ** 2, np.arange(0, rows.shape[1], SEGMENT), axis=1))


def compressed(vectors: np.ndarray) -> Compressed:
    """The compressed form of rows of integers."""
    most = (1 << CODE_BITS - 1) - 1
    step = np.maximum(-(-np.abs(vectors).max(1) // most), 1)
    codes = np.rint(vectors / step[:, None]).astype(np.int64)
    rests = segment_norms(vectors - codes * step[:, None])
    return Compressed(codes.astype(np.int8), step, np.einsum("ij,ij->i", vectors, vectors), rests.astype(np.float32))


def lower_bounds(form: Compressed, centroids: np.ndarray) -> np.ndarray:
    """No more than the squared distance of any vector, given by its compressed form, to any centroid."""
    ends = form.square.astype(np.float64)[:, None] + np.einsum("ij,ij->i", centroids, centroids).astype(np.float64)
    coded = form.codes.astype(np.float64) @ centroids.T.astype(np.float64) * form.step[:, None]
    return ends - 2 * (coded + form.rests.astype(np.float64) @ segment_norms(centroids).T) - SLACK * ends


def exact(vectors: np.ndarray, centroids: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, in integers."""
    found = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), PAIRS):
        apart = vectors[rows[at : at + PAIRS]] - centroids[columns[at : at + PAIRS]]
        found[at : at + PAIRS] = np.einsum("ij,ij->i", apart, apart)
    return found


def nearest(vectors: np.ndarray, form: Compressed, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and squared distance for each vector, and how many pairs were compared exactly."""
    bounds = lower_bounds(form, centroids)
    every = np.arange(len(vectors))
    likely = bounds.argmin(1)
    near = exact(vectors, centroids, every, likely)
    open_ = bounds <= near[:, None]
    open_[every, likely] = False
    rows, columns = np.nonzero(open_)
    known = np.full(bounds.shape, np.iinfo(np.int64).max)
    known[every, likely] = near
    known[rows, columns] = exact(vectors, centroids, rows, columns)
    cluster = known.argmin(1)  # the first of equal ones
    return cluster, known[every, cluster], len(vectors) + len(rows)


def store(vectors: DataFrame, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, components (packed 32-bit values) and the compressed form of every kept vector, written to the shared folder."""
    whole = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("x"))
    infinite = F.lit(float("inf"))
    whole = whole.where(F.coalesce(F.size("x") == dims, F.lit(False)) & F.coalesce(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite)), F.lit(False)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4096):
            values = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dims)
            if len(values) and np.abs(values).max() > LARGEST:
                raise ValueError(f"a component times {scale} is beyond 2^27, distances would not fit 64 bits")
            values = values.astype(np.int64)
            form = compressed(values)
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (values.astype("<i4"), form.codes, form.rests.astype("<f4"))]
            columns = [batch.column(0), packed[0], packed[1], pa.array(form.step), pa.array(form.square), packed[2]]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", *FORM])

    kind = dict(whole.dtypes)["vec_id"]
    folder = scratch_folder(vectors.sparkSession, "vectors")
    whole.mapInArrow(pack, f"vec_id {kind}, components binary, codes binary, step long, square long, rests binary").write.parquet(folder)
    return vectors.sparkSession.read.parquet(folder)


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of equally long packed values."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """A batch, its vectors, their clusters and distances."""
    for batch in parts(batches, 4096):
        if not batch.num_rows:
            continue
        vectors = _unpacked(batch.column(1), "<i4").astype(np.int64)
        form = Compressed(_unpacked(batch.column(2), "i1"), batch.column(3).to_numpy(), batch.column(4).to_numpy(), _unpacked(batch.column(5), "<f4"))
        cluster, distance, _ = nearest(vectors, form, centroids)
        yield batch, vectors, cluster, distance


def start(stored: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of `salt:id`; one small row each comes to the driver."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = stored.select(F.sha2(name.cast("binary"), 256).alias("h"), "components").orderBy("h", "components").limit(k).collect()
    tied = sorted(((row["h"], tuple(np.frombuffer(row["components"], "<i4").tolist())) for row in rows))
    return np.array([components for _, components in tied], np.int64)


def moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of what is nearest to each."""
    shared = stored.sparkSession.sparkContext.broadcast(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        sums, counts = np.zeros_like(where), np.zeros(len(where), np.int64)
        for _, vectors, cluster, _ in _assigned(batches, where):
            np.add.at(sums, cluster, vectors)
            counts += np.bincount(cluster, minlength=len(where))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there]), pa.array(list(sums[there]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    partial = stored.mapInArrow(add, "cluster int, n long, sums array<long>")
    flat = partial.select("cluster", "n", F.posexplode("sums").alias("pos", "part")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    after = centroids.copy()
    for row in flat.collect():  # k times dims small rows
        after[row["cluster"], row["pos"]] = row["total"] // row["n"]
    return after


def fit(stored: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2") -> np.ndarray:
    """Centroids after so many rounds over what store() wrote; k rows at most."""
    centroids = start(stored, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(stored, centroids)
    return centroids


def assign(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every stored vector."""
    kind = dict(stored.dtypes)["vec_id"]
    if not len(centroids):
        return stored.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    shared = stored.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance in _assigned(batches, shared.value):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return stored.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster_report(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", dims: int = 64, scale: int = 256, **columns) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    stored = store(vectors, dims, scale, **columns)
    centroids = fit(stored, k, rounds, salt)
    folder = scratch_folder(spark, "assigned")
    assign(stored, centroids).write.parquet(folder)
    found = spark.read.parquet(folder)
    sums = {row["cluster"]: row["n"] for row in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k small rows
    digests = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in centroids]
    rows = [(at, n, sum(sums.values()), digests[at]) for at, n in sums.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def report_sql(k: int = 40, rounds: int = 5, salt: str = "2", dims: int = 64, scale: int = 256) -> str:
    """DuckDB SQL: all distances of every round, written from the contract."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x AS m FROM v QUALIFY c < {k})",
    ]
    for at in range(rounds + 1):
        steps.append(f"d{at} AS MATERIALIZED (SELECT r, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{at})")
        steps.append(f"a{at} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{at} GROUP BY r)")
        if at < rounds:
            steps.append(f"s{at} AS (SELECT c, i, sum(y)::BIGINT AS t, count(*) AS n FROM (SELECT c, unnest(x) AS y, unnest(range({dims})) AS i FROM a{at} JOIN v USING (r)) GROUP BY c, i)")
            steps.append(f"n{at} AS (SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY i) AS m FROM s{at} GROUP BY c)")
            steps.append(f"c{at + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{at} o LEFT JOIN n{at} n USING (c))")
    return f"""WITH {", ".join(steps)} SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)"""
