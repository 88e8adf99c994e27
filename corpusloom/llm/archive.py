"""A content-addressed web archive: payload bytes once, exact record headers apart, records put together again by joins.

An archive is a folder with two Parquet tables. `payloads` holds every distinct payload once, under its SHA-256, as a zstd frame. `headers`
holds, for each record, the exact bytes that stand before its payload (WARC headers, and HTTP headers where there are any) and the digest of
the payload, null where a record carries none. `restore` joins the two; each payload's digest is worked out again before its bytes are
trusted. `import_warc` brings existing WARC files into this form, `write_archive` makes records of rows with an id, a URL and a payload.

Of rows with equal payloads of at least `least_bytes`, that with the largest id is a response and the others revisit it; a revisit's
record has the HTTP headers but no payload, and names the response's record. Below that size every row is a response, yet equal payloads
are stored once all the same. Equal payloads meet as digests: tasks first reduce their own rows to one a payload, so a payload of a
third of all rows is one row a task, and only rows of ids and digests meet the store again, in joins that Spark may split.

A null payload is empty, a null URL's header is left out. A row with a null id is a response if no row with an id holds an equal payload,
and revisits it otherwise. Rows that repeat an id and a payload are responses together, under one record id. Payloads are kept whole,
however long; line breaks in a URL are escaped. An empty table gives an empty archive. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import parts, scratch_folder

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n"
END = b"\r\n\r\n"
HEADERS = "header binary, digest binary"
PAYLOADS = "digest binary, n_bytes long, frame binary"


def record_id(id_col: Column, digest: Column) -> Column:
    """urn:uuid of a row, by its id and the digest of its payload."""
    h = F.sha2(F.concat(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"), F.lit(b":"), digest), 256)
    return F.concat_ws("-", F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8)), *(F.substring(h, at, n) for at, n in ((9, 4), (13, 4), (17, 4), (21, 12))))


def framed(rows: DataFrame) -> DataFrame:
    """digest, n_bytes, frame and the other columns of rows with a payload (binary)."""
    others = [name for name in rows.columns if name != "payload"]
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes if name != "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in parts(batches, 256):
            whole = [x.as_buffer() for x in batch.column("payload")]
            made = [
                pa.array([hashlib.sha256(x).digest() for x in whole], pa.binary()),
                pa.array([len(x) for x in whole], pa.int64()),
                pa.array([packer.compress(x) for x in whole], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*made, *(batch.column(name) for name in others)], ["digest", "n_bytes", "frame", *others])

    return rows.mapInArrow(run, f"{PAYLOADS}{', ' if kinds else ''}{kinds}")


def store_payloads(rows: DataFrame, folder: str) -> DataFrame:
    """Writes every distinct payload of (payload, id) once; digest and owner (the largest id that holds it)."""
    once = framed(rows.select("payload", "id")).groupBy("digest").agg(F.any_value("n_bytes").alias("n_bytes"), F.max("id").alias("owner"), F.any_value("frame").alias("frame"))
    once.write.parquet(f"{folder}/payloads")
    return rows.sparkSession.read.parquet(f"{folder}/payloads").select("digest", "owner")


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines as one string; a line whose value is null is left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n")), F.lit("")) for name, value in pairs))


def write_archive(rows: DataFrame, folder: str, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record of each row to a new archive."""
    whole = rows.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    owners = store_payloads(whole, folder)
    known = whole.select("id", "url", F.length("payload").alias("n"), F.sha1("payload").alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("digest")).join(owners, "digest")
    again = (F.col("n") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("owner"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("n").cast("string"))), F.lit("\r\n"))
    size = F.length(http.cast("binary")) + F.when(again, 0).otherwise(F.col("n"))
    bracketed = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    warc = F.concat(
        F.lit("WARC/1.1\r\n"),
        _lines(
            ("WARC-Type", F.when(again, "revisit").otherwise("response")),
            ("WARC-Record-ID", bracketed(record_id(F.col("id"), F.col("digest")))),
            ("WARC-Date", date),
            ("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            ("WARC-Profile", F.when(again, PROFILE)),
            ("WARC-Refers-To", F.when(again, bracketed(record_id(F.col("owner"), F.col("digest"))))),
            ("X-Source-ID", F.col("id").cast("string")),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", size.cast("string")),
        ),
        F.lit("\r\n"),
    )
    known.select(F.concat(warc, http).cast("binary").alias("header"), F.when(~again, F.col("digest")).alias("digest")).write.parquet(f"{folder}/headers")


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    """Header bytes and payload of each record of a WARC file, plain or compressed record by record; a record whose block is HTTP
    headers only, as a revisit's, has no payload."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(END, at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for line in data[at:end].split(BREAK)[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        block, stop = end + 4, end + 4 + int(fields[b"content-length"])
        if data[stop : stop + 4] != END:
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        if fields.get(b"content-type", b"").startswith(b"application/http"):
            cut = data.find(END, block, stop)
            block = stop if cut < 0 else cut + 4
        none = block == stop and fields.get(b"warc-type") == b"revisit"
        yield data[at:block], None if none else data[block:stop]
        at = stop + 4


def import_warc(spark: SparkSession, path: str, folder: str) -> None:
    """Brings the WARC files at a path into a new archive. A file is held by one task; such files have about 1 GB by convention."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = list(split_records(data.as_buffer().to_pybytes()))
                for at in range(0, len(found), 256):
                    heads, payloads = zip(*found[at : at + 256], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(payloads, pa.binary())], ["header", "payload"])

    landed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header binary, payload binary")
    store_payloads(landed.where("payload is not null").select("payload", F.lit(None).cast("long").alias("id")), folder)
    landed.select("header", F.unhex(F.sha2("payload", 256)).alias("digest")).write.parquet(f"{folder}/headers")


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """header and payload (null where the record carries none) of every record, payloads verified by their digests."""
    headers = spark.read.schema(HEADERS).parquet(f"{folder}/headers")
    stored = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in parts(batches, 256):
            payloads = []
            for digest, frame in zip(batch.column(1), batch.column(2), strict=True):
                payloads.append(unpacker.decompress(frame.as_buffer()))
                if hashlib.sha256(payloads[-1]).digest() != digest.as_py():
                    raise ValueError(f"a payload is not what its digest {digest.as_py().hex()} says")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(payloads, pa.binary())], ["header", "payload"])

    carried = headers.where("digest is not null").join(stored, "digest").select("header", "digest", "frame").mapInArrow(run, "header binary, payload binary")
    return carried.union(headers.where("digest is null").select("header", F.lit(None).cast("binary")))


def record_bytes(header: str = "header", payload: str = "payload") -> Column:
    """A whole record as it stands in a WARC file."""
    return F.concat(F.col(header), F.coalesce(F.col(payload), F.lit(b"")), F.lit(END))


def field(name: str, header: str = "header") -> Column:
    """A WARC header's value; null where there is none."""
    head = F.substring_index(F.decode(F.col(header), "ISO-8859-1"), "\r\n\r\n", 1)
    value = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*<?([^\r\n]*?)>?[ \t]*\r?$", 1)
    return F.when(value != "", value)


def archive_report(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", **columns) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, read back from an archive of them."""
    spark, kind = pages.sparkSession, dict(pages.select(id_col).dtypes)[id_col]
    write_archive(pages, folder := scratch_folder(spark, "archive"), least_bytes, id_col, **columns)
    records = restore(spark, folder).select(
        field("X-Source-ID").cast(kind).alias("page_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("target"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    records.write.parquet(folder := scratch_folder(spark, "records"))  # a row a record, without its bytes
    records = spark.read.schema(records.schema).parquet(folder)
    responses = records.where("record_type = 'response'")
    of = responses.groupBy(F.col("record_id").alias("target")).agg(*(F.first(name).alias(name) for name in ("payload_bytes", "payload_digest")), F.first("page_id").alias("refers_to"))
    of.write.parquet(folder := scratch_folder(spark, "responses"))
    of = spark.read.schema(of.schema).parquet(folder)
    revisits = records.where("record_type = 'revisit'").select("page_id", "record_type", "target").join(of, "target")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return responses.select(*columns, F.lit(None).cast(kind).alias("refers_to")).union(revisits.select(*columns, "refers_to"))


def report_sql(least_bytes: int = 1000) -> str:
    """DuckDB SQL, written from the contract."""
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT *, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
    SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= {least_bytes} AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= {least_bytes} AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM m"""
