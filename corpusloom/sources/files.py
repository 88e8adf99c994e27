"""File scans and sinks. A missing optional source is an empty table; malformed records are counted, not fatal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORD = "record_id string, module string, title string, source string, text string, source_file string, source_index long, metadata map<string,string>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, as Spark's own file system sees it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def _schema(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def keyed_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A JSON array of records; empty if the file is missing, unreadable records are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], _schema(schema))
    return spark.read.schema(_schema(schema)).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def json_lines(spark: SparkSession, path: str, schema: str | StructType, optional: bool = True) -> DataFrame:
    if optional and not exists(spark, path):
        return spark.createDataFrame([], _schema(schema))
    return spark.read.schema(_schema(schema)).json(path)


def many_files(spark: SparkSession, pattern: str, schema: str | StructType, first: str | None = None, without: str | None = None) -> DataFrame:
    """All files of a pattern with _source_file and _order (files whose name contains `first` come first); names containing `without` are left out."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], StructType.fromDDL("_source_file string, _order int")).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in _schema(schema)], "*")
    rows = spark.read.schema(_schema(schema)).option("multiLine", True).json(pattern).withColumn("_source_file", F.col("_metadata.file_name"))
    rows = rows.where(~F.col("_source_file").contains(without)) if without else rows
    return rows.withColumn("_order", F.when(F.col("_source_file").contains(first), 0).otherwise(1) if first else F.lit(0))


def augmented(static: DataFrame, files: DataFrame, key: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """The static rows, and those of the files whose key is not there yet; the first file wins a key, missing fields get defaults."""
    first = files.groupBy(key).agg(F.min_by(F.struct(*[c for c in files.columns if c != key]), "_source_file").alias("_row")).select(key, "_row.*")
    new = first.join(static.select(key), key, "left_anti")
    joined = static.unionByName(new, allowMissingColumns=True)
    return joined.select(*[F.coalesce(F.col(c), F.lit((defaults or {})[c])).alias(c) if c in (defaults or {}) else F.col(c) for c in joined.columns])


def map_entries(rows: DataFrame, column: str) -> DataFrame:
    """key and value of a map column."""
    return rows.select(F.explode(column))


def written(rows: DataFrame, path: str, form: str = "json", by: Sequence[str] = (), one_order: Sequence[str] = ()) -> DataFrame:
    """Writes a whole folder, replaced as a job commits, partitioned by columns; gives the rows as read back."""
    ordered = rows.sortWithinPartitions(*one_order) if one_order else rows
    writer = ordered.write.mode("overwrite").format(form)
    (writer.partitionBy(*by) if by else writer).save(path)
    return rows.sparkSession.read.schema(rows.schema).format(form).load(path)


def front_matter(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Markdown files with a JSON head between `---` lines: path, the head's fields and body; a file without a readable head is left out, and so is a readme."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path")).where(~F.lower(F.col("path")).contains("readme"))
    head = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)", 1)
    parsed = files.select("path", F.from_json(head, schema).alias("_head"), F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*(?:\n|$)", "").alias("body"))
    return parsed.where("_head is not null").select("path", "_head.*", "body")


def binary(spark: SparkSession, path: str) -> DataFrame:
    """name, content and sha256 of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.sha2("content", 256).alias("sha256"))


def pinned(files: DataFrame, pins: DataFrame) -> DataFrame:
    """name, content, status for pins (name, sha256): bound, stale or missing. Content is null unless it is bound."""
    joined = pins.select("name", F.col("sha256").alias("_pin")).join(files, "name", "left")
    status = F.when(F.col("content").isNull(), "missing").when(F.col("sha256") == F.col("_pin"), "bound").otherwise("stale")
    return joined.select("name", F.when(status == "bound", F.col("content")).alias("content"), status.alias("status"))


def all_bound(checked: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Whether every resource of an identity is bound; false for none."""
    return checked.groupBy(*group).agg(F.coalesce(F.bool_and(F.col("status") == "bound"), F.lit(False)).alias("bound"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality as multisets of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def imported(manifest: DataFrame, bodies: DataFrame, key: str = "name") -> DataFrame:
    """Manifest rows with their bodies: adds text (line ends normalised) and reason: missing, empty, hash, placeholder, or null for accepted rows.

    A row's hash may be the file's or the text's, in column sha256; null asks for none.
    """
    joined = manifest.join(bodies.select(key, F.decode("content", "UTF-8").alias("_raw"), F.col("sha256").alias("_file")), key, "left")
    body = F.regexp_replace("_raw", r"\r\n?", "\n")
    fits = F.col("sha256").isNull() | (F.col("sha256") == F.col("_file")) | (F.col("sha256") == F.sha2(F.col("text").cast("binary"), 256))
    reason = F.when(F.col("_raw").isNull(), "missing").when(F.trim("text") == "", "empty").when(~fits, "hash").when(F.col("text").isin("TODO", "..."), "placeholder")
    return joined.withColumn("text", body).withColumn("reason", reason).drop("_raw", "_file")


def record(rows: DataFrame, module: str, record_id: Column, title: Column, text: Column, source_file: Column, index: Column, metadata: Column, source: str = "local") -> DataFrame:
    """Any table as records of one schema."""
    return rows.select(
        record_id.cast("string").alias("record_id"), F.lit(module).alias("module"), title.cast("string").alias("title"), F.lit(source).alias("source"), text.cast("string").alias("text"),
        source_file.cast("string").alias("source_file"), index.cast("long").alias("source_index"), metadata.alias("metadata"),
    )


def union_of(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def exploded_modules(pages: DataFrame, raw: str, schema: str) -> DataFrame:
    """Nested page JSON (modules of components of rows) as flat rows: every level keeps its position."""
    parsed = pages.withColumn("_page", F.from_json(raw, schema)).where("_page is not null")
    modules = parsed.select(*pages.columns, F.posexplode("_page.modules").alias("module", "_m"))
    components = modules.select(*pages.columns, "module", F.col("_m.name").alias("module_name"), F.posexplode("_m.components").alias("component", "_c"))
    return components.select(*pages.columns, "module", "module_name", "component", F.col("_c.id").alias("component_id"), F.posexplode("_c.rows").alias("row", "value"))


def latest_sessions(rows: DataFrame, tenant: str, session: str, stamp: str) -> DataFrame:
    """The newest state of each session; ids that are no plain names are left out."""
    good = rows.where(F.col(session).rlike(r"^[A-Za-z0-9_-]{1,64}$"))
    rest = [c for c in rows.columns if c not in (tenant, session)]
    return good.groupBy(tenant, session).agg(F.max_by(F.struct(*rest), stamp).alias("_row")).select(tenant, session, "_row.*")
