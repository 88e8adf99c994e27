"""Each stage on its own input against a brute-force version, and the whole run, on awkward tables too."""

import base64
import hashlib
import struct
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import licenses, quality
from corpusloom.llm.common import documents
from tests.llm.test_contracts import ALNUM, LOWER, components, repeated_lines, rows, sha, texts


def without_lines(docs):
    """Texts without later copies of repeated runs of eight words, by id."""
    unique = sorted(set(docs))
    lines = [(key, key[1].split("\n") if key[1] else []) for key in unique]
    gone = repeated_lines(lines, 8)
    return {key[0]: "\n".join(line for k, line in enumerate(own) if k not in gone[key]) for key, own in lines}


def clean(docs, items):
    """Ids of documents of whose words less than 5 % lie in benchmark windows."""

    def words(text):
        return ALNUM.findall((text or "").translate(LOWER))

    windows = {tuple(own[k : k + n]) for own in map(words, items) if own for n in [min(13, len(own))] for k in range(len(own) - n + 1)}
    lengths, found = {len(w) for w in windows}, set()
    for doc_id, text in docs:
        own = words(text)
        hit = {j for n in lengths for k in range(len(own) - n + 1) if tuple(own[k : k + n]) in windows for j in range(k, k + n)}
        if not hit or 20 * len(hit) < len(own):
            found.add(doc_id)
    return found


def encoded(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = Counter()
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        found[doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha(text or "")] += 1
    return found


def tokens(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in rows(df))


def test_stages(spark, sf):
    docs = documents(spark, sf)
    columns = docs.columns
    labels, bench = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("labels", "benchmark"))
    for name, stage in corpus_pipeline.STAGES:
        out, before = stage(spark, docs, sf).checkpoint(), texts(docs)
        if name == "tokens":
            assert tokens(out) == encoded(before)
            break
        assert out.columns == columns
        after = dict(texts(out))
        if name == "line_dedup":
            wanted = without_lines([(i, t or "") for i, t in before])
            assert {i: t or "" for i, t in after.items()} == wanted
            assert any(wanted[i] != (t or "") for i, t in before)
        else:
            assert all(after[i] == t for i, t in before if i in after)
        if name == "quality":
            assert set(after) == {r["doc_id"] for r in quality.quality_report(docs, labels).where("score >= 0.3").collect()}
        if name == "near_dedup":
            wanted = {i for i, (_, least) in components(before, 5, 80).items() if i == least}
            assert set(after) == wanted and len(wanted) < len(before)
        if name == "decontamination":
            assert set(after) == clean(before, [r["text"] for r in rows(bench)])
        docs = out


def test_run(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids"} <= set(found.columns)
    assert 0 < found.count() < documents(spark, sf).count()


def _written(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_run_on_awkward_tables(spark, sf, awkward, tmp_path):
    """Nulls, empty, long and repeated rows, clashing names: one row of each group and each id, null ids but once a text, tokens of what is left."""
    labels, bench = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("labels", "benchmark"))
    odd = spark.createDataFrame([(None, None), (900, ""), (901, None)], "item_id long, text string")
    folder = _written(tmp_path, documents=awkward, labels=labels.withColumn("score", F.lit("x")), benchmark=bench.select("item_id", "text").union(odd).withColumn("doc_id", F.lit(None).cast("string")))
    got = rows(corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and {r["doc_id"] for r in got} <= {r["doc_id"] for r in rows(awkward.select("doc_id"))}
    kept = {r["doc_id"] for r in rows(quality.quality_report(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")).where("score >= 0.3"))}
    assert {900, 901, 902} & kept <= set(ids)
    assert all((r["n_tokens"] == 0) == (r["decoded_sha256"] == sha("")) for r in got)


def test_run_on_empty_tables(spark, sf, nothing, tmp_path):
    labels, bench = (spark.read.parquet(f"{sf}/{name}.parquet").where("false") for name in ("labels", "benchmark"))
    found = corpus_pipeline.run(spark, _written(tmp_path, documents=nothing, labels=labels, benchmark=bench))
    assert found.count() == 0 and {"doc_id", "n_tokens", "ids"} <= set(found.columns)


def test_licenses_of_awkward_rows(spark, awkward):
    """Each row by itself, as in a plain table of ids and texts; clashing names are not looked at; a notice behind a very long text is found."""
    longest = awkward.where("doc_id = 904").withColumns({"doc_id": F.lit(906).cast("long"), "text": F.concat("text", F.lit("Released under the MIT License.\n"))}).select(awkward.columns)
    every = awkward.union(longest)
    got = Counter(tuple(r.values()) for r in rows(licenses.license_report(every)))
    assert got == Counter(tuple(r.values()) for r in rows(licenses.license_report(every.select("doc_id", "text"))))
    assert sum(got.values()) == every.count()
    empty = {tuple(r.values())[1:] for r in rows(licenses.license_report(awkward.where("doc_id in (900, 901)")))}
    assert len(empty) == 1 and [r["licenses"] for r in rows(licenses.license_report(longest))] == ["MIT"]
