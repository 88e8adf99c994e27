import pytest
from pyspark.sql import functions as F

from corpusloom.llm.common import documents

#: Names that operators use inside.
CLASHING = ("row", "_row", "_key", "_text", "node", "band", "label", "block", "rank", "next", "pos", "line", "part", "shard", "media", "score", "id", "key")


@pytest.fixture(scope="session")
def small(spark, sf):
    """The small table as it is."""
    return documents(spark, sf).repartition(4).cache()


@pytest.fixture(scope="session")
def awkward(spark, sf):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and extra columns with clashing names."""
    docs = documents(spark, sf).where("doc_id < 12")
    long = " ".join(f"word{i % 977} and line {i % 13}.\n" for i in range(60_000))
    rows = [(None, None, None, None, None), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, " \n\t ", None, "s", 4), (903, "single", "en", None, 6), (904, long, "en", "s", None), (905, long, "en", "s", None), (906, "Ünï çødé 漢字 🙂 x", "en", "s", 3), (None, "text without an id", "en", "s", 1)]
    more = spark.createDataFrame(rows, docs.schema)
    every = docs.union(more).union(docs.where("doc_id < 4")).union(more.where("doc_id = 903"))
    return every.select("*", *[F.lit(name).alias(name) for name in CLASHING]).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false").cache()
