"""Cases of the fourth round: rows that a shuffle hands over in another order each time."""

import random

import pyarrow as pa

from corpusloom.llm import substrings


def _brute(texts, window):
    """n_words and n_removed of each text by comparing all windows."""
    words = [(text or "").split(" ") for text in texts]
    seen = {}
    for own in words:
        for at in range(len(own) - window + 1):
            key = tuple(own[at : at + window])
            seen[key] = seen.get(key, 0) + 1
    found = []
    for own in words:
        gone = set()
        for at in range(len(own) - window + 1):
            if seen[tuple(own[at : at + window])] > 1:
                gone.update(range(at, at + window))
        found.append((len(own), len(gone)))
    return found


def test_substrings_when_a_block_is_read_in_another_order(spark):
    """Every evaluation of the table gives its rows in another order, as fetches from several executors do."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for i in range(60):
        words = [f"w{rng.random()}" for _ in range(rng.randrange(36, 90))]
        at = rng.randrange(len(words))
        texts.append(" ".join(words[:at] + passage + words[at:] if i % 3 == 0 else words))
    rows = list(enumerate(texts))

    def shuffled(batches):
        for batch in batches:
            order = list(range(batch.num_rows))
            random.SystemRandom().shuffle(order)
            yield batch.take(pa.array(order))

    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(shuffled, "doc_id long, text string")
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.substring_report(docs).collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert [got[i] for i in range(len(texts))] == _brute(texts, 35)
