"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and cut into blocks of four; learned filters look at three blocks (12 bytes) at every block.
Positions form chunks of 512 bytes whose windows reach into the next chunk, so they overlap and cover the whole document. Each
filter is max-pooled over a chunk; the mean and the maximum of the chunks' values go into one logistic unit.

The network is fitted in one task on a bounded sample: at most `rows` labelled documents of at most `max_bytes` bytes, the
first by a hash of doc_id. Everything that is scored is scored whole, one row by itself, without a shuffle. Null text is
empty; an empty text is one chunk of padding and has a score like any other. Several labels of one document count as the
least; null labels are left out. With no usable label every score is 0.5. Repeated rows have equal scores; an empty table gives none. The
report's fold is null where doc_id is, and such a row teaches nothing, as no label is its own. `keep_good` carries a row as one struct, so
its columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import doc_bytes, parts, views

BLOCK, REACH, CHUNK = 4, 3, 128  # bytes a block, blocks a filter sees, blocks a chunk
EMBED, FILTERS = 6, 24
PAD = 256
#: Bounds of the sample that the network is fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32768
#: Passes over the sample; a small sample gets more, up to so many, for at least STEPS minibatches.
EPOCHS, MOST_EPOCHS, STEPS, MINIBATCH, RATE = 6, 60, 800, 32, 0.01


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as blocks, padded to whole chunks with two blocks of padding at least; the number of chunks of each."""
    chunks = np.array([(len(text) + REACH * BLOCK - BLOCK - 1) // (BLOCK * CHUNK) + 1 for text in texts], np.int64)
    ids = np.full(int(chunks.sum()) * CHUNK * BLOCK, PAD, np.int16)
    at = 0
    for text, n in zip(texts, chunks, strict=True):
        ids[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += int(n) * CHUNK * BLOCK
    return ids, chunks


class Network:
    """Weights, forward pass and gradient."""

    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)
        self.embed = random.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        self.filters = random.normal(0, (REACH * BLOCK * EMBED) ** -0.5, (REACH, BLOCK * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = random.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.prior = np.zeros(1, np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.prior]

    def respond(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, rectified responses at every block); positions that would reach into the next text respond with 0."""
        blocks = np.take(self.embed, ids, axis=0).reshape(-1, BLOCK * EMBED)
        sums = blocks @ self.filters[0] + self.bias
        for reach in range(1, REACH):
            sums[:-reach] += blocks[reach:] @ self.filters[reach]
        np.maximum(sums, 0, out=sums)
        for reach in range(1, REACH):
            sums[ends - reach] = 0
        return blocks, sums

    def logits(self, ids: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        """One logit a text."""
        _, sums = self.respond(ids, np.cumsum(chunks) * CHUNK)
        pooled = sums.reshape(-1, CHUNK, FILTERS).max(axis=1)
        starts = np.cumsum(chunks) - chunks
        mean = np.add.reduceat(pooled, starts, axis=0) / chunks[:, None]
        most = np.maximum.reduceat(pooled, starts, axis=0)
        return np.concatenate([mean, most], axis=1) @ self.out + self.prior[0]

    def gradient(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        ids, chunks = layout(texts)
        blocks, sums = self.respond(ids, np.cumsum(chunks) * CHUNK)
        cube = sums.reshape(-1, CHUNK, FILTERS)
        where = cube.argmax(axis=1)
        pooled = np.take_along_axis(cube, where[:, None, :], 1)[:, 0]
        starts, of = np.cumsum(chunks) - chunks, np.repeat(np.arange(len(chunks)), chunks)
        mean = np.add.reduceat(pooled, starts, axis=0) / chunks[:, None]
        most = np.maximum.reduceat(pooled, starts, axis=0)
        features = np.concatenate([mean, most], axis=1)
        wrong = (1 / (1 + np.exp(-(features @ self.out + self.prior[0]))) - labels).astype(np.float32) / len(labels)
        back = wrong[:, None] * self.out
        chunk_back = (back[:, :FILTERS] / chunks[:, None])[of]
        best = pooled == most[of]
        best &= np.cumsum(best, axis=0) - np.concatenate([np.zeros((1, FILTERS), int), np.cumsum(best, axis=0)])[starts][of] == 1
        chunk_back = (chunk_back + back[:, FILTERS:][of] * best) * (pooled > 0)
        rows = (np.arange(len(pooled))[:, None] * CHUNK + where).ravel()
        columns = np.tile(np.arange(FILTERS), len(pooled))
        values = chunk_back.astype(np.float32).ravel()
        used = values != 0
        rows, columns, values = rows[used], columns[used], values[used]
        filters, embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for reach in range(REACH):
            inputs = blocks[np.minimum(rows + reach, len(blocks) - 1)]
            np.add.at(filters[reach].T, columns, inputs * values[:, None])
            spread = (self.filters[reach].T[columns] * values[:, None]).reshape(-1, EMBED)
            np.add.at(embed, ids.reshape(-1, BLOCK)[np.minimum(rows + reach, len(blocks) - 1)].ravel(), spread)
        embed[PAD] = 0
        bias = np.bincount(columns, values, FILTERS).astype(np.float32)
        return [embed, filters, bias, (wrong @ features).astype(np.float32), np.array([wrong.sum()], np.float32)]

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int | None = None, seed: int = 7) -> Network:
        """Adam over shuffled minibatches."""
        epochs = epochs or min(MOST_EPOCHS, max(EPOCHS, -(-STEPS * MINIBATCH // len(texts))))
        share = float(np.clip(labels.mean(), 0.02, 0.98))
        self.prior[0] = np.log(share / (1 - share))
        random, step = np.random.default_rng(seed), 0
        first, second = [np.zeros_like(p) for p in self.parts()], [np.zeros_like(p) for p in self.parts()]
        total = epochs * -(-len(texts) // MINIBATCH)
        for _ in range(epochs):
            order = random.permutation(len(texts))
            for at in range(0, len(order), MINIBATCH):
                chosen = order[at : at + MINIBATCH]
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for part, slope, m, v in zip(self.parts(), self.gradient([texts[i] for i in chosen], labels[chosen]), first, second, strict=True):
                    m += 0.1 * (slope - m)
                    v += 0.001 * (slope**2 - v)
                    part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


    def packed(self) -> bytes:
        return np.concatenate([part.ravel() for part in self.parts()]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Network:
        net, at = cls(), 0
        values = np.frombuffer(data, np.float32)
        for part in net.parts():
            part[...] = values[at : at + part.size].reshape(part.shape)
            at += part.size
        return net


def sample_of(docs: DataFrame, labels: DataFrame, usable: Column, rows: int, max_bytes: int, label_col: str) -> DataFrame:
    """One partition of at most `rows` labelled (text, label), the first by a hash of doc_id: chosen among the labels, then joined as a small table."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.min(label_col).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes)
    return texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Network | None:
    """A network fitted on labelled documents outside the held-out fold (crc32 of doc_id as text, modulo folds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [row for batch in batches for row in batch.to_pylist()]
        if sample:
            texts = [doc_bytes(row["text"]) for row in sample]
            net = Network().fit(texts, np.array([row["label"] for row in sample], np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([net.packed()], pa.binary())], ["weights"])

    sample = sample_of(docs, labels, fold(folds) != held_out, rows, max_bytes, label_col)
    found = sample.mapInArrow(run, "weights binary").collect()
    return Network.unpacked(found[0]["weights"]) if found else None


def fold(folds: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def score(docs: DataFrame, network: Network | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """The kept columns and score, the probability of label 1, of every whole text. text_col may be a field of the kept struct: `row.text`."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kinds = dict(docs.dtypes)
    row, _, field = text_col.partition(".")

    def long_logit(net: Network, text: memoryview) -> float:
        """The logit of one text that exceeds a batch, piece by piece: pieces share two blocks, so no window is lost."""
        step, pooled = batch_bytes // (BLOCK * CHUNK) * BLOCK * CHUNK, []
        for at in range(0, len(text), step):
            last = at + step >= len(text)
            ids, chunks = layout([text[at : at + step] if last else text[at : at + step + (REACH - 1) * BLOCK]])
            _, sums = net.respond(ids, np.cumsum(chunks) * CHUNK)
            values = sums.reshape(-1, CHUNK, FILTERS).max(axis=1)
            pooled.append(values if last else values[: step // (BLOCK * CHUNK)])
        every = np.concatenate(pooled)
        return float(np.concatenate([every.mean(axis=0), every.max(axis=0)]) @ net.out + net.prior[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in parts(batches):
            scores = np.full(batch.num_rows, 0.5)
            if net is not None:
                texts = views(batch.column(keep.index(row)).field(field) if field else batch.column(len(keep)))
                group: list[int] = []
                size = 0
                for i, text in enumerate([*texts, None]):
                    if group and (text is None or size + len(text) > batch_bytes):
                        scores[group] = net.logits(*layout([texts[k] for k in group]))
                        group, size = [], 0
                    if text is not None:
                        if len(text) > batch_bytes:
                            scores[i] = long_logit(net, text)
                        else:
                            group.append(i)
                            size += len(text)
                scores = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], [*keep, "score"])

    schema = ", ".join([*(f"`{name}` {kinds[name]}" for name in keep), "score double"])
    return docs.select(*keep, *([] if field else [text_col])).mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row"))
    scored = score(rows, train(docs, labels), keep=("_row",), text_col="_row.text")
    return scored.where(F.col("score") >= threshold).select("_row.*")
