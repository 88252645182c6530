"""Operator 8: quality classifier on supervised subword embeddings.

Words and character n-grams are hashed to rows of a table of learned vectors; the vectors of a text are averaged and a
softmax over two classes follows, all trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows. Averaging and the output are linear, so scoring folds both into one number for each hash row, and a text needs one
look-up for each word and n-gram of its whole length.

Null and empty texts have no feature: their score is that of the bias alone. Without any labelled row all scores are 0.5.
Texts of any length are scored whole; rows that repeat a key are scored each; other columns are left out; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .langid import bounded_sample, spread

#: Hash rows (a power of two), numbers in a vector, character n-gram lengths, labelled rows that training uses at most
#: and the windows of each, of so many bytes, spread over its whole text.
BUCKETS, DIMENSIONS, GRAMS, SAMPLE_ROWS, WINDOWS, WINDOW = 1 << 17, 12, (3, 4), 3_000, 8, 256
_SPACE = np.ones(256, bool)
_SPACE[[32, *range(9, 14)]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hash rows) of the words, of their neighbours two by two, and of the character n-grams of each text of a block."""
    runs = common.Runs(data)
    starts, ends, first = common.word_spans(data, offsets, _SPACE)
    words = runs.hashes(starts, ends)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    yield rows, (common.mix(words + np.uint64(1)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    same = rows[1:] == rows[:-1]
    pairs = common.mix(words[:-1] * np.uint64(31) + words[1:])[same]
    yield rows[:-1][same], (pairs & np.uint64(BUCKETS - 1)).astype(np.int64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in GRAMS:
        grams = (runs.windows(n) + np.uint64(n)) & np.uint64(BUCKETS - 1)
        inside = of[: len(grams)] == of[n - 1 : n - 1 + len(grams)]
        yield of[: len(grams)][inside], grams[inside].astype(np.int64)


class SubwordModel:
    """Vectors of the hash rows, output weights and bias of two classes."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.vectors = r.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.out, self.bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 12, rate: float = 0.4, seed: int = 3) -> None:
        rows, hashes, counts = [], [], []
        for a in range(0, len(texts), 128):  # a few texts at a time: only distinct features are kept
            part = texts[a : a + 128]
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in part]))).astype(np.int64)
            keys = np.concatenate([r * BUCKETS + h for r, h in features(np.frombuffer(b"".join(part), np.uint8), offsets)])
            keys, count = np.unique(keys, return_counts=True)
            rows.append((keys // BUCKETS + a).astype(np.int32))
            hashes.append((keys % BUCKETS).astype(np.int32))
            counts.append(count.astype(np.float32))
        rows, hashes, counts = np.concatenate(rows), np.concatenate(hashes), np.concatenate(counts)
        bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
        totals = np.bincount(rows, counts, len(texts))
        del rows
        share = np.bincount(labels, minlength=2) / len(labels)
        balance = 1 / np.maximum(2 * share, 1e-6)
        epochs = max(epochs, -(-6_000 // len(texts)))
        r, steps, done = np.random.default_rng(seed), epochs * len(texts), 0
        for _ in range(epochs):
            for k in r.permutation(len(texts)):
                a, b, pace = bounds[k], bounds[k + 1], rate * (1 - done / steps)
                done += 1
                weight = (counts[a:b] / max(totals[k], 1)).astype(np.float32)
                hidden = weight @ self.vectors[hashes[a:b]]
                z = hidden @ self.out + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[k]] -= 1
                d = (p * min(balance[labels[k]], 5.0)).astype(np.float32)
                back = self.out @ d
                self.out -= pace * np.outer(hidden, d)
                self.bias -= 0.1 * pace * d
                self.vectors[hashes[a:b]] -= np.float32(pace * 8) * np.outer(weight, back)

    def folded(self) -> tuple[np.ndarray, float]:
        """What each hash row adds to the log odds of label 1, and the bias of it."""
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> SubwordModel | None:
    """A model of label 1 against 0 from at most ``rows`` rows of ``labelled``; null labels are left out, null texts are empty."""
    use = labelled.where(F.col(label).isin(0, 1)).select(key, text, label)
    cut = bounded_sample(use, key, rows).select(key, label, spread(key, F.coalesce(F.col(text), F.lit("")).cast("binary"), WINDOW, WINDOWS).alias("bytes"))
    found = sorted(cut.orderBy(F.xxhash64(key), key, label, "bytes").limit(rows).collect(), key=lambda r: (str(r[0]), r[1], bytes(r[2])))
    if not found:
        return None
    model = SubwordModel()
    model.train([bytes(r[2]) for r in found], np.array([int(r[1]) for r in found]))
    return model


def score(docs: DataFrame, model: SubwordModel | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score): how likely label 1 is for each whole text."""
    table, bias = model.folded() if model else (np.zeros(BUCKETS), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            data, offsets = common.as_bytes(batch.column("text"))
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for rows, hashes in features(data, offsets):
                total += np.bincount(rows, table[hashes], batch.num_rows)
                count += np.bincount(rows, minlength=batch.num_rows)
            odds = np.clip(total / np.maximum(count, 1) + bias, -50, 50)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(1 / (1 + np.exp(-odds)))], [key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(common.tidied(run), f"{key} {kind}, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality").where(common.crc_bucket() != 1)
    # Which rows train is settled before texts are read: keys only, bounded by SAMPLE_ROWS.
    chosen = bounded_sample(labels.where(F.col("quality").isin(0, 1)), "doc_id", SAMPLE_ROWS)
    scored = score(docs, fit(docs.join(F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE_ROWS)), "doc_id")))
    return scored.select("doc_id", (common.crc_bucket() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
