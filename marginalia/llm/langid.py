"""Operator 10: language ID by a byte convolutional network.

Filters of several widths run over embedded bytes, their maxima over a fixed-length window feed a softmax. The network
is trained in numpy on a bounded sample of labelled rows and applied to all windows of every text; the window
probabilities of a text are averaged, weighted by the bytes each window holds.

Null texts and texts without a letter are ``und`` with score 0. Empty training data gives ``und`` for all. Texts of any
length are read whole, repeated rows give equal rows, an empty table an empty one. Columns named lang_pred and score are
replaced; all others are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a window; labelled rows that training uses at most, and the windows of each, spread over its whole text.
WINDOW, SAMPLE_ROWS, SAMPLE_WINDOWS = 256, 3_000, 4
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4), 16, 8
#: Steps of training at least, however few the windows are.
LEAST_STEPS = 800
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class ByteNetwork:
    """Byte embedding, filters of several widths with ReLU and max pooling, softmax."""

    def __init__(self, classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embedding = r.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)
        self.embedding[0] = 0  # the byte that fills up short windows
        self.filters = [r.normal(0, (w * EMBEDDED) ** -0.5, (w * EMBEDDED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]

    def _patches(self, x: np.ndarray, width: int) -> np.ndarray:
        """(windows, places, width * EMBEDDED) views of embedded windows; neighbouring bytes are neighbours in memory."""
        n, length, e = x.shape
        return np.lib.stride_tricks.as_strided(x, (n, length - width + 1, width * e), x.strides, writeable=False)

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, list]:
        x, pooled, kept = self.embedding[_LOWER[windows]], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            values = self._patches(x, w) @ f
            best = values.max(axis=1)
            pooled.append(np.maximum(best + b, 0))
            kept.append(values)
        features = np.concatenate(pooled, axis=1)
        logits = features @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), [x, kept, features]

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.003, seed: int = 11) -> None:
        """Adam on the cross entropy; classes count alike."""
        r, state, step = np.random.default_rng(seed), [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights()], 0
        share = np.bincount(labels, minlength=len(self.out_bias)) / len(labels)
        balance = (1 / np.maximum(share, 1e-6) / len(share)).astype(np.float32)
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(windows)))):
            order = r.permutation(len(windows))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                x, y = windows[pick], labels[pick]
                p, (embedded, kept, features) = self.forward(x)
                p[np.arange(len(y)), y] -= 1
                d = p * balance[y][:, None] / len(y)
                grads_out, grads_bias = features.T @ d, d.sum(axis=0)
                d = (d @ self.out.T) * (features > 0)
                d_embedding, d_filters, d_biases = np.zeros_like(self.embedding), [], []
                for k, w in enumerate(WIDTHS):
                    part = d[:, k * FILTERS : (k + 1) * FILTERS]
                    at = kept[k].argmax(axis=1)
                    rows = np.repeat(np.arange(len(y)), FILTERS)
                    patch = self._patches(embedded, w)[rows, at.ravel()].reshape(len(y), FILTERS, -1)
                    d_filters.append(np.einsum("nf,nfd->df", part, patch))
                    d_biases.append(part.sum(axis=0))
                    back = (part[:, :, None] * self.filters[k].T[None]).reshape(len(rows), w, EMBEDDED)
                    for j in range(w):
                        np.add.at(d_embedding, _LOWER[x[rows, at.ravel() + j]], back[:, j])
                d_embedding[0] = 0
                step += 1
                for weight, grad, (m, v) in zip(self.weights(), [d_embedding, *d_filters, *d_biases, grads_out, grads_bias], state):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Class probabilities of each row of a block, over all of its windows."""
        lengths = np.diff(offsets)
        counts = -(-lengths // WINDOW)
        rows = np.repeat(np.arange(len(lengths)), counts)
        first = np.cumsum(counts) - counts
        starts = offsets[:-1][rows] + (np.arange(len(rows)) - first[rows]) * WINDOW
        held = np.minimum(WINDOW, offsets[1:][rows] - starts)
        total = np.zeros((len(lengths), len(self.out_bias)))
        for a in range(0, len(rows), 512):
            p, _ = self.forward(_windows(data, starts[a : a + 512], held[a : a + 512]))
            np.add.at(total, rows[a : a + 512], p * held[a : a + 512, None])
        return total / np.maximum(lengths, 1)[:, None]


def _windows(data: np.ndarray, starts: np.ndarray, held: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(np.arange(WINDOW) < held[:, None], data[np.minimum(at, len(data) - 1)], 0)


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of the smallest key hashes: only keys are sorted, and the chosen ones are ``most`` at most."""
    chosen = rows.select(key).distinct().orderBy(F.xxhash64(key), key).limit(most)
    return rows.join(F.broadcast(chosen), key, "left_semi")


def spread(key: str, raw: Column, size: int, most: int) -> Column:
    """At most ``most`` windows of ``size`` bytes of a text, dealt by hash over all of it, in their order; a text of fewer is whole."""
    every = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(raw) - 1) / size).cast("int")))
    dealt = F.slice(F.array_sort(F.transform(every, lambda i: F.struct(F.xxhash64(F.col(key), i).alias("h"), i.alias("i")))), 1, most)
    chosen = F.transform(F.array_sort(F.transform(dealt, lambda x: x["i"])), lambda i: F.substring(raw, size * i + 1, F.lit(size)))
    return F.aggregate(chosen, F.lit(b""), lambda a, b: F.concat(a, b))


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> tuple[ByteNetwork | None, list[str]]:
    """A network trained on at most ``rows`` rows of ``labelled``; rows without text or label are left out."""
    use = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(key), F.col(text), F.col(label))
    cut = bounded_sample(use, key, rows).select(key, label, spread(key, F.col(text).cast("binary"), WINDOW, SAMPLE_WINDOWS).alias("bytes"))
    found = sorted(cut.orderBy(F.xxhash64(key), key, label, "bytes").limit(rows).collect(), key=lambda r: (str(r[0]), str(r[1]), bytes(r[2])))
    classes = sorted({str(r[1]) for r in found})
    if not classes:
        return None, []
    data = np.frombuffer(b"".join(bytes(r[2]) for r in found), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(r[2]) for r in found])))
    starts = np.concatenate([np.arange(a, b, WINDOW) for a, b in zip(offsets, offsets[1:])])
    of = np.concatenate([np.full(len(range(a, b, WINDOW)), k) for k, (a, b) in enumerate(zip(offsets, offsets[1:]))])
    held = np.minimum(WINDOW, offsets[of + 1] - starts)
    # Short windows teach short texts: every third window is cut to a part of it.
    held[::3] = np.maximum(1, held[::3] * (1 + np.arange(len(held[::3])) % 7) // 8)
    labels = np.array([classes.index(str(found[k][1])) for k in of])
    network = ByteNetwork(len(classes))
    network.train(_windows(data, starts, held), labels)
    return network, classes


def predict(docs: DataFrame, network: ByteNetwork | None, classes: list[str], text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score: the likeliest language of every whole text and its mean probability.

    Columns of these two names that ``docs`` has are replaced.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    given = "_text"
    while given in keep:
        given += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches, given):
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(given), r"\pL"), False).to_numpy(zero_copy_only=False)
            best, score = np.full(batch.num_rows, len(classes)), np.zeros(batch.num_rows)
            if network is not None:
                p = network.predict(*common.as_bytes(batch.column(given)))
                best[lettered], score[lettered] = p.argmax(axis=1)[lettered], p.max(axis=1)[lettered]
            names = np.array([*classes, "und"], object)[best]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))], [*keep, "lang_pred", "score"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col(text).cast("string").alias(given)).mapInArrow(common.tidied(run), f"{kinds}lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Languages of ``docs``, learned from the rows of it that are not held out."""
    network, classes = fit(docs.where(common.crc_bucket() != 1))
    return predict(docs, network, classes)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", (common.crc_bucket() == 1).alias("held_out"), "lang_pred", "score")
