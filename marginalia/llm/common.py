"""What the training-data operators share: tables, shared scratch space, blocks of text as bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import collect_garbage, discard, materialize, maybe_broadcast, within  # noqa: F401  (the operators take them from here)

#: Bytes of text that a numpy block holds at most (one longer document makes its own block).
BLOCK_BYTES = 750_000
#: Bytes of an Arrow batch between an executor and its workers.
BATCH_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(column: str = "doc_id", buckets: int = 3):
    """crc32 of the id as text, modulo ``buckets``; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte array and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that each holds about ``limit`` bytes of ``column``."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        if not len(lengths):
            continue
        group = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def small_batches() -> None:
    """Bounds the Arrow batches of the session by bytes, unless it does so itself: by rows alone, ten thousand texts are one batch,
    which the executor and the worker each hold, several times over while it grows."""
    spark, bound = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and bound not in _own_settings(spark):
        spark.conf.set(bound, str(BATCH_BYTES))


def _own_settings(spark: SparkSession) -> dict[str, str]:
    """The settings that the cluster or its user made before the first operator ran."""
    return dict(spark.sparkContext.getConf().getAll())


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after whose last batch a worker gives the memory that it needs no more back to the system: Spark keeps workers for later stages."""
    small_batches()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call, nothing is given back
            ctypes.CDLL(None).malloc_trim(0)

    return whole


# ---- 64-bit hashes of byte runs, for a whole block at once ----

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit word over the whole word (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Runs:
    """Hashes of any byte run of a block by prefix sums: equal runs have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.up, self.down = _power(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * self.up[: self.n], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every run of ``width`` bytes, by its start."""
        n = max(0, self.n - width + 1)
        return mix((self.sums[width : width + n] - self.sums[:n]) * self.down[:n])


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each row the index of its first word (with the total at the end)."""
    inside = is_word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    before[full], after[last] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)
