"""Operator 6: n-gram Jaccard join by PartEnum signatures.

Sets of equal size bands (each band reaches 1/similarity times as far as it begins) take part in two instances, their own
and the next. An instance knows how many elements two linked sets can differ in (k) and deals the feature domain to
first parts, so that in some part linked sets differ in one element at most; each first part has three sub-parts, and
each choice of two of them gives a signature. With k // 2 + 1 parts one such part is sure; where parts are so small that
some choices hold no element at all (which unlike sets would share), there are 2 m more, and a set leaves out the m of
its parts that hold fewest: of 2 m + 1 sure parts at least one is kept by both sets. Linked sets share at least one
signature; what shares one is compared exactly.

Inside the rows of one signature no pairs are enumerated; see components.bucket_components. Sketches settle most pairs
before any sets are put side by side.

Equal sets are one node, so copies cost nothing. Shingles are 64-bit fingerprints of three words.
Null or wordless texts have an empty set and link with nothing; texts of fewer words than ``n`` have one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .sets import distinct_sets, linked_components, packed_sets

#: ASCII white space; every other byte belongs to a word.
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of every n-word shingle of a block of texts, words split at ASCII white space, A-Z lowered."""
    data = _LOWER[data]
    starts, ends, first = common.word_spans(data, offsets, _WORD)
    words = common.Runs(data).hashes(starts, ends)
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - first[rows]
    print_ = np.zeros(len(words), np.uint64)
    size = np.minimum(counts, n)[rows]
    for k in range(n):
        at = np.minimum(np.arange(len(words)) + k, max(0, len(words) - 1))
        print_ = np.where(k < size, common.mix(print_ * np.uint64(0x2545F4914F6CDD1D) + words[at] + np.uint64(k + 1)), print_)
    begins = place + size <= counts[rows]
    return rows[begins], print_[begins]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every row, sorted within the row, and the offsets of the rows in them."""
    return distinct_sets(data, offsets, lambda d, o: word_shingles(d, o, n))


class Bands:
    """Size bands for a similarity of ``num / den``, and the greatest difference of linked sets in each instance."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * self.den // self.num + 1)

    def of(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def most(self, instance: int) -> int:
        """Linked sets have an overlap of num / den of their union: |A ^ B| <= (|A| + |B|) * (den - num) / (den + num)."""
        while len(self.low) <= instance + 1:
            self._grow(self.low[-1])
        top, below = self.low[instance + 1] - 1, self.low[instance] - 1
        return (top + below) * (self.den - self.num) // (self.den + self.num)


def parts_of(k: int, size: int) -> tuple[int, int]:
    """(first parts, how many of them a set leaves out) for a difference of k at most in sets of ``size`` elements or more."""
    sure = k // 2 + 1
    empty = 3 * sure * np.exp(-size * 2 / 3 / sure)
    spare = 0 if empty < 0.02 or sure < 12 else int(np.ceil(2 * empty)) + 1
    return sure + 2 * spare, spare


def signatures(prints: np.ndarray, bands: Bands) -> np.ndarray:
    """The distinct PartEnum signatures of one set."""
    out, band = [], bands.of(len(prints))
    for instance in (band, band + 1):
        k = bands.most(instance)
        if k == 0:
            out.append(common.mix(np.array([prints.sum(dtype=np.uint64) + np.uint64(instance)], np.uint64)))
            continue
        parts, spare = parts_of(k, bands.low[instance - 1] if instance else 1)
        spread = common.mix(prints + np.uint64(instance * 0x9E3779B97F4A7C15 % 2**64))
        cell = ((spread >> np.uint64(33)) % np.uint64(3 * parts)).astype(np.int64)
        sums = np.zeros(3 * parts, np.uint64)
        np.add.at(sums, cell, spread)
        sums = sums.reshape(parts, 3)
        # Leave one sub-part out each time; which part and which sub-part it is belongs to the signature.
        left = sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums
        name = np.arange(3 * parts, dtype=np.uint64).reshape(parts, 3) + np.uint64(instance << 40)
        found = common.mix(left + common.mix(name + np.uint64(1)))
        if spare:
            held = np.bincount(cell, minlength=3 * parts).reshape(parts, 3)
            fewest = held.sum(axis=1) - held.max(axis=1)  # elements of the smallest choice of two sub-parts
            found = found[np.sort(np.argsort(fewest, kind="stable")[spare:])]
        out.append(found.ravel())
    return np.unique(np.concatenate(out))


def _set_rows(n: int):
    """_row, digest of the set, its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            data, offsets = common.as_bytes(batch.column("text"))
            prints, ends = shingle_sets(data, offsets, n)
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mix(prints + np.uint64(salt)), dtype=np.uint64))) for salt in (0, 0x5851F42D4C957F2D)]
            digest = [(s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *map(pa.array, digest), pa.array(np.diff(ends).astype(np.int64))], ["_id", "d0", "d1", "n_shingles"])

    return run


def _signature_rows(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in common.blocks(batches):
            data, offsets = common.as_bytes(batch.column("text"))
            prints, ends = shingle_sets(data, offsets, n)
            found = [signatures(prints[a:b], bands) if b > a else np.empty(0, np.uint64) for a, b in zip(ends[:-1], ends[1:])]
            counts = np.array([len(x) for x in found], np.int64)
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(ids, counts))], ["signature", "_id"])

    return run


def similar_sets(texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, component) of the rows of ``texts`` (_id, text; sets all different) with at least one link."""
    signed = texts.mapInArrow(common.tidied(_signature_rows(n, num, den)), "signature long, _id long")
    by = Window.partitionBy("signature")
    shared = signed.withColumn("x", F.min("_id").over(by)).withColumn("y", F.max("_id").over(by)).where("x <> y")
    shared = common.materialize(shared.select("signature", F.col("_id").alias("node")), "shared")
    # The sets of those that share a signature with anything.
    wanted = shared.select(F.col("node").alias("_id")).distinct()
    sets = packed_sets(texts.join(common.maybe_broadcast(wanted), "_id", "left_semi"), lambda d, o: word_shingles(d, o, n))
    sets = common.materialize(sets, "sets")
    common.collect_garbage(texts.sparkSession)
    return linked_components(shared, sets, num, den)


def join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id): each row of ``docs`` with the smallest key that links lead to.

    Two rows link when den * |intersection| >= num * |union| of their sets of distinct n-word shingles.
    Keys are integers. Rows that repeat a key are one document: what links with one of them links with all.
    Rows with a null key link with nothing that has a key; their component is that of equal sets, or null.
    """
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("text"))
    sets = common.materialize(texts.mapInArrow(common.tidied(_set_rows(n)), "_id long, d0 long, d1 long, n_shingles long"), "digests")
    filled = sets.where("n_shingles > 0")
    # One node for each distinct set, so that copies meet no signature.
    kinds = common.materialize(filled.where("_id is not null").groupBy("d0", "d1", "n_shingles").agg(F.min("_id").alias("rep")), "kinds")
    chosen = texts.join(common.maybe_broadcast(kinds.select(F.col("rep").alias("_id")).distinct()), "_id", "left_semi")
    linked = similar_sets(chosen, n, num, den)
    rows = filled.join(kinds, ["d0", "d1", "n_shingles"], "left").select("_id", "n_shingles", "rep")
    rows = rows.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    bare = sets.where("n_shingles = 0").select("_id", "n_shingles", F.col("_id").alias("component_id"))
    return rows.unionByName(bare).withColumnRenamed("_id", key)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"), n=3, num=90, den=100)


#: Every two documents that share a shingle are compared, and links followed to their ends.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS shingle FROM d, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS node, doc_id AS top FROM d UNION SELECT e.b, top FROM r JOIN e ON e.a = r.node),
t AS (SELECT node, min(top) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN t ON t.node = d.doc_id
"""
