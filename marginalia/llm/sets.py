"""Sets of 64-bit fingerprints, packed in rows: their sketches, and the components of those that link within buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import SKETCH, WORDS, bucket_components

#: Gives (row, fingerprint) of the elements of each text of a block (bytes, offsets); elements may repeat.
Shingler = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Bytes of texts whose elements a worker holds at once.
TEXT_BYTES = 400_000


def distinct_sets(data: np.ndarray, offsets: np.ndarray, shingler: Shingler) -> tuple[np.ndarray, np.ndarray]:
    """The distinct elements of every row, sorted within the row, and the offsets of the rows in them."""
    rows, prints = shingler(data, offsets)
    order = np.lexsort((prints, rows))
    rows, prints = rows[order], prints[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (prints[1:] != prints[:-1])
    rows, prints = rows[new], prints[new]
    return prints, np.searchsorted(rows, np.arange(len(offsets)))


def packed_sets(texts: DataFrame, shingler: Shingler, packed: bool = True) -> DataFrame:
    """(_id, size, p0 ..., prints) of ``texts`` (_id, text): each set as bytes, its size, and for each of 512 groups of elements whether it has an odd number of them.

    Without ``packed``, text stands in the place of prints: an eighth of the bytes where every character begins an element.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            data, offsets = common.as_bytes(batch.column("text"))
            prints, ends = distinct_sets(data, offsets, shingler)
            sizes = np.diff(ends)
            rows, group = np.repeat(np.arange(len(sizes)), sizes), (prints >> np.uint64(7)) % np.uint64(64 * WORDS)
            words = np.zeros(len(sizes) * WORDS, np.uint64)
            np.bitwise_xor.at(words, rows * WORDS + (group >> np.uint64(6)).astype(np.int64), np.uint64(1) << (group & np.uint64(63)))
            words = words.view(np.int64).reshape(len(sizes), WORDS)
            out = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends * 8).astype(np.int32).tobytes()), pa.py_buffer(prints.tobytes())]) if packed else batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes.astype(np.int32)), *(pa.array(np.ascontiguousarray(words[:, j])) for j in range(WORDS)), out], ["_id", "size", *SKETCH, body])

    body = "prints" if packed else "text"
    return texts.select("_id", "text").mapInArrow(common.tidied(run), "_id long, size int, " + ", ".join(f"{p} long" for p in SKETCH) + f", {body} {'binary' if packed else 'string'}")


def _unpacked(column: pa.Array, shingler: Shingler | None) -> tuple[np.ndarray, np.ndarray]:
    """The elements of the sets of a column, and the offsets of the rows in them; with ``shingler``, the column holds texts."""
    data, offsets = common.as_bytes(column)
    return (np.frombuffer(data.tobytes(), np.uint64), offsets // 8) if shingler is None else distinct_sets(data, offsets, shingler)


def _elements(body: str, shingler: Shingler | None):
    """The sets as single elements, of which 32 bits are kept: elements that then look alike only make a bound weaker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches, body, common.BLOCK_BYTES if shingler is None else TEXT_BYTES):
            prints, ends = _unpacked(batch.column(body), shingler)
            ids, of = (np.repeat(batch.column(n).to_numpy(zero_copy_only=False), np.diff(ends)) for n in ("_id", "component"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(of), pa.array((prints >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["node", "component", "element"])

    return run


def _common(shingler: Shingler | None):
    """How many elements the sets of each pair have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches, "pa", common.BLOCK_BYTES if shingler is None else TEXT_BYTES):
            (x, x_ends), (y, y_ends) = (_unpacked(batch.column(n), shingler) for n in ("pa", "pb"))
            rows, prints = np.concatenate([np.repeat(np.arange(batch.num_rows), np.diff(e)) for e in (x_ends, y_ends)]), np.concatenate((x, y))
            order = np.lexsort((prints, rows))
            rows, prints = rows[order], prints[order]
            counts = np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (prints[1:] == prints[:-1])], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("a", "b", "sa", "sb")), pa.array(counts.astype(np.int32))], ["a", "b", "sa", "sb", "common"])

    return run


def linked_components(buckets: DataFrame, sets: DataFrame, num: int, den: int, shingler: Shingler | None = None) -> DataFrame:
    """(node, component) of ``buckets`` (signature, node) over ``sets`` (written to the shared folder) whose pairs have num / den of their elements in common.

    A node may stand for several sets: it links where one of them does. With ``shingler``, ``sets`` hold texts, not packed.
    """
    body = "prints" if shingler is None else "text"
    light = sets.select(F.col("_id").alias("node"), "size", *SKETCH)
    several = sets.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1")
    if not several.isEmpty():  # nothing is known of a node that stands for several sets
        flagged = light.join(several.select(F.col("_id").alias("node"), "n"), "node", "left")
        sets = common.materialize(sets.distinct(), "sets")
        light = flagged.select("node", *(F.when(F.col("n").isNull(), F.col(c)).alias(c) for c in ("size", *SKETCH))).distinct()

    a, b = (sets.select(F.col("_id").alias(x), F.col("size").alias(f"s{x}"), F.col(body).alias(f"p{x}")) for x in "ab")

    def links_of(pairs: DataFrame) -> DataFrame:
        # Only the sets that pairs name are put side by side.
        named = b.join(common.maybe_broadcast(pairs.select("b").distinct()), "b", "left_semi")
        both = common.maybe_broadcast(pairs).join(a, "a").join(named, "b").select("a", "b", "sa", "sb", "pa", "pb").mapInArrow(common.tidied(_common(shingler)), "a long, b long, sa int, sb int, common int")
        return both.where(F.col("common") * den >= num * (F.col("sa") + F.col("sb") - F.col("common")))

    def elements_of(nodes: DataFrame) -> DataFrame:
        named = common.maybe_broadcast(nodes.select(F.col("node").alias("_id"), "component"))
        return sets.select("_id", body).join(named, "_id").select("_id", "component", body).mapInArrow(common.tidied(_elements(body, shingler)), "node long, component long, element int")

    return bucket_components(buckets, light, links_of, elements_of, num, den)
