"""Operator 3: fuzzy line dedup by MinHash.

Lines are cut into the shingles of ``SHINGLE`` characters that begin at every character (a shorter line is one shingle),
so that an edit moves no other shingle. One permutation of the shingle hashes is dealt to ``BANDS * ROWS`` bins, the
least hash of each bin is the signature, and an empty bin borrows from the next one that has any. Lines that agree in a
band are candidates; their Jaccard similarity over all shingles is then computed exactly, and linked lines are joined to
components. Of each component (and of each repeated line) the first occurrence by (key, line) stays.

Lines are split, hashed, grouped and joined by DataFrame operations. Shingles and signatures are made in Arrow batches:
with DataFrame functions alone every character becomes a row, which is beyond the limits (figures in the README).

Lines are separated by a newline and compared without white space (``BLANKS``) at either end, so files with either kind of line
ends meet. Blank lines are left alone. Null texts
stay null, empty texts stay empty, a line may be as long as a text. Rows that repeat a key with the same text are one
document and keep the same lines. Columns named n_lines and n_kept are replaced, any others kept whatever their names.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .sets import linked_components, packed_sets

#: Characters of a shingle; common shingles of linked lines, as a share (80 of 100); bands and their rows (0.8 ** 3 in each of 8 bands: 99.7 % of pairs at 0.8 become candidates).
SHINGLE, BANDS, ROWS = 12, 8, 3
SIMILARITY = (80, 100)
#: White space that lines are compared without, at either end.
BLANKS = " \t\r\v\f"
#: Bytes of lines that are signed at once: a worker holds about a hundred bytes for each.
LINE_BYTES = 400_000
_BAND_COLUMNS = [f"b{j}" for j in range(BANDS)]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the shingle at each character of the lines of a block; a shorter line is one shingle."""
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(chars, offsets)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    size = np.minimum(counts, SHINGLE)[row]
    at = np.flatnonzero(np.arange(len(chars)) + size <= first[1:][row])
    ends = np.append(chars, len(data))
    return row[at], common.Runs(data).hashes(chars[at], ends[at + size[at]])


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(lines, BANDS): a hash for each band of each line of a block."""
    row, prints = shingles(data, offsets)
    lines, bins, none = len(offsets) - 1, BANDS * ROWS, np.uint64(1 << 32)
    least = np.full(lines * bins, none)
    np.minimum.at(least, row * bins + (prints % np.uint64(bins)).astype(np.int64), prints >> np.uint64(32))
    least = least.reshape(lines, bins)
    full = least.copy()
    for d in range(1, bins):  # an empty bin takes the value of the next one that has any, told apart by the distance
        empty = full == none
        if not empty.any():
            break
        lent = np.roll(least, -d, axis=1)
        full = np.where(empty & (lent != none), lent + np.uint64(d << 33), full)
    out = np.empty((lines, BANDS), np.uint64)
    for b in range(BANDS):
        out[:, b] = np.uint64(b)
        for r in range(ROWS):
            out[:, b] = common.mix(out[:, b] * np.uint64(0x2545F4914F6CDD1D) + full[:, b * ROWS + r])
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines without their text, but with 32 bits of their bands: lines that then meet by chance are told apart by their shingles."""
    for batch in common.blocks(batches, "line", LINE_BYTES):
        bands = (signatures(*common.as_bytes(batch.column("line"))) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        kept = [n for n in batch.schema.names if n != "line"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(np.ascontiguousarray(bands[:, b])) for b in range(BANDS))], [*kept, *_BAND_COLUMNS])


def _lines(docs: DataFrame, key: str) -> DataFrame:
    """(key, print, at, line, h1, h2) of every line that isn't blank."""
    rows = docs.where(F.col("text").isNotNull()).select(F.col(key), F.xxhash64("text").alias("print"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.trim(F.col("line"), F.lit(BLANKS))).where("line <> ''")
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def repeated(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, print, drop array<int>): for each document the places of the lines that repeat an earlier line."""
    lines = _lines(docs.select(key, "text"), key)
    fields = f"_key {docs.schema[key].dataType.simpleString()}, print long, at int, h1 long, h2 long, " + ", ".join(f"{b} int" for b in _BAND_COLUMNS)
    signed = lines.select(F.col(key).alias("_key"), "print", "at", "h1", "h2", "line").mapInArrow(common.tidied(_signed), fields)
    occurrences = common.materialize(signed.withColumnRenamed("_key", key), "lines")
    kinds = occurrences.groupBy("h1", "h2").agg(F.count("*").alias("n"), *(F.min(b).alias(b) for b in _BAND_COLUMNS))
    kinds = common.materialize(kinds.withColumn("node", F.monotonically_increasing_id()), "kinds")
    common.collect_garbage(docs.sparkSession)
    apart = [F.lit(j << 32) + F.col(b).cast("long") for j, b in enumerate(_BAND_COLUMNS)]
    banded = kinds.select("node", F.explode(F.array(*apart)).alias("signature"))
    shared = banded.groupBy("signature").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("signature")
    buckets = common.materialize(banded.join(common.maybe_broadcast(common.materialize(shared, "signatures")), "signature").select("signature", "node"), "buckets")
    wanted = common.materialize(kinds.select("node", "h1", "h2").join(buckets.select("node").distinct(), "node"), "wanted")
    texts = lines.select("h1", "h2", "line").join(common.maybe_broadcast(wanted), ["h1", "h2"]).groupBy("node").agg(F.max("line").alias("text"))
    sets = common.materialize(packed_sets(texts.withColumnRenamed("node", "_id"), shingles, packed=False), "sets")
    common.collect_garbage(docs.sparkSession)
    components = linked_components(buckets, sets, *SIMILARITY, shingles)
    # Lines that stand several times or have a component; a line without one is a component of its own.
    named = kinds.select("node", "h1", "h2", "n").join(components, "node", "left").where("n > 1 OR component IS NOT NULL")
    groups = common.materialize(named.select("h1", "h2", F.coalesce("component", "node").alias("component")), "groups")
    common.discard(kinds, buckets, sets, wanted)
    met = occurrences.select(key, "print", "at", "h1", "h2").join(common.maybe_broadcast(groups), ["h1", "h2"]).select(key, "print", "at", "component")
    met = common.materialize(met, "met")
    common.discard(occurrences, groups)
    place = F.struct(F.col(key).isNotNull().alias("given"), key, "print", "at")
    firsts = met.groupBy("component").agg(F.min(place).alias("first"))
    late = met.join(common.maybe_broadcast(firsts), "component").where(place != F.col("first"))
    return late.groupBy(key, "print").agg(F.array_sort(F.collect_set("at")).alias("drop"))


def dedup(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the lines of ``text`` that stay, and n_lines and n_kept (null for null texts; columns of these names are replaced)."""
    late = repeated(docs, key).select(F.col(key).alias("_ld_key"), F.col("print").alias("_ld_print"), F.col("drop").alias("_ld_drop"))
    late = common.maybe_broadcast(common.materialize(late, "late"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    rows = docs.select(columns).join(late, F.col(key).eqNullSafe(F.col("_ld_key")) & (F.xxhash64("text") == F.col("_ld_print")), "left")
    every = F.split("text", "\n")
    kept = F.when(F.col("_ld_drop").isNull(), every).otherwise(F.filter(every, lambda x, i: ~F.array_contains(F.col("_ld_drop"), i)))
    rows = rows.withColumn("_ld_kept", kept).withColumn("_ld_n", F.size(every).cast("long"))
    text, given = F.array_join("_ld_kept", "\n"), F.col("text").isNotNull()
    counted = [F.when(given, x).alias(n) for n, x in (("n_lines", F.col("_ld_n")), ("n_kept", F.size("_ld_kept").cast("long")))]
    return rows.select(*(F.when(given, text).alias(c) if c == "text" else F.col(c) for c in columns), *counted)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_kept", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
