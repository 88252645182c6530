"""Operator 1: removal of repeated byte strings by difference-cover suffix arrays.

Which strings can repeat is settled first, without loss. Every window of ``width`` bytes has an anchor, the run of
``ANCHOR`` bytes in it with the least hash (the first, where several have it); equal windows have equal anchors at equal
places. The starts of a text that share one anchor are a stretch of neighbours, and one number names the anchor bytes,
another the whole stretch with the bytes that its windows reach. Stretches are then brought together by anchor:

* an anchor that occurs once has no repeated window;
* stretches that are equal as a whole repeat in all their windows;
* what is left are anchors with unlike stretches. One text of each goes to the suffix array.

Suffix arrays are made for as many anchors at once as fit a block: triples of the suffixes at places 1 and 2 modulo 3
are sorted and named, the names are sorted by recursion until they cover a window, the remaining suffixes are ordered
by their first byte and the rank of what follows and merged in, and the prefixes of neighbours are compared.
An anchor with more than ``CROWD`` unlike stretches is not brought to one task: its windows are dealt by hash.

Texts are UTF-8 bytes, null counts as empty, matches never cross texts. Rows that repeat a key and its text are two
rows, and each repeats the other. A text may have any length; an empty table gives an empty one. Columns of ``docs`` are
kept; one named spans, _p, _key, _print, _word, _bits or _may is not allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of an anchor; stretches of an anchor that one task compares; bytes of a suffix array; bytes of a text at once.
ANCHOR, CROWD, ARRAY_BYTES, SLICE = 96, 4_096, 1_500_000, 4_000_000
#: Bytes of a block that suffix_ranks can take.
MOST_BYTES = (1 << 21) - 4
_PLACE = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` bytes the place of its anchor."""
    prints, span = common.Runs(data).windows(ANCHOR), width - ANCHOR + 1
    least = (prints & ~_PLACE) | np.arange(len(prints), dtype=np.uint64)
    have = 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & _PLACE).astype(np.int64)


def stretches(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, start, number of starts, anchor hash, stretch hash) of the stretches of a block."""
    if len(data) < width:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    runs = common.Runs(data)
    lengths = np.maximum(np.diff(offsets) - width + 1, 0)
    row = np.repeat(np.arange(len(lengths)), lengths)
    start = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(lengths) - lengths), lengths)
    at = anchors(data, width)[start]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    start, at, row = start[first], at[first], row[first]
    whole = runs.hashes(start, start + count + width - 1)
    return row, start - offsets[row], count, runs.hashes(at, at + ANCHOR), common.mix(whole + common.mix((at - start).astype(np.uint64)))


# ---- difference-cover suffix ranks of one block ----


def _named(s: np.ndarray, places: np.ndarray, count: int, bits: int) -> np.ndarray:
    """Ranks from 1 of the runs of ``count`` symbols at ``places``."""
    key = s[places].astype(np.uint64)
    for k in range(1, count):
        key = (key << np.uint64(bits)) | s[np.minimum(places + k, len(s) - 1)].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    names = np.empty(len(order), np.int64)
    names[order] = np.concatenate(([1], 1 + np.cumsum(key[1:] != key[:-1])))[: len(order)]
    return names


def _before(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(sorted_keys, keys, side="left")


def suffix_ranks(symbols: np.ndarray, depth: int, reach: int = 1, step: int = 1) -> np.ndarray:
    """Ranks of all suffixes of ``symbols`` (1 at least each) by their first ``depth`` bytes or more; equal ones rank alike.

    A symbol stands for ``reach`` bytes and begins ``step`` bytes after the one before it.
    """
    n = len(symbols)
    s = np.concatenate((symbols, np.zeros(3, np.int64)))
    bits = max(1, int(s.max()).bit_length())
    count = max(3, 63 // bits)
    if 3 * max(bits, (n + 3).bit_length()) > 63:
        raise ValueError("the block is too long")
    one, two, rest = (np.arange(k, n, 3) for k in (1, 2, 0))
    sampled = np.concatenate((one, two))
    names = _named(s, sampled, count, bits)
    covered = reach + (count - 1) * step
    if covered < depth and len(names) and names.max() < len(names):
        # The names of the places 1 modulo 3, an end, those of the places 2 modulo 3: a third shorter, three times as far apart.
        again = suffix_ranks(np.concatenate((names[: len(one)], np.zeros(1, np.int64), names[len(one) :])) + 1, depth, covered, 3 * step)
        names = np.concatenate((again[: len(one)], again[len(one) + 1 :]))
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = names
    wide = np.int64(int(rank.max()).bit_length())
    # One symbol and a rank compare places 0 with 1, two symbols and a rank places 0 with 2.
    one0, one1 = (s[rest] << wide) | rank[rest + 1], (s[one] << wide) | rank[one + 1]
    two0, two2 = (((s[x] << bits) | s[x + 1]) << wide | rank[x + 2] for x in (rest, two))
    sorted_one0, sorted_two0, sorted1, sorted2 = np.sort(one0), np.sort(two0), np.sort(rank[one]), np.sort(rank[two])
    out = np.empty(n, np.int64)
    out[rest] = _before(sorted_one0, one0) + _before(np.sort(one1), one0) + _before(np.sort(two2), two0)
    out[one] = _before(sorted1, rank[one]) + _before(sorted2, rank[one]) + _before(sorted_one0, one1)
    out[two] = _before(sorted1, rank[two]) + _before(sorted2, rank[two]) + _before(sorted_two0, two2)
    return out + 1


def repeated_starts(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of ``starts`` have a window of ``width`` bytes that another of them has as well."""
    order = starts[np.argsort(suffix_ranks(data.astype(np.int64) + 1, width)[starts], kind="stable")]
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(width):  # prefixes of neighbours, byte by byte while any are equal
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = data[order[live] + k] == data[order[live + 1] + k]
    found = np.zeros(len(data), bool)
    found[order[:-1][same]] = True
    found[order[1:][same]] = True
    return found[starts]


# ---- Spark ----


def _stretch_rows(key: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches):
            data, offsets = common.as_bytes(batch.column("text"))
            if len(data) > SLICE:  # slices that share all but one byte of a window; a block this long is one text, or nearly
                parts = []
                for r in range(batch.num_rows):
                    for a in range(int(offsets[r]), int(offsets[r + 1]), SLICE):
                        part = data[a : min(int(offsets[r + 1]), a + SLICE + width - 1)]
                        row, start, *more = stretches(part, np.array([0, len(part)]), width)
                        parts.append((row + r, start + a - offsets[r], *more))
                row, start, count, anchor, whole = (np.concatenate(x) for x in zip(*parts))
            else:
                row, start, count, anchor, whole = stretches(data, offsets, width)
            take = pa.array(row)
            for a in range(0, len(row), 50_000):
                z = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(take[z]), batch.column("print").take(take[z]), pa.array(start[z]), pa.array(count[z].astype(np.int32)), pa.array(anchor[z].view(np.int64)), pa.array(whole[z].view(np.int64))],
                    [key, "print", "start", "count", "anchor", "whole"],
                )

    return run


def _texts(key: str, width: int):
    """The bytes of the stretches that a row of texts is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "print", "start", "count", "anchor", "whole", "alone", "bytes"]
        for batch in common.blocks(batches):
            out: list[tuple] = []
            for k, p, text, wanted in zip(*(batch.column(n).to_pylist() for n in (key, "print", "text", "wanted"))):
                raw = (text or "").encode()
                out += [(k, p, w["start"], w["count"], w["anchor"], w["whole"], w["alone"], raw[w["start"] : w["start"] + w["count"] + width - 1]) for w in wanted]
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(key).type, pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names)

    return run


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _crowd(width: int) -> int:
    """Unlike stretches of one anchor that fit a block whatever they are; a stretch has 2 * width - ANCHOR bytes at most."""
    return min(CROWD, MOST_BYTES // (2 * width - ANCHOR))


def _sorted_blocks(key: str, width: int):
    """Stretches in order of their anchors; gives the repeated starts of those that stand alone.

    A block has whole anchors only, and several of them only within ``ARRAY_BYTES``.
    """

    def solve(rows: list[dict]) -> list[tuple]:
        unique = list({(r["anchor"], r["whole"]): r for r in rows}.values())
        data = np.frombuffer(b"".join(r["bytes"] for r in unique), np.uint8)
        ends = np.cumsum([0, *(len(r["bytes"]) for r in unique)])
        counts = np.array([r["count"] for r in unique])
        starts = np.concatenate([np.arange(a, a + c) for a, c in zip(ends, counts)])
        found, bounds, out = repeated_starts(data, starts, width), np.cumsum([0, *counts]), []
        for k, r in enumerate(unique):
            if r["alone"]:
                out += [(r[key], r["print"], r["start"] + a, b - a) for a, b in _intervals(found[bounds[k] : bounds[k + 1]])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # held: whole anchors, [0:last]; behind them the one that is being read, of ``own`` bytes.
        held, size, last, own, kind = [], 0, 0, 0, None
        for batch in batches:
            kind = batch.schema.field(key).type
            for r in batch.to_pylist():
                if held and held[-1]["anchor"] != r["anchor"]:
                    last, own = len(held), 0
                held.append(r)
                size, own = size + len(r["bytes"]), own + len(r["bytes"])
                if last and size > ARRAY_BYTES:
                    yield from _span_batch(solve(held[:last]), key, kind)
                    held, size, last = held[last:], own, 0
        if held:
            yield from _span_batch(solve(held), key, kind)

    return run


def _span_batch(rows: list[tuple], key: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.int32(), pa.int64(), pa.int32()))], [key, "print", "start", "count"])


def _dealt_windows(key: str, width: int):
    """Two hashes for each window of a stretch, and where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches, "bytes"):
            data, offsets = common.as_bytes(batch.column("bytes"))
            runs, counts = common.Runs(data), batch.column("count").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = offsets[row] + within
            half = width // 2
            w1, w2 = runs.hashes(at, at + width), common.mix(runs.hashes(at, at + half) * np.uint64(3) + runs.hashes(at + half, at + width))
            take = pa.array(row)
            start = batch.column("start").to_numpy(zero_copy_only=False)[row] + within
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(take), batch.column("print").take(take), pa.array(start), batch.column("alone").take(take), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], [key, "print", "start", "alone", "w1", "w2"]
            )

    return run


def _flagged(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame | None:
    """``rows`` with _may: whether their key may be among ``keys`` (_key); some that are not are flagged as well. None where the bits don't fit a broadcast.

    Bits of hashed keys, eight a key, in words of 64: so texts that nothing is joined to are not shuffled.
    """
    size = max(64, 8 * keys.count())
    word, bit = (lambda c, form=form: F.expr(form.format(f"pmod(xxhash64(`{c}`), {size}L)")) for form in ("{} div 64", "shiftleft(1L, cast({} % 64 as int))"))
    words = common.materialize(keys.select(word("_key").alias("_word"), bit("_key").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "words")
    if not common.within(words):
        return None
    flagged = rows.join(F.broadcast(words), word(key) == words["_word"], "left")
    return flagged.select(*rows.columns, F.coalesce(F.col("_bits").bitwiseAND(bit(key)) != 0, F.lit(False)).alias("_may"))


def repeated_windows(docs: DataFrame, width: int = 200, key: str = "doc_id", text: str = "text", held: list[DataFrame] | None = None) -> DataFrame:
    """(key, print, start, count): stretches of starts whose window of ``width`` bytes also starts elsewhere. print: 32-bit hash of the text.

    ``held`` gets the intermediate tables, which may be discarded once the result has been written.
    """
    if width <= ANCHOR:
        raise ValueError(f"windows are longer than {ANCHOR} bytes")
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key), F.hash(text).alias("print"), F.col(text).alias("text"))
    long = texts.where(F.octet_length("text") >= width)
    every = long.mapInArrow(common.tidied(_stretch_rows(key, width)), f"{key} {kind}, print int, start long, count int, anchor long, whole long")
    by = Window.partitionBy("anchor")
    met = every.withColumn("x", F.min("whole").over(by)).withColumn("y", F.max("whole").over(by)).withColumn("n", F.count("*").over(by)).where("n > 1")
    met = common.materialize(met.select(key, "print", "start", "count", "anchor", "whole", (F.col("x") == F.col("y")).alias("alike")), "stretches")
    common.collect_garbage(docs.sparkSession)
    alike = met.where("alike").select(key, "print", "start", "count")
    # Unlike stretches of one anchor: equal ones among them are settled, one text of each kind is compared.
    most, mixed = _crowd(width), met.where("not alike")
    kinds = mixed.groupBy("anchor", "whole").agg(F.count("*").alias("n"))
    kinds = common.materialize(kinds, "kinds")
    crowds = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("least = 1")
    crowds = common.materialize(crowds, "crowds")
    settled = mixed.join(kinds.where("n > 1").select("anchor", "whole"), ["anchor", "whole"]).select(key, "print", "start", "count")
    open_ = mixed.join(crowds.select("anchor", (F.col("kinds") > most).alias("crowd")), "anchor")
    one = open_.groupBy("anchor", "whole").agg(F.min(F.struct(F.col(key).isNotNull(), key, "print", "start", "count")).alias("p"), (F.count("*") == 1).alias("alone"), F.max("crowd").alias("crowd"))
    one = one.select(F.col(f"p.{key}").alias(key), "p.print", F.struct("p.start", "p.count", "anchor", "whole", "alone", "crowd").alias("w"))
    wanted = common.materialize(one.groupBy(key, "print").agg(F.collect_list("w").alias("wanted")), "wanted")
    if held is not None:
        held += [met, kinds, crowds, wanted]
    common.collect_garbage(docs.sparkSession)
    wanted = wanted.select(F.col(key).alias("_key"), F.col("print").alias("_print"), "wanted")
    if common.within(wanted):
        wanted = F.broadcast(wanted)
    elif (flagged := _flagged(long, wanted.select("_key"), key)) is not None:
        long = flagged.where("_may").drop("_may")
    cut = long.join(wanted, long[key].eqNullSafe(wanted["_key"]) & (long["print"] == wanted["_print"]))
    fields = f"{key} {kind}, print int, start long, count int, anchor long, whole long, alone boolean, bytes binary"
    unlike = lambda crowd: cut.withColumn("wanted", F.filter("wanted", lambda w: w["crowd"] if crowd else ~w["crowd"])).where(F.size("wanted") > 0).select(key, "print", "text", "wanted").mapInArrow(common.tidied(_texts(key, width)), fields)
    few = unlike(False).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(common.tidied(_sorted_blocks(key, width)), f"{key} {kind}, print int, start long, count int")
    found = alike.unionByName(settled).unionByName(few)
    if not crowds.where(F.col("kinds") > most).isEmpty():
        dealt = unlike(True).mapInArrow(common.tidied(_dealt_windows(key, width)), f"{key} {kind}, print int, start long, alone boolean, w1 long, w2 long")
        twice = dealt.distinct().withColumn("n", F.count("*").over(Window.partitionBy("w1", "w2"))).where("n > 1 and alone")
        found = found.unionByName(twice.select(key, "print", "start", F.lit(1).alias("count")))
    return found


def repeated_spans(docs: DataFrame, width: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (key, text) with ``spans``, the byte ranges [start, end) that repeated windows cover, sorted; they may touch or overlap; empty where none are."""
    held: list[DataFrame] = []
    found = repeated_windows(docs.select(F.col(key), F.col(text).alias("text")), width, key, held=held)
    spans = found.select(key, "print", F.struct(F.col("start").alias("start"), (F.col("start") + F.col("count") + width - 1).alias("end")).alias("s"))
    each = common.materialize(spans.groupBy(key, "print").agg(F.array_sort(F.collect_set("s")).alias("spans")), "spans")
    common.discard(*held)
    common.collect_garbage(docs.sparkSession)
    each = each.select(F.col(key).alias("_key"), F.col("print").alias("_print"), F.col("spans"))
    rows, none = docs.withColumn("_p", F.hash(text)), F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = lambda rows, each: rows.join(each, rows[key].eqNullSafe(each["_key"]) & (rows["_p"] == each["_print"]), "left").select(*docs.columns, F.coalesce("spans", none).alias("spans"))
    if common.within(each):
        return joined(rows, F.broadcast(each))
    flagged = _flagged(rows, each.select("_key"), key)
    if flagged is None:
        return joined(rows, each)
    return joined(flagged.where("_may"), each).unionByName(flagged.where("NOT _may").select(*docs.columns, none.alias("spans")))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.blocks(batches):
        out = []
        for doc_id, text, spans in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "spans"))):
            raw, digest, at, gone, runs, end = (text or "").encode(), hashlib.sha256(), 0, 0, 0, -1
            for s in spans:
                runs, end = runs + (s["start"] > end), max(end, s["end"])
                digest.update(raw[at : max(at, s["start"])])
                gone, at = gone + max(0, s["end"] - max(at, s["start"])), max(at, s["end"])
            digest.update(raw[at:])
            out.append((doc_id, len(raw), gone, runs, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_spans(docs, 200).mapInArrow(common.tidied(_removed), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
