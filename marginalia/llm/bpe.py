"""Operator 9: byte-level BPE encoding and decoding.

A text is cut into overlapping chunks that are pre-tokenised apart from each other. Where the pre-token boundaries of
two neighbours meet again inside their overlap the chunks are stitched; the pieces between the stitches are encoded on
their own. A pre-token depends only on the text after its start, so after one common boundary both chunks agree.
Where an overlap holds no common boundary (a run of letters longer than the overlap), the neighbours are joined and
count as one piece. Decoding concatenates the bytes of the ids.

Null texts count as empty: no ids, empty bytes. Repeated rows and repeated ids stay separate rows; columns other than key
and text are left out, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Characters of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 65_536, 2_048
#: Pieces whose ids a task remembers; then it starts anew, as does every task.
REMEMBERED = 200_000

_vocabularies: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Ranks of a vocabulary file (one base64 token and its rank a line) and the merges they imply."""

    def __init__(self, raw: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        self.find = regex.compile(pattern).findall
        self.scan = regex.compile(pattern).finditer
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.ends = np.cumsum([0, *map(len, self.tokens)])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: the neighbours with the lowest rank are joined, the leftmost first, until none is left."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        if len(piece) > 64:
            return self._merge_long(piece)
        parts, rank, none = [piece[i : i + 1] for i in range(len(piece))], self.ranks.get, 1 << 60
        pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]  # only the pairs beside the joined part are new
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return tuple(self.ranks[x] for x in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap over a linked list, for pre-tokens of any length."""
        import heapq

        n, ranks = len(piece), self.ranks
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != middle or middle >= n or not alive[middle] or end[middle] != stop:
                continue
            alive[middle], end[i], after[i] = False, stop, after[middle]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(piece[a : end[b]])) is not None:
                    heapq.heappush(heap, (r, a, b, end[b]))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[piece] = self.merge(piece.encode())
            out += ids
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in one array, and where the bytes of each id start in it."""
        lengths = self.ends[ids + 1] - self.ends[ids]
        starts = np.concatenate(([0], np.cumsum(lengths)))
        where = np.arange(starts[-1]) + np.repeat(self.ends[ids] - starts[:-1], lengths)
        return self.bytes[where], starts


def shipped(spark: SparkSession, path: str, pattern: str) -> Callable[[], Vocabulary]:
    """The vocabulary for use in tasks: the driver reads the file (a bounded one) and broadcasts its bytes, each worker builds it once."""
    with open(path, "rb") as file:
        raw = file.read()
    told, name = spark.sparkContext.broadcast(raw), hashlib.sha256(raw + pattern.encode()).hexdigest()

    def get() -> Vocabulary:
        if name not in _vocabularies:
            _vocabularies[name] = Vocabulary(told.value, pattern)
        return _vocabularies[name]

    return get


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts as overlapping chunks."""
    for batch in batches:
        for row, text in zip(batch.column("_row").to_pylist(), batch.column("_text")):
            text = text.as_py()
            for k, start in enumerate(range(0, len(text), CHUNK)):
                part = text[start : start + CHUNK + OVERLAP]
                yield pa.RecordBatch.from_pydict({"_row": [row], "chunk": [k], "body": [part], "last": [start + CHUNK >= len(text)]}, _CHUNKS)


_CHUNKS = pa.schema([("_row", pa.int64()), ("chunk", pa.int64()), ("body", pa.string()), ("last", pa.bool_())])


def _boundaries(vocabulary: Callable[[], Vocabulary]):
    """For each chunk the starts of pre-tokens in its head and in its tail, both as places in the overlap.

    The last pre-token of a cut chunk may go on after it, and the one before it may have stopped for the cut (white space
    looks one character ahead): starts up to that of the last one hold, those after it don't. The start of a chunk is a
    start of a pre-token only if the chunk before says so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary()
        for batch in batches:
            heads, tails = [], []
            for body, last in zip(batch.column("body").to_pylist(), batch.column("last").to_pylist()):
                starts = [m.start() for m in words.scan(body)]
                heads.append([x for x in starts if x < OVERLAP])
                tails.append([] if last else [x - CHUNK for x in starts if x >= CHUNK])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], [*batch.schema.names, "head", "tail"])

    return run


def pieces(texts: DataFrame, vocabulary: Callable[[], Vocabulary]) -> DataFrame:
    """(_row, piece, body): texts (_row, _text) cut where pre-tokens surely begin."""
    chunks = texts.repartition("_row").mapInArrow(common.tidied(_cut), "_row long, chunk long, body string, last boolean")
    seen = common.materialize(chunks.repartition("_row", "chunk").mapInArrow(common.tidied(_boundaries(vocabulary)), "_row long, chunk long, body string, last boolean, head array<int>, tail array<int>"), "chunks")
    order = Window.partitionBy("_row").orderBy("chunk")
    meets = F.array_min(F.array_intersect(F.col("tail"), F.lead("head").over(order)))
    stitched = seen.select("_row", "chunk", "last", meets.alias("stitch")).withColumn("came", F.lag("stitch").over(order))
    opens = F.when((F.col("chunk") == 0) | F.col("came").isNotNull(), 1).otherwise(0)
    stitched = stitched.withColumn("piece", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A chunk gives what stands from its own stitch to that of the next one; unstitched neighbours follow on directly.
    first, end = F.coalesce("came", F.lit(0)), F.when(F.col("last"), F.length("body")).otherwise(CHUNK + F.coalesce("stitch", F.lit(0)))
    parts = seen.drop("head", "tail", "last").join(stitched, ["_row", "chunk"]).select("_row", "piece", "chunk", F.substring("body", first + 1, end - first).alias("body"))
    one = parts.groupBy("_row", "piece").agg(F.array_sort(F.collect_list(F.struct("chunk", "body"))).alias("parts"))
    return one.select("_row", "piece", F.array_join(F.col("parts.body"), "").alias("body"))


def _encoded(vocabulary: Callable[[], Vocabulary], column: str, decoded: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary()
        for batch in common.blocks(batches, column):
            ends, flat = [0], []
            for text in batch.column(column).to_pylist():
                flat += words.encode(text or "")
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            kept = [n for n in batch.schema.names if n != column]
            more = [_bytes_of(words, ids)] if decoded else []
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), ids, *more], [*kept, "ids", *["decoded"] * decoded])
        words.known.clear()  # a worker that goes on to other stages keeps the vocabulary only

    return run


def _bytes_of(words: Vocabulary, ids: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids, concatenated."""
    data, starts = words.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    places = starts[ends.astype(np.int64)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data.tobytes())])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", long_text: int = CHUNK, decoded: bool = False) -> DataFrame:
    """(key, ids array<int>): each row of ``docs`` with the ids of its whole text; with ``decoded``, also the bytes that
    decoding those ids gives, in the same pass of the same worker."""
    both = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind, vocabulary = both.schema[key].dataType.simpleString(), shipped(docs.sparkSession, path, pattern)
    fields = f"{key} {kind}, ids array<int>" + ", decoded binary" * decoded
    short = both.where(F.length("_text") <= long_text).mapInArrow(common.tidied(_encoded(vocabulary, "_text", decoded)), fields)
    long = both.where(F.length("_text") > long_text)
    if long.isEmpty():
        return short
    # Rows get a number of their own, written down once: ids may repeat.
    long = common.materialize(long.withColumn("_row", F.monotonically_increasing_id()), "long")
    coded = pieces(long.select("_row", "_text"), vocabulary).repartition("_row", "piece").mapInArrow(common.tidied(_encoded(vocabulary, "body")), "_row long, piece long, ids array<int>")
    whole = coded.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    whole = whole.select("_row", F.flatten(F.col("p.ids")).alias("ids"))
    joined = long.select("_row", key).join(whole, "_row").select(key, "ids")
    return short.unionByName(decode(joined, path, pattern) if decoded else joined)


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``coded`` with ``decoded binary``: the bytes of ``ids``, concatenated."""
    vocabulary = shipped(coded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, _bytes_of(words, part.column("ids"))], [*part.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(common.tidied(run), f"{kinds}, decoded binary")


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows, and the columns named."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = default_vocabulary()
    return digests(encode(common.table(spark, sf_dir, "documents"), path, pattern, decoded=True))
