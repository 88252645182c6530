"""Operator 13: BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is split at the added tokens of the tokenizer file, then into pre-tokens. A pre-token starts as one symbol for each
byte. The leaves of a segment tree hold, for each pair of neighbours that the file can merge, its rank and its place; every
node holds the least of its two children, so the root is the leftmost pair of the lowest rank. Merging it changes three
leaves (the pair itself, its left neighbour, and the pair that is gone), and each change climbs one path of the tree. So a
pre-token of n bytes takes n log n steps at most, however long it is. The trees of short pre-tokens stand side by side in one
array and are worked off together. Decoding concatenates the bytes of the ids.

Null texts count as empty: no ids, an empty text. A text is one row and is encoded whole by one task, with memory in proportion
to it. Repeated rows and repeated or null keys stay separate rows; columns other than key and text are left out, whatever their
names; an empty table gives an empty one. Ids that the file does not know, and null ids, decode to nothing. Files whose added tokens
strip or need word ends, or with a normalizer, are refused.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pre-tokens whose ids a task remembers before it starts anew (as does every task), and the characters of the longest one.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
#: Pre-tokens up to these bytes are merged many at a time, within these symbols of a round; longer ones one by one.
TOGETHER, ROUND_CELLS = 65, 1 << 19
#: The pre-tokens of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that the regular expressions of this machine already class as letters or numbers, while the
#: tokenizers library, of an earlier Unicode version, does not.
LATER = (
    "՘ ֋-֌ ࢏ ౜ ೜ ₏ ₝-₟ ꟎-꟏ ꟒ ꟔ ꟝ ꟢ ꟱ ꭬-꭭ "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb "
    "\U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 "
    "\U00016ebb-\U00016ed3 \U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 "
    "\U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 "
    "\U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de "
    "\U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff "
    "\U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
)
#: More than any rank and place of a pair: there is nothing to merge.
NONE = 1 << 62

_tokenizers: dict[str, "Tokenizer"] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level file: visible bytes for themselves, the others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def merged(symbols: list[int], pairs: dict[int, int], made: list[int], width: int) -> list[int]:
    """``symbols`` after all merges: the pair of lowest rank first, the leftmost of these, until no pair has a rank.

    ``pairs`` gives the rank of two neighbours a, b under ``a * width + b``, ``made`` the symbol that a rank makes.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    shift = (n - 2).bit_length()
    size, places = 1 << shift, (1 << shift) - 1
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = pairs.get(symbols[i] * width + symbols[i + 1])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := tree[1]) < NONE:
        at = best & places
        gone = after[at]
        end = after[gone]
        symbols[at], symbols[gone], after[at] = made[best >> shift], -1, end
        first = before[at]
        changed = [(gone, NONE)] if gone < n - 1 else []
        if end < n:
            before[end] = at
            rank = pairs.get(symbols[at] * width + symbols[end])
            changed.append((at, NONE if rank is None else rank << shift | at))
        else:
            changed.append((at, NONE))
        if first >= 0:
            rank = pairs.get(symbols[first] * width + symbols[at])
            changed.append((first, NONE if rank is None else rank << shift | first))
        for place, key in changed:
            k = size + place
            tree[k] = key
            while k > 1:
                a, b, k = tree[k], tree[k ^ 1], k >> 1
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least
    return [x for x in symbols if x >= 0]


def merged_all(symbols: np.ndarray, lengths: np.ndarray, ranks: Callable[[np.ndarray, np.ndarray], np.ndarray], made: np.ndarray) -> np.ndarray:
    """``merged`` for many short rows at once: row k holds ``lengths[k]`` symbols, then -1; what is merged away becomes -1.

    Every row has a segment tree of its own, all of one size, and each round merges at the roots of all open rows.
    """
    n, width = symbols.shape
    size = 1 << (width - 2).bit_length()
    shift = size.bit_length() - 1
    symbols = np.pad(symbols, ((0, 0), (0, size + 2 - width)), constant_values=-1)
    wide, nodes = size + 2, 2 * size
    place = np.arange(size)
    tree = np.full((n, nodes), NONE, np.int64)
    found = ranks(symbols[:, :size], symbols[:, 1 : size + 1])
    tree[:, size:] = np.where(found >= 0, found << shift | place, NONE)
    for level in range(shift - 1, -1, -1):
        below = tree[:, 2 << level : 4 << level]
        tree[:, 1 << level : 2 << level] = np.minimum(below[:, ::2], below[:, 1::2])
    # Beyond its last symbol a row's neighbours are the padding, whose symbol is -1 and has no pair.
    after = np.tile(np.minimum(np.arange(1, wide + 1), wide - 1), (n, 1))
    np.minimum(after, lengths[:, None], out=after)
    before = np.tile(np.arange(-1, wide - 1) % wide, (n, 1))
    flat, tree, after, before = symbols.reshape(-1), tree.reshape(-1), after.reshape(-1), before.reshape(-1)
    rows = np.arange(n)
    while len(rows):
        best = tree[rows * nodes + 1]
        rows, best = rows[best < NONE], best[best < NONE]
        at, here, root = best & (size - 1), rows * wide, rows * nodes
        gone = after[here + at]
        end = after[here + gone]
        flat[here + at], flat[here + gone] = made[best >> shift], -1
        after[here + at], before[here + end] = end, at
        first = before[here + at]
        right, left = ranks(flat[here + at], flat[here + end]), ranks(flat[here + first], flat[here + at])
        leaves = [root + size + np.where(gone < size, gone, at), root + size + at, root + size + np.where(first < size, first, at)]
        tree[leaves[0]] = NONE
        tree[leaves[2]] = np.where(left >= 0, left << shift | first, NONE)
        tree[leaves[1]] = np.where(right >= 0, right << shift | at, NONE)
        nodes_at = [x - root for x in leaves]
        for _ in range(shift):
            for k, x in enumerate(nodes_at):
                nodes_at[k] = x = x >> 1
                tree[root + x] = np.minimum(tree[root + 2 * x], tree[root + 2 * x + 1])
    return symbols


class Tokenizer:
    """Vocabulary, merges and added tokens of a byte-level BPE file (JSON)."""

    def __init__(self, raw: bytes):
        import regex

        file = json.loads(raw)
        model, added = file["model"], file.get("added_tokens") or []
        odd = [t["content"] for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
        kinds = (model["type"], (file.get("pre_tokenizer") or {}).get("type"), (file.get("decoder") or {}).get("type"))
        if odd or file.get("normalizer") or kinds != ("BPE", "ByteLevel", "ByteLevel") or file["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level BPE file: {kinds}, added tokens {odd}")
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        vocabulary = model["vocab"]
        self.first = [vocabulary[c] for c in letters]
        self.added = {t["content"]: t["id"] for t in added}
        self.width = max([*vocabulary.values(), *self.added.values()]) + 1
        self.tokens = [b""] * self.width
        for token, number in vocabulary.items():
            self.tokens[number] = bytes(map(value.__getitem__, token))
        for token, number in self.added.items():
            self.tokens[number] = token.encode()
        parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = {vocabulary[a] * self.width + vocabulary[b]: rank for rank, (a, b) in enumerate(parts)}
        self.made = [vocabulary[a + b] for a, b in parts]
        longest = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else None
        later = "".join(LATER.split())
        self.is_later = regex.compile(f"[{later}]").search
        self.find = regex.compile(PATTERN).findall
        strict = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^\\s[\\p{{L}}\\p{{N}}--[{later}]]]").replace(r"?\p{L}", f"?[\\p{{L}}--[{later}]]").replace(r"?\p{N}", f"?[\\p{{N}}--[{later}]]")
        self.find_strict = regex.compile(strict, regex.V1).findall
        self.sorted = np.array(sorted(self.pairs), np.int64)
        self.ranks = np.array([self.pairs[k] for k in self.sorted.tolist()], np.int64)
        self.first_of, self.made_of = np.array(self.first, np.int32), np.array(self.made, np.int32)
        self.known: dict[str, bytes] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols, -1 for pairs without one."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
        return np.where((self.sorted[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def merge(self, piece: str) -> bytes:
        """The ids of one pre-token, as 32-bit numbers."""
        return array("i", merged([self.first[b] for b in piece.encode()], self.pairs, self.made, self.width)).tobytes()

    def merge_all(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Pre-tokens with their ids as 32-bit numbers: short ones many at a time, by size of their trees."""
        classes: dict[int, list[str]] = {}
        for piece in pieces:
            n = len(piece.encode())
            classes.setdefault((n - 2).bit_length() if 2 < n <= TOGETHER else -1, []).append(piece)
        for kind, members in classes.items():
            if kind < 0:
                yield from ((piece, self.merge(piece)) for piece in members)
                continue
            width = (1 << kind) + 1
            for k in range(0, len(members), ROUND_CELLS // width):
                part = members[k : k + ROUND_CELLS // width]
                raw = [piece.encode() for piece in part]
                lengths = np.array([len(x) for x in raw])
                symbols = np.full((len(raw), width), -1, np.int32)
                symbols[np.arange(width) < lengths[:, None]] = self.first_of[np.frombuffer(b"".join(raw), np.uint8)]
                found = merged_all(symbols, lengths, self.rank_of, self.made_of)
                ids, ends = found[found >= 0].astype(np.int32).tobytes(), (4 * np.cumsum((found >= 0).sum(1))).tolist()
                yield from zip(part, (ids[a:b] for a, b in zip([0, *ends], ends)))

    def encode_all(self, texts: list[str]) -> tuple[array, array]:
        """The ids of all texts in one array, and where those of each text end."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        parts, find = [], self.find
        for text in texts:  # a text is a list of its stretches between added tokens, which stand at the odd places
            split = self.split(text) if self.split and any(t in text for t in self.added) else [text]
            parts.append([[part] if k % 2 else find(part) for k, part in enumerate(split)])
        fresh = set().union(*(pieces for part in parts for pieces in part[::2])) - self.known.keys()
        later = self.is_later("\n".join(fresh)) is not None
        if later:
            parts = [[pieces if k % 2 else self.find_strict("".join(pieces)) for k, pieces in enumerate(part)] for part in parts]
            fresh = set().union(*(pieces for part in parts for pieces in part[::2])) - self.known.keys()
        ids = dict(self.merge_all(list(fresh)))
        passing = {piece: x for piece, x in ids.items() if len(piece) > REMEMBERED_CHARS or later and self.is_later(piece)}
        self.known.update((piece, x) for piece, x in ids.items() if piece not in passing)
        look = self.known.__getitem__ if not passing else lambda piece: passing[piece] if piece in passing else self.known[piece]
        flat, ends = array("i"), array("i", [0])
        for part in parts:
            for k, pieces in enumerate(part):
                flat.frombytes(array("i", (self.added[pieces[0]],)).tobytes() if k % 2 else b"".join(map(look, pieces)))
            ends.append(len(flat))
        return flat, ends

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int | None]) -> str:
        """The text of the ids; what isn't UTF-8 becomes replacement marks."""
        try:
            return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")
        except (IndexError, TypeError):
            return b"".join(self.tokens[i] for i in ids if i is not None and 0 <= i < self.width).decode("utf-8", "replace")


def shipped(spark: SparkSession, path: str) -> Callable[[], Tokenizer]:
    """The tokenizer for use in tasks: the driver reads the file (a bounded one) and broadcasts its bytes, each worker builds it once."""
    with open(path, "rb") as file:
        raw = file.read()
    told, name = spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()

    def get() -> Tokenizer:
        if name not in _tokenizers:
            _tokenizers[name] = Tokenizer(told.value)
        return _tokenizers[name]

    return get


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(key, ids array<int>): each row of ``docs`` with the ids of its whole text by the tokenizer file ``path``; with ``decoded``,
    also the text that those ids decode to, in the same pass."""
    both = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    tokenizer = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer()
        for batch in common.blocks(batches, "body"):
            flat, ends = words.encode_all(batch.column("body").to_pylist())
            texts = [words.decode(flat[a:b]) for a, b in zip(ends, ends[1:])] if decoded else []
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids, *[pa.array(texts, pa.string())] * decoded], ["key", "ids", *["decoded"] * decoded])
        words.known.clear()  # a worker that goes on to other stages keeps the vocabulary only

    fields = f"key {both.schema['key'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded
    return both.mapInArrow(common.tidied(run), fields).withColumnRenamed("key", key)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with ``decoded string``: the text of ``ids`` by the tokenizer file ``path``; null ids give an empty text."""
    tokenizer = shipped(coded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [words.decode(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(common.tidied(run), f"{kinds}, decoded string")


def op13_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    import public_tokenizers as P

    coded = encode(common.table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
