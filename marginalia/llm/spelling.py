"""Operator 11: spelling variants by a dictionary of trie-node pairs.

The distinct words are sorted, in ranges, and their trie is numbered: a word brings one new node for each code point after what
it shares with the word before it. The reversed words are sorted and numbered alike. So every word is a row of numbers: its
prefixes as nodes of the one trie, its suffixes as nodes of the other. Two words of one length that differ in one code point share
the pair (prefix node, suffix node) around it; a word that lacks one code point of another one has as a pair of
neighbours (prefix node, suffix node) what the other one has around that code point. These integer pairs are joined: neighbours are
exact, without candidates to check. A pair around one code point belongs to as many words as the alphabet has letters at
most, and a pair without a gap to one word, so no key of these joins is hot, whatever the counts of the words.

The trie is numbered within each range. Of a range's first word the nodes that it shares with the last word of the range before get that
word's numbers; the driver sees the first and the last word of each range for this, nothing else.

Null texts hold no words, a null key counts as the empty text. Words of any length are taken whole, with memory in proportion to one
word. Words that occur equally often are ordered by code points. Repeated rows count as often as they stand; columns
other than key and text are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of a node's number within its range, and the node of the empty prefix.
NODE_BITS, ROOT = 33, -1


def counted(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 7, often: int = 2, slip: int = 31) -> DataFrame:
    """(word, n): runs of Latin letters with A-Z lower-cased, of at least ``least`` code points, that occur ``often`` or more.

    A run loses the code point at h modulo its length where ``slip`` divides h, the crc32 of ``<key>:<run>``.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    low = runs.where(F.length("run") >= least).select("key", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    h = low.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run"))
    return h.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _shared(a: str, b: str) -> int:
    """How many code points a and b begin with in common."""
    if len(a) > len(b):
        a, b = b, a
    if b.startswith(a):
        return len(a)
    return next(k for k, (x, y) in enumerate(zip(a, b)) if x != y)


def _number(column: str):
    """Sorted words of a range with the numbers of their prefixes' nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, free = "", [], TaskContext.get().partitionId() << NODE_BITS
        for batch in common.blocks(batches, column):
            found = []
            for word in batch.column(column).to_pylist():
                shared, new = _shared(last, word), len(word)
                nodes = nodes[:shared] + list(range(free, free + new - shared))
                last, free = word, free + new - shared
                found.append(nodes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "nodes"])

    return run


def numbered(words: DataFrame, order: Column, into: str) -> DataFrame:
    """``words`` with ``into`` array<long>: the trie nodes of the prefixes of ``order``, a distinct text of each row, by depth from 1.

    Numbers of whole texts ascend with the texts.
    """
    spark, fields = words.sparkSession, words.columns
    rows = words.withColumn("_order", order)
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_order").sortWithinPartitions("_order")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    made = common.materialize(dealt.mapInArrow(common.tidied(_number("_order")), f"{kinds}, nodes array<long>"), "trie")
    part = F.shiftright(F.col("nodes")[0], NODE_BITS)
    ends = made.groupBy(part.alias("part")).agg(F.min("_order").alias("first"), F.max(F.struct("_order", "nodes")).alias("last")).orderBy("part").collect()
    told, before, known = [], "", []
    for end in ends:  # one row for each range
        shared = known[: _shared(before, end["first"])]
        if shared:
            told.append((end["part"], shared))
        low = end["part"] << NODE_BITS
        known = [shared[x - low] if x - low < len(shared) else x for x in end["last"]["nodes"]]
        before = end["last"]["_order"]
    if not told:
        return made.select(*fields, F.col("nodes").alias(into))
    seam = F.broadcast(spark.createDataFrame(told, "_part long, _seam array<long>"))
    joined = made.join(seam, part == F.col("_part"), "left")
    place = lambda x: x.bitwiseAND((1 << NODE_BITS) - 1).cast("int")
    mended = F.transform("nodes", lambda x: F.when(place(x) < F.size("_seam"), F.get(F.col("_seam"), place(x))).otherwise(x))
    return joined.select(*fields, F.when(F.col("_seam").isNull(), F.col("nodes")).otherwise(mended).alias(into))


def dictionary(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The numbered ``words`` (word, n): (id, word, n), and the pairs around each code point (p, s, first, id, n) and between
    neighbouring ones (p, s, id, n). ``first`` says that the code point differs from the one before it."""
    both = numbered(numbered(words, F.col("word"), "heads"), F.reverse("word"), "tails")
    both = common.materialize(both.withColumn("id", F.element_at("heads", -1)), "nodes")
    length = F.size("heads")
    head = lambda i: F.when(i == 0, F.lit(ROOT)).otherwise(F.get(F.col("heads"), i - 1))
    tail = lambda n: F.when(n == 0, F.lit(ROOT)).otherwise(F.get(F.col("tails"), n - 1))
    letter = lambda i: F.substring("word", i + 1, F.lit(1))
    skip = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(head(i).alias("p"), tail(length - 1 - i).alias("s"), ((i == 0) | (letter(i) != letter(i - 1))).alias("first")))
    gap = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(head(i).alias("p"), tail(length - i).alias("s")))
    return both.select("id", "word", "n"), both.select("id", "n", F.inline(skip)), both.select("id", "n", F.inline(gap))


def links(skips: DataFrame, gaps: DataFrame) -> DataFrame:
    """(id, other, other_n): every two words that one inserted, deleted or replaced code point tells apart, both ways and once each."""
    a, b = skips.alias("a"), skips.alias("b")
    replaced = a.join(b, (F.col("a.p") == F.col("b.p")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.id") != F.col("b.id"))).select("a.id", F.col("b.id").alias("other"), F.col("b.n").alias("other_n"))
    # Of a run of one letter any may be left out: only its first is.
    shorter = skips.where("first").alias("a").join(gaps.alias("b"), (F.col("a.p") == F.col("b.p")) & (F.col("a.s") == F.col("b.s")))
    ways = F.array(*(F.struct(F.col(f"{x}.id").alias("id"), F.col(f"{y}.id").alias("other"), F.col(f"{y}.n").alias("other_n")) for x, y in ("ab", "ba")))
    return replaced.unionByName(shorter.select(F.inline(ways)))


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n): how many words are near, the near word that occurs most
    if it does ``times`` as often, and the word at the end of these forms."""
    named, skips, gaps = dictionary(words)
    best = links(skips, gaps).groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    near = common.materialize(named.join(best, "id", "left").withColumn("follows", -F.col("best.less") >= times * F.col("n")), "near")
    forms = near.where("follows").select("id", F.col("best.other").alias("form"))
    ends = common.materialize(forms.select("id", F.col("form").alias("root")), "roots")
    while True:  # each form occurs ten times as often as its word, so chains have 18 links at most and double in a round
        further = ends.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = common.materialize(ends.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        common.discard(ends)
        ends = moved.select("id", "root")
        ends.scratch_path = moved.scratch_path
        if moved.where("moved").isEmpty():
            break
    texts = near.select("id", "word")
    told = forms.join(ends, "id").join(texts.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form").join(texts.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    whole = near.join(told.select("id", "form_word", "root_word"), "id", "left")
    form_n = F.when(F.col("follows"), -F.col("best.less"))
    return whole.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(common.table(spark, sf_dir, "documents")))


#: Contract in SQL: neighbours by equal rests after a code point is left out.
OP11_SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), hexed AS (
  SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END))) AS h
  FROM hexed
), slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), skips AS (
  SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), shorter AS (
  SELECT DISTINCT s.word AS a, s.n AS an, w.word AS b, w.n AS bn FROM skips s JOIN words w ON s.rest = w.word
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a, b, bn FROM shorter UNION ALL SELECT b, a, an FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n,
    CASE WHEN b.most >= 10 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = b.most) END AS form
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, coalesce(form, word) AS at FROM forms
  UNION SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word JOIN forms e ON c.at = e.word AND e.form IS NULL
"""
