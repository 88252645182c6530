"""Operator 2: benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The postings (row, position, term) of every training word that any benchmark item uses are stored once; a closing entry
for each row holds its word count. Each window of an item then starts from its rarest term: the offset-adjusted list of
that term is intersected with that of the second rarest, and what is left is compared with all terms of the item. A run
of matches as long as a window is an exact occurrence.

Null and wordless texts have no words and no hits; items without words are left out; repeated rows stay separate rows;
items that repeat an id count once. Texts of any length are indexed whole, columns other than key and text are left out
whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words of a window.
WINDOW = 13
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLOSING = " "


def words(text: Column) -> Column:
    """The words of a text with A-Z lowered. lower() also changes other letters, so texts that have such take translate()."""
    plain = F.when(text.rlike(r"[^\x00-\x7F\p{Ll}]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.coalesce(F.regexp_extract_all(plain, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)), F.array().cast("array<string>"))


class Index:
    """Postings of ``docs`` for the terms of ``items``; both in the shared folder."""

    def __init__(self, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"):
        self.key = key
        told = items.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("item_id"), words(F.col(item_text)).alias("words"))
        told = told.where(F.size("words") > 0).distinct().withColumn("item", F.monotonically_increasing_id())
        self.items = common.materialize(told.select("item", "item_id", F.size("words").alias("length"), "words"), "items")
        spelt = self.items.select("item", "length", F.posexplode("words").alias("at", "word"))
        terms = common.materialize(spelt.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
        self.spelt = common.materialize(spelt.join(terms, "word").select("item", "length", "at", "term"), "spelt")
        closing = terms.sparkSession.createDataFrame([(_CLOSING, -1)], "word string, term long")
        listed = common.maybe_broadcast(terms.unionByName(closing))
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), words(F.col(text)).alias("words"))
        rows = rows.select("row", key, F.posexplode(F.concat("words", F.array(F.lit(_CLOSING)))).alias("pos", "word"))
        stored = common.materialize(rows.join(listed, "word").select("row", key, "pos", "term"), "postings")
        self.postings = stored.where("term >= 0").select("row", "pos", "term")
        self.rows = stored.where("term < 0").select("row", key, F.col("pos").cast("long").alias("n_words"))

    def probes(self, window: int, most: int) -> DataFrame:
        """(item, start, rank, at, term): the ``most`` rarest terms of each window whose terms all occur in the corpus."""
        counts = self.postings.groupBy("term").agg(F.count("*").alias("n"))
        counted = self.spelt.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        size = F.least(F.col("length"), F.lit(window))
        starts = F.sequence(F.greatest(F.lit(0), F.col("at") - size + 1), F.least(F.col("at"), F.col("length") - size))
        by = Window.partitionBy("item", "start")
        spread = counted.withColumn("start", F.explode(starts)).withColumn("least", F.min("n").over(by))
        ranked = spread.where("least > 0").withColumn("rank", F.row_number().over(by.orderBy("n", "at")))
        return common.materialize(ranked.where(F.col("rank") <= most).select("item", "start", "rank", "at", "term"), "probes")

    def _aligned(self, window: int) -> DataFrame:
        """(row, item, shift): where the two rarest terms of some window stand as far apart as in the item."""
        probes = self.probes(window, 2)
        first = probes.where("rank = 1").select("item", "start", F.col("at").alias("at1"), F.col("term").alias("term1"))
        second = probes.where("rank = 2").select("item", "start", F.col("at").alias("at2"), F.col("term").alias("term2"))
        pairs = common.materialize(first.join(second, ["item", "start"], "left").drop("start").distinct(), "pairs")
        leading = pairs.select("item", "at1", F.col("term1").alias("term")).distinct()
        hits = self.postings.join(common.maybe_broadcast(leading), "term").select("row", "item", "at1", (F.col("pos") - F.col("at1")).alias("shift"))
        hits = hits.join(common.maybe_broadcast(pairs), ["item", "at1"])
        alone = hits.where("term2 is null").select("row", "item", "shift")
        wanted = hits.where("term2 is not null").select("row", "item", "shift", F.col("term2").alias("term"), (F.col("shift") + F.col("at2")).alias("pos"))
        others = self.postings.join(common.maybe_broadcast(pairs.select(F.col("term2").alias("term")).distinct()), "term", "left_semi")
        return common.materialize(alone.unionByName(wanted.join(others, ["row", "pos", "term"], "left_semi").select("row", "item", "shift")).distinct(), "aligned")

    def phrases(self, window: int = WINDOW) -> DataFrame:
        """(row, item, shift, starts, size): the starts in the item of all windows that occur exactly, ``shift`` words on in the row."""
        found = self._aligned(window)
        near = common.maybe_broadcast(found.select("row").distinct())
        held = self.postings.join(near, "row", "left_semi")
        spelt = common.maybe_broadcast(self.spelt)
        wanted = found.join(spelt, "item").withColumn("pos", F.col("shift") + F.col("at"))
        matched = wanted.join(held, ["row", "pos", "term"], "left_semi").groupBy("row", "item", "shift", "length").agg(F.array_sort(F.collect_list("at")).alias("m"))
        # m[i + size - 1] = m[i] + size - 1 says that all places between match as well.
        sized = matched.withColumn("size", F.least(F.col("length"), F.lit(window)))
        starts = F.expr("filter(m, (p, i) -> i + size <= cardinality(m) and get(m, i + size - 1) = p + size - 1)")
        return sized.select("row", "item", "shift", "size", starts.alias("starts")).where(F.size("starts") > 0)

    def near(self, terms: int = 3, span: int = 20) -> DataFrame:
        """(row, item_id, n_near): occurrences of the rarest term of an item with its next rarest ones within ``span`` words."""
        counts = self.postings.groupBy("term").agg(F.count("*").alias("n"))
        by = Window.partitionBy("item").orderBy("n", "term")
        rare = self.spelt.select("item", "term").distinct().join(counts, "term").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= terms)
        rare = common.materialize(rare.select("item", "term", "rank", F.max("rank").over(Window.partitionBy("item")).alias("of")), "rare")
        hits = self.postings.join(common.maybe_broadcast(rare), "term")
        centres = hits.where("rank = 1").select("row", "item", "of", F.col("pos").alias("centre"))
        cells = centres.withColumn("cell", F.explode(F.array(*(F.floor(F.col("centre") / span) + d for d in (-1, 0, 1)))))
        others = hits.where("rank > 1").select("row", "item", "rank", "pos", F.floor(F.col("pos") / span).alias("cell"))
        met = cells.join(others, ["row", "item", "cell"]).where(F.abs(F.col("pos") - F.col("centre")) <= span)
        full = met.groupBy("row", "item", "centre", "of").agg(F.countDistinct("rank").alias("k")).where("k = of - 1").select("row", "item")
        full = full.unionByName(centres.where("of = 1").select("row", "item"))
        return full.groupBy("row", "item").agg(F.count("*").alias("n_near")).join(self.items.select("item", "item_id"), "item").select("row", "item_id", "n_near")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, item_ids): how many words of each row stand in an occurrence of a window, and of which items."""
    index = Index(docs, items, key)
    found = common.materialize(index.phrases(window), "phrases")
    places = found.select("row", F.explode(F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(F.col("shift") + p, F.col("shift") + p + F.col("size") - 1))))).alias("pos"))
    hit = places.distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = found.select("row", "item").distinct().join(index.items.select("item", "item_id"), "item").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    rows = index.rows.join(hit.join(named, "row"), "row", "left")
    return rows.select(key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def contaminated() -> Column:
    """A row counts as contaminated when hits are a twentieth of its words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


#: Every window of every item is looked up among all windows of its length in every document.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM d, sizes, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS u(s)),
hits AS (SELECT doc_id, s, k, item_id FROM dw JOIN bw USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, s, k FROM hits), unnest(range(s, s + k)) AS u(p) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
