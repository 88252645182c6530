"""Vector and text retrieval, rank fusion, budgets and gates."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.texts import BROAD_CUES, any_case
from ..registry import Tables, query
from .windows import first_by

_D = "CAST({} AS DOUBLE[])"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column, empty: float | None = None) -> Column:
    """1 - cos of two vectors; ``empty`` (null unless given) where one has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(empty)).otherwise(1 - dot(a, b) / norms)


def nearest(vectors: DataFrame, anchor: DataFrame, k: int, *conditions: Column) -> DataFrame:
    """(vec_id, d): the k rows nearest to the one vector of ``anchor`` (q), after ``conditions``. An exact scan: each task keeps k rows."""
    rows = vectors.where(F.col("embedding").isNotNull())
    for c in conditions:
        rows = rows.where(c)
    scored = rows.crossJoin(F.broadcast(anchor)).select("vec_id", "label", (F.round(cosine_distance(F.col("embedding"), F.col("q")), 6) + 0.0).alias("d"))
    return scored.orderBy("d", "vec_id").limit(k).select("vec_id", "label", "d")


def anchor(t: Tables, vec_id: int = 0) -> DataFrame:
    return t.embeddings.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q")).limit(1)


_DIST = "round(1 - list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6) + 0.0"
_NEAR = f"FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query("vec01_knn", f"SELECT vec_id, {_DIST} AS d {_NEAR} ORDER BY d, vec_id LIMIT 10")
def knn(t: Tables) -> DataFrame:
    return nearest(t.embeddings, anchor(t), 10).select("vec_id", "d")


@query("vec02_filtered_knn", f"SELECT vec_id, {_DIST} AS d {_NEAR} WHERE label IN (1, 2) ORDER BY d, vec_id LIMIT 10")
def filtered_knn(t: Tables) -> DataFrame:
    return nearest(t.embeddings, anchor(t), 10, F.col("label").isin(1, 2)).select("vec_id", "d")


@query("vec03_gated_knn", f"SELECT * FROM (SELECT vec_id, {_DIST} AS d {_NEAR} ORDER BY d, vec_id LIMIT 20) WHERE d <= 0.85")
def gated_knn(t: Tables) -> DataFrame:
    return nearest(t.embeddings, anchor(t), 20).where("d <= 0.85").select("vec_id", "d")


@query("vec04_similar_items", f"SELECT vec_id, CAST(round_even(100 * (1 - {_DIST}), 0) AS INTEGER) AS similarity {_NEAR} WHERE vec_id <> 0 AND label <> (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY {_DIST}, vec_id LIMIT 8")
def similar_items(t: Tables) -> DataFrame:
    own = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"), F.col("label").alias("own")).limit(1)
    rows = t.embeddings.crossJoin(F.broadcast(own)).where("vec_id <> 0 AND label <> own")
    near = rows.select("vec_id", (F.round(cosine_distance(F.col("embedding"), F.col("q")), 6) + 0.0).alias("d")).orderBy("d", "vec_id").limit(8)
    return near.select("vec_id", F.bround(100 * (1 - F.col("d")), 0).cast("int").alias("similarity"))


@query("vec06_nearest_sibling", f"SELECT label, arg_min(vec_id, (d, vec_id)) FILTER (d <= 0.9) AS vec_id FROM (SELECT vec_id, label, {_DIST} AS d {_NEAR} WHERE vec_id <> 0) GROUP BY label")
def nearest_sibling(t: Tables) -> DataFrame:
    rows = t.embeddings.where("vec_id <> 0").crossJoin(F.broadcast(anchor(t))).select("vec_id", "label", (F.round(cosine_distance(F.col("embedding"), F.col("q")), 6) + 0.0).alias("d"))
    return rows.groupBy("label").agg(F.min_by("vec_id", F.when(F.col("d") <= 0.9, F.struct("d", "vec_id"))).alias("vec_id"))


_QUERIES = f"SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS place FROM embeddings e, embeddings q"


#: Rows and queries of a block, and how far a distance lies at most from one that is the same when rounded to six places.
ROWS, ASKED, MARGIN = 2_048, 1_024, 2e-6
#: Lengths of vectors whose products neither overflow nor vanish.
PLAIN_NORMS = (1e-100, 1e100)


def _near_in_blocks(k: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each block of rows and block of queries the rows that may be among a query's ``k`` nearest: (query_id, vec_id, d), d not rounded."""

    def side(batch: pa.RecordBatch, name: str, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = batch[name].slice(at, 1).flatten()
        ids, norms = (rows.field(f).to_numpy(zero_copy_only=False) for f in ("id", "norm"))
        return ids, rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), norms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, v, vn = side(batch, "rows", at)
                asked, q, qn = side(batch, "asked", at)
                d = 1 - (q / qn[:, None]) @ (v / vn[:, None]).T
                bound = np.partition(d, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(asked), np.inf)
                i, j = np.nonzero(d <= bound[:, None] + MARGIN)
                # The products are added up from the first to the last, as the SQL does.
                exact = np.concatenate([1 - np.cumsum(v[j[n : n + 65_536]] * q[i[n : n + 65_536]], axis=1)[:, -1] / (vn[j[n : n + 65_536]] * qn[i[n : n + 65_536]]) for n in range(0, len(i), 65_536)] or [np.empty(0)])
                order = np.lexsort((ids[j], exact, i))
                i, j, exact = i[order], j[order], exact[order]
                # Of copies, which have one distance, k suffice.
                later = np.arange(len(i)) - k
                copy = (later >= 0) & (i == i[later]) & (exact == exact[later])
                i, j, exact = i[~copy], j[~copy], exact[~copy]
                yield pa.record_batch([pa.array(asked[i], kind), pa.array(ids[j], kind), pa.array(exact)], ["query_id", "vec_id", "d"])

    return run


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, place): the k rows nearest to each of ``queries`` (query_id, q); every task keeps k rows a query.

    Blocks of rows meet blocks of queries in products of matrices, which tell the few rows whose distances are worked out in order. Vectors without a
    length, of very small or large ones, or of another size than the others, are compared row by row.
    """
    # Each vector's length is worked out once, not for each pair.
    sized = scratch.materialize(vectors.where(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("vn")), "vectors")
    asked = scratch.materialize(queries.select("query_id", F.col("q").cast("array<double>").alias("q"), F.sqrt(dot(F.col("q"), F.col("q"))).alias("qn")), "queries")
    size = asked.agg(F.max(F.size("q"))).first()[0] or 0
    plain = lambda v, n: F.coalesce((F.size(v) == size) & F.col(n).between(*PLAIN_NORMS), F.lit(False))

    def blocks(df: DataFrame, key: str, v: str, n: str, name: str, each: int, least: int) -> DataFrame:
        number = max(least, -(-df.count() // each))
        rows = df.where(plain(v, n)).withColumn("_b", F.pmod(F.xxhash64(key, F.lit(7)), F.lit(number))).repartition(number, "_b")
        return rows.groupBy("_b").agg(F.collect_list(F.struct(F.col(key).cast("long").alias("id"), F.col(v).alias("v"), F.col(n).alias("norm"))).alias(name)).select(name)

    met = blocks(sized, "vec_id", "v", "vn", "rows", ROWS, 12).crossJoin(scratch.maybe_broadcast(scratch.materialize(blocks(asked, "query_id", "q", "qn", "asked", ASKED, 1), "asked")))
    near = met.mapInArrow(_near_in_blocks(k, "int64"), "query_id long, vec_id long, d double")
    odd = sized.where(~plain("v", "vn")).crossJoin(asked).unionByName(sized.where(plain("v", "vn")).crossJoin(asked.where(~plain("q", "qn")))).withColumn("norms", F.col("vn") * F.col("qn"))
    odd = odd.select("query_id", "vec_id", F.when(F.col("norms") != 0, 1 - dot(F.col("v"), F.col("q")) / F.col("norms")).alias("d"))
    rows = near.unionByName(odd).select("query_id", "vec_id", (F.round("d", 6) + 0.0).alias("d"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("place") <= k).select("query_id", "vec_id", "place")


@query("vec07_multi_query", _QUERIES + " WHERE q.vec_id % 50 = 0 QUALIFY place <= 5")
def multi_query(t: Tables) -> DataFrame:
    """One ranked list for each query vector: every fiftieth row against all rows."""
    return nearest_to_each(t.embeddings, t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5)


@query("vec03_gates", f"SELECT * FROM (SELECT vec_id, {_DIST} AS d, {_DIST} <= 0.55 AS near, {_DIST} <= 0.35 AS same {_NEAR} ORDER BY d, vec_id LIMIT 40)")
def gates(t: Tables) -> DataFrame:
    """The nearest forty first, then both gates: 0.55 for what is near, 0.35 for what counts as the same."""
    return nearest(t.embeddings, anchor(t), 40).select("vec_id", "d", (F.col("d") <= 0.55).alias("near"), (F.col("d") <= 0.35).alias("same"))


@query("vec05_zero_vectors", f"SELECT e.vec_id, coalesce({_DIST}, 1.0) AS distance, coalesce(round(1 - {_DIST}, 6), 0.0) AS similarity, {_DIST} AS known FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN NULL ELSE embedding END AS embedding FROM embeddings) e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def zero_vectors(t: Tables) -> DataFrame:
    """The three conventions for a vector without length: distance 1, similarity 0, or nothing known."""
    zeroed = F.when(F.col("vec_id") % 10 == 3, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    rows = t.embeddings.select("vec_id", zeroed.alias("e")).crossJoin(F.broadcast(anchor(t)))
    at = lambda empty: F.round(cosine_distance(F.col("e"), F.col("q"), empty), 6) + 0.0
    return rows.select("vec_id", at(1.0).alias("distance"), F.coalesce(F.round(1 - at(None), 6), F.lit(0.0)).alias("similarity"), at(None).alias("known"))


@query("vec08_misconceptions", f"SELECT vec_id, {_DIST} AS d {_NEAR} WHERE label IN (1, 2) AND vec_id % 4 <> 1 AND vec_id <> 0 AND {_DIST} <= 0.95 ORDER BY d, vec_id LIMIT 2")
def misconceptions(t: Tables) -> DataFrame:
    """The two nearest of the rejected or superseded rows that give a reason and lie within the gate."""
    status = F.when(F.col("label") == 1, "rejected").when(F.col("label") == 2, "superseded").otherwise("accepted")
    reason = F.when(F.col("vec_id") % 4 == 1, " ").otherwise("shown to be wrong")
    rows = t.embeddings.where(status.isin("rejected", "superseded") & (F.trim(reason) != "") & (F.col("vec_id") != 0)).crossJoin(F.broadcast(anchor(t)))
    scored = rows.select("vec_id", (F.round(cosine_distance(F.col("embedding"), F.col("q")), 6) + 0.0).alias("d"))
    return scored.where("d <= 0.95").orderBy("d", "vec_id").limit(2)


@query("topk03_by_distance", f"SELECT vec_id, label, {_DIST} AS d {_NEAR} ORDER BY d, vec_id LIMIT 25")
def by_distance(t: Tables) -> DataFrame:
    return nearest(t.embeddings, anchor(t), 25)


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"))


def stemmed(text: Column) -> Column:
    """The words of a text, lower case, without a plural or verb ending: a light stemmer of three rules."""
    return F.transform(plain_words(text), lambda w: F.regexp_replace(w, "(ing|ed|s)$", ""))


def stem_forms(term: Column) -> Column:
    """The words that ``stemmed`` makes ``term`` of: with each ending, and the term itself if it has none."""
    ends = F.array(*(F.concat(term, F.lit(end)) for end in ("ing", "ed", "s")))
    return F.when(term.rlike("(ing|ed|s)$"), ends).otherwise(F.array_append(ends, term))


_STEM = "list_transform(regexp_extract_all(lower({}), '\\p{{L}}+'), lambda w: regexp_replace(w, '(ing|ed|s)$', ''))"


_TERMS = f"""q AS (SELECT item_id AS query_id, unnest(list_distinct(({_STEM.format('text')})[1:2])) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)), k AS (SELECT query_id, count(*) AS k FROM q GROUP BY 1),
w AS (SELECT doc_id, {_STEM.format('text')} AS ws FROM documents), p AS (SELECT doc_id, term, max(n) AS n, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM w) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, round(sum(tf) / max(n), 6) AS score FROM q JOIN p USING (term) JOIN k USING (query_id) GROUP BY 1, 2 HAVING count(*) = max(k))"""


def query_terms(t: Tables) -> DataFrame:
    """(query_id, term, k): the plain terms of each query, here the first two words of each benchmark item, and their number."""
    terms = F.array_distinct(F.slice(stemmed(F.col("text")), 1, 2))
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.size(terms).alias("k"), F.explode(terms).alias("term")).distinct()


def text_scores(t: Tables) -> DataFrame:
    """(query_id, doc_id, score): the texts that have all terms of a query, with the share of their words that those are.

    One scan makes the postings of the terms of all queries; they are joined by term, so queries share the scan. Words meet the
    forms of the terms by equality: only terms are taken apart, not the words of the texts.
    """
    asked = query_terms(t)
    forms = scratch.materialize(asked.select("term").distinct().select("term", F.explode(stem_forms(F.col("term"))).alias("w")), "forms")
    words = t.documents.select("doc_id", plain_words(F.col("text")).alias("ws")).select("doc_id", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    postings = words.join(scratch.maybe_broadcast(forms), "w").groupBy("doc_id", "term").agg(F.max("n").alias("n"), F.count("*").alias("tf"))
    met = postings.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("tf") / F.max("n"), 6).alias("score"), F.count("*").alias("hit"), F.max("k").alias("k"))
    return met.where("hit = k").select("query_id", "doc_id", "score")


@query("fts01_match", f"WITH {_TERMS} SELECT query_id, doc_id FROM s")
def text_match(t: Tables) -> DataFrame:
    return text_scores(t).select("query_id", "doc_id")


@query("fts02_rank", f"WITH {_TERMS} SELECT query_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20")
def text_rank(t: Tables) -> DataFrame:
    return first_by(text_scores(t), ["query_id"], F.desc("score"), "doc_id", n=20)


@query("fts03_fields", "SELECT doc_id, concat_ws(chr(10) || chr(10), lang, nullif(source, 'src0'), left(text, 50)) AS body FROM documents")
def fields(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat_ws("\n\n", "lang", F.nullif("source", F.lit("src0")), F.left("text", F.lit(50))).alias("body"))


def fuse(lists: DataFrame, k: int = 60, *by: str) -> DataFrame:
    """Reciprocal rank fusion of ``lists`` (``by``, list_id, pos from 0, item, bonus): sum of 1 / (k + pos + 1) + bonus; ties by first place, then item."""
    return lists.groupBy(*by, "item").agg(F.round(F.sum(1 / (F.lit(k) + F.col("pos") + 1) + F.col("bonus")), 9).alias("score"), F.min(F.struct("list_id", "pos")).alias("first"))


_LISTS = f"""WITH {_TERMS}, v AS (SELECT query_id, 1 AS list_id, vec_id AS item, place - 1 AS pos FROM ({_QUERIES} WHERE q.vec_id IN (SELECT item_id FROM benchmark) QUALIFY place <= 30)),
x AS (SELECT query_id, 2 AS list_id, doc_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS pos FROM s QUALIFY pos < 30), a AS (SELECT * FROM v UNION ALL SELECT * FROM x)"""


def both_lists(t: Tables) -> DataFrame:
    """(query_id, list_id, item, pos): for each query thirty rows by vector and thirty by text."""
    asked = t.benchmark.select(F.col("item_id").alias("vec_id")).distinct()
    vectors = t.embeddings.join(asked, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    by_vector = nearest_to_each(t.embeddings, vectors, 30).select("query_id", F.lit(1).alias("list_id"), F.col("vec_id").alias("item"), (F.col("place") - 1).alias("pos"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    by_text = text_scores(t).withColumn("pos", place - 1).where("pos < 30").select("query_id", F.lit(2).alias("list_id"), F.col("doc_id").alias("item"), "pos")
    return by_vector.unionByName(by_text)


@query("rrf01_fusion", _LISTS + " SELECT query_id, item, round(sum(1 / (60 + pos + 1)), 9) AS score FROM a GROUP BY query_id, item QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, min(list_id * 1000 + pos), item) <= 15")
def fusion(t: Tables) -> DataFrame:
    return first_by(fuse(both_lists(t).withColumn("bonus", F.lit(0.0)), 60, "query_id"), ["query_id"], F.desc("score"), "first", "item", n=15).select("query_id", "item", "score")


@query("rrf02_source_bonus", _LISTS + " SELECT query_id, item, round(sum(1 / (60 + pos + 1) + CASE WHEN source LIKE '%1%' THEN 0.008 ELSE 0 END), 9) AS score FROM a LEFT JOIN documents ON doc_id = item GROUP BY query_id, item QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, min(list_id * 1000 + pos), item) <= 15")
def source_bonus(t: Tables) -> DataFrame:
    sources = t.documents.select(F.col("doc_id").alias("item"), "source")
    lists = both_lists(t).join(sources, "item", "left").withColumn("bonus", F.when(F.contains("source", F.lit("1")), 0.008).otherwise(0.0))
    return first_by(fuse(lists, 60, "query_id"), ["query_id"], F.desc("score"), "first", "item", n=15).select("query_id", "item", "score")


@query("rag01_hybrid", _LISTS + ", f AS (SELECT query_id, item, round(sum(1 / (60 + pos + 1)), 9) AS score, min(list_id * 1000 + pos) AS first FROM a GROUP BY 1, 2), d AS (SELECT query_id, doc_id, source, score, first, left(text, 60) AS snippet FROM f JOIN documents ON doc_id = item QUALIFY row_number() OVER (PARTITION BY query_id, source, lang ORDER BY score DESC, first, item) = 1) SELECT query_id, doc_id, source, score, snippet FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) <= 8")
def hybrid(t: Tables) -> DataFrame:
    """Vector and text lists of each query fused, joined to their rows, one row for each source and language, the best eight."""
    fused = fuse(both_lists(t).withColumn("bonus", F.lit(0.0)), 60, "query_id")
    heads = t.documents.select(F.col("doc_id").alias("item"), "source", "lang", F.left("text", F.lit(60)).alias("snippet"))
    rows = first_by(fused.join(heads, "item"), ["query_id", "source", "lang"], F.desc("score"), "first", "item")
    return first_by(rows, ["query_id"], F.desc("score"), "first", "item", n=8).select("query_id", F.col("item").alias("doc_id"), "source", "score", "snippet")


@query("rag07_trust_weight", """WITH c AS (SELECT md5(text) AS h, count(DISTINCT source) AS n FROM documents GROUP BY 1), m AS (SELECT max(doc_id) AS m FROM documents)
    SELECT l.doc_id, round(greatest(0.05, least(1.0, (0.5 + 0.5 * quality) * (CASE WHEN toxic = 1 THEN 0.4 ELSE 1.0 END) * (1 - pow(0.5, n)) * exp(-ln(2) * (m - l.doc_id) / greatest(1, m)))), 9) AS weight FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN c ON h = md5(text), m""")
def trust_weight(t: Tables) -> DataFrame:
    """Authority, verification, corroboration by sources with the same text, and recency, multiplied and kept within 0.05 and 1."""
    hashed = t.documents.select("doc_id", "source", F.md5("text").alias("h"))
    sources = hashed.groupBy("h").agg(F.countDistinct("source").alias("n"))
    rows = t.labels.join(hashed, "doc_id").join(sources, "h").crossJoin(F.broadcast(t.documents.agg(F.max("doc_id").alias("m"))))
    authority, verified = 0.5 + 0.5 * F.col("quality"), F.when(F.col("toxic") == 1, 0.4).otherwise(1.0)
    recency = F.exp(-F.log(F.lit(2.0)) * (F.col("m") - F.col("doc_id")) / F.greatest(F.lit(1), F.col("m")))
    product = authority * verified * (1 - F.pow(F.lit(0.5), F.col("n"))) * recency
    return rows.select("doc_id", F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), product)), 9).alias("weight"))


#: Half-lives in days by tier; null never decays. Fixed values.
HALF_LIVES = {"purchase": None, "view": 1095, "click": 365, "login": 210, "error": 21}


@query("rag08_decay", "WITH e AS (SELECT event_id, greatest(0, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 864e8) AS days, CASE event_type WHEN 'view' THEN 1095 WHEN 'click' THEN 365 WHEN 'login' THEN 210 WHEN 'error' THEN 21 END AS half FROM events) SELECT event_id, round(CASE WHEN half IS NULL THEN 1.0 ELSE exp(-ln(2) / half * days) END, 9) AS decay FROM e")
def decay(t: Tables) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = t.events.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("now"))))
    days = F.greatest(F.lit(0.0), (micros("now") - micros("ts")) / 864e8)
    half = F.lit(None).cast("double")
    for kind, value in HALF_LIVES.items():
        half = F.when(F.col("event_type") == kind, F.lit(value).cast("double")).otherwise(half)
    return rows.select("event_id", F.round(F.when(half.isNull(), 1.0).otherwise(F.exp(-F.log(F.lit(2.0)) / half * days)), 9).alias("decay"))


@query("rag09_trust_gate", "SELECT source, CASE WHEN bool_or(quality = 1 AND toxic = 0 AND lang = 'en') THEN 'official' WHEN max(quality * 0.3) >= 0.28 THEN 'community' ELSE 'none' END AS gate FROM labels JOIN documents USING (doc_id) GROUP BY source")
def trust_gate(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    official = F.bool_or((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("lang") == "en"))
    return rows.groupBy("source").agg(F.when(official, "official").when(F.max(F.col("quality") * 0.3) >= 0.28, "community").otherwise("none").alias("gate"))


#: What the kinds of questions are told by, in order, and the cues of the retrieval modes.
ROUTES = {
    "tournament": r"\b(toernooi|tournament|ronde|rondes|judge|penalt|mulligan|match|best of|swiss|top ?cut|deck ?check|tijdslimiet|time limit)\b",
    "legality": r"\b(ban|banned|banlijst|banlist|verboden|legaal|legal|legaliteit|rotatie|rotation|toegestaan|hoeveel (kopie|exemplar)|deck ?(bouw|construction|limiet)|4x|playset)\b",
    "list": r"\b(welke|which|what|noem)\b[^.?!]{0,60}\b(kaarten|cards)\b|\bwelke\b[^.?!]{0,60}\bzijn er\b|\b(geef|maak|toon|give|show)\b[^.?!]{0,40}\b(overzicht|lijst|overview|list)\b|\b(overzicht|lijst) van\b|\blist all\b|\balle? (kaarten|cards)\b|\bde meta\b|\bmeta ?-?(decks?|kaarten|cards|overzicht)\b",
    "card": r"\b(wat doet|what does|hoe werkt de kaart|kaarttekst van)\b",
    "definition": r"^\s*(wat (is|zijn|betekent|betekenen|doet het keyword)|what (is|are|does .* mean)|leg .*uit|explain)\b",
}
CAUSAL = r"\b(waarom|why|hoezo|hoe komt|hoe kan|wat maakt|wat gebeurt er als|verliest|wint|beats|loses?|verslaat|voorrang|precede|because)\b"
INTERACTION = r"\b(werkt .* (samen|met)|combineer|combo|interact|samen met|tegen|counter|stapel|stack|reageer|response op|triggert)\b"
MISCONCEPTION = r"\b(klopt het dat|is het waar|mag je altijd|kun je altijd|moet je altijd|is it true|can you always)\b"


def question_kind(question: Column, mentions: Column) -> Column:
    """The kind of a question by the first rule that fits; a question about a card needs the mention of one, a definition must have none."""
    fits = {k: question.rlike(any_case(p)) for k, p in ROUTES.items()}
    return F.when(fits["tournament"], "tournament").when(fits["legality"], "legality").when(fits["list"], "list").when(fits["card"] & mentions, "card").when(fits["definition"] & ~mentions, "definition").otherwise("ruling")


def retrieval_mode(kind: Column, question: Column, entities: Column, elapsed_ms: Column, warm: Column, budget_ms: int = 4_000) -> Column:
    """(mode, hops, drift, path, fallback): how to retrieve for a question of a kind that names so many entities; over the
    budget only what is local is left, and without a warm graph no paths."""
    cue = lambda p: question.rlike(any_case(p))
    several = entities >= 2
    pick = lambda mode, hops, drift, path: F.struct(F.lit(mode).alias("mode"), F.lit(hops).alias("hops") if isinstance(hops, int) else hops.alias("hops"), drift.alias("drift"), path.alias("path"))
    yes, no = F.lit(True), F.lit(False)
    chosen = F.when(kind == "legality", pick("direct", 0, no, no)).when((kind == "list") | cue(BROAD_CUES), pick("global", 1, no, no))
    chosen = chosen.when(cue(CAUSAL) & several, pick("path", 2, yes, yes)).when(cue(INTERACTION) & several, pick("drift", 2, yes, yes)).when(cue(MISCONCEPTION), pick("drift", 2, yes, yes))
    chosen = chosen.when(kind == "definition", pick("local", 1, no, no)).when(kind == "card", pick("local", 1, several, no)).otherwise(pick("drift", F.when(several, 2).otherwise(1), yes, several))
    late, cold = elapsed_ms >= budget_ms, chosen["path"] & ~warm
    mode = F.when(late, "local").when(cold & (chosen["mode"] == "path"), "drift").otherwise(chosen["mode"])
    hops = F.when(late, F.greatest(F.lit(1), chosen["hops"])).otherwise(chosen["hops"])
    fallback = F.when(late, "latency").when(cold, "cold")
    return F.struct(mode.alias("mode"), hops.alias("hops"), (chosen["drift"] & ~late).alias("drift"), (chosen["path"] & ~late & warm).alias("path"), fallback.alias("fallback"))


def asked(t: Tables) -> DataFrame:
    """(conv_id, turn, question, entities, elapsed_ms, warm): the turns of conversations with openings that the routes tell apart."""
    openings = F.array(*(F.lit(x) for x in OPENINGS))
    question = F.concat(F.element_at(openings, (F.pmod("conv_id", F.lit(len(OPENINGS))) + 1).cast("int")), "text")
    entities = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"))))
    return t.conversations.where("text IS NOT NULL").select("conv_id", "turn", question.alias("question"), entities.alias("entities"), (F.length("text") * 10).alias("elapsed_ms"), (F.col("turn") % 2 == 0).alias("warm"))


OPENINGS = ("", "What is ", "Which cards have ", "Is it legal that ", "what does it do: ", "In a match ", "Why does it beat ", "Is it true that ", "combo ")
_ASKED = "asked AS (SELECT conv_id, turn, [" + ", ".join(f"'{x}'" for x in OPENINGS) + f"][conv_id % {len(OPENINGS)} + 1] || text AS question, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{5,}}'))) AS entities, length(text) * 10 AS elapsed_ms, turn % 2 = 0 AS warm FROM conversations WHERE text IS NOT NULL)"
_FIT = {k: f"regexp_matches(question, '(?i){p}')" for k, p in (ROUTES | {"broad": BROAD_CUES, "causal": CAUSAL, "interaction": INTERACTION, "misconception": MISCONCEPTION}).items()}
_KIND = f"CASE WHEN {_FIT['tournament']} THEN 'tournament' WHEN {_FIT['legality']} THEN 'legality' WHEN {_FIT['list']} THEN 'list' WHEN {_FIT['card']} AND entities > 0 THEN 'card' WHEN {_FIT['definition']} AND entities = 0 THEN 'definition' ELSE 'ruling' END"


@query("rag10_router", f"WITH {_ASKED} SELECT conv_id, turn, {_KIND} AS route FROM asked")
def router(t: Tables) -> DataFrame:
    return asked(t).select("conv_id", "turn", question_kind(F.col("question"), F.col("entities") > 0).alias("route"))


@query("rag11_mode", f"""WITH {_ASKED}, k AS (SELECT *, {_KIND} AS kind FROM asked),
    c AS (SELECT *, CASE WHEN kind = 'legality' THEN ['direct', '0', '', ''] WHEN kind = 'list' OR {_FIT['broad']} THEN ['global', '1', '', ''] WHEN {_FIT['causal']} AND entities >= 2 THEN ['path', '2', 'y', 'y'] WHEN {_FIT['interaction']} AND entities >= 2 THEN ['drift', '2', 'y', 'y'] WHEN {_FIT['misconception']} THEN ['drift', '2', 'y', 'y']
      WHEN kind = 'definition' THEN ['local', '1', '', ''] WHEN kind = 'card' THEN ['local', '1', CASE WHEN entities >= 2 THEN 'y' ELSE '' END, ''] ELSE ['drift', CASE WHEN entities >= 2 THEN '2' ELSE '1' END, 'y', CASE WHEN entities >= 2 THEN 'y' ELSE '' END] END AS m FROM k)
    SELECT conv_id, turn, CASE WHEN elapsed_ms >= 4000 THEN 'local' WHEN m[4] = 'y' AND NOT warm AND m[1] = 'path' THEN 'drift' ELSE m[1] END AS mode, CASE WHEN elapsed_ms >= 4000 THEN greatest(1, CAST(m[2] AS INTEGER)) ELSE CAST(m[2] AS INTEGER) END AS hops,
      m[3] = 'y' AND elapsed_ms < 4000 AS drift, m[4] = 'y' AND elapsed_ms < 4000 AND warm AS path, CASE WHEN elapsed_ms >= 4000 THEN 'latency' WHEN m[4] = 'y' AND NOT warm THEN 'cold' END AS fallback FROM c""")
def mode(t: Tables) -> DataFrame:
    kind = question_kind(F.col("question"), F.col("entities") > 0)
    rows = asked(t).withColumn("kind", kind)
    return rows.select("conv_id", "turn", retrieval_mode(F.col("kind"), F.col("question"), F.col("entities"), F.col("elapsed_ms"), F.col("warm")).alias("m")).select("conv_id", "turn", "m.*")


#: Conditions under which a source can't be read; any other error is a fault of the channel itself.
UNREADABLE = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER")


def channel(name: str, build: Callable[[], DataFrame], like: DataFrame, failed: list[str]) -> DataFrame:
    """The rows of a retrieval channel; if its source can't be read, none in the schema of ``like``, its name is added to ``failed`` and the reason logged.

    The rows are written out here, so that a failure shows in this channel and not in the query that it is part of. Other errors are raised.
    """
    try:
        return scratch.materialize(build().select(like.columns), name)
    except PySparkException as error:
        if not (error.getCondition() or "").startswith(UNREADABLE):
            raise
        logging.getLogger(__name__).warning("channel %s can't be read: %s", name, error.getCondition())
        failed.append(name)
        return like.limit(0)


@query("rag15_degraded", "SELECT 'parts' AS channel, p_partkey AS id, 'vectors' AS failed FROM part WHERE p_size = 7 UNION ALL SELECT 'orders', o_orderkey, 'vectors' FROM orders WHERE o_totalprice > 400000")
def degraded(t: Tables) -> DataFrame:
    """Three channels, of which the second can't be read: the others answer, and its name stands beside the rows."""
    like, failed = t.part.select(F.lit("").alias("channel"), F.col("p_partkey").alias("id")), []
    found = [
        channel("parts", lambda: t.part.where("p_size = 7").select(F.lit("parts").alias("channel"), F.col("p_partkey").alias("id")), like, failed),
        channel("vectors", lambda: t.no_such_table.select(F.lit("vectors").alias("channel"), F.col("vec_id").alias("id")), like, failed),
        channel("orders", lambda: t.orders.where("o_totalprice > 400000").select(F.lit("orders").alias("channel"), F.col("o_orderkey").alias("id")), like, failed),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).withColumn("failed", F.lit(",".join(failed)))


@query("rag12_beta", "SELECT conv_id, turn, round(1 / (1 + exp(-(6 * d - 5 * a - 0.5))), 9) AS beta FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Z]')) / greatest(1, length(text)) AS d, least(1.0, length(text) / 2000.0) AS a FROM conversations)")
def beta(t: Tables) -> DataFrame:
    density = F.regexp_count("text", F.lit("[A-Z]")) / F.greatest(F.lit(1), F.length("text"))
    abstraction = F.least(F.lit(1.0), F.length("text") / 2000.0)
    return t.conversations.select("conv_id", "turn", F.round(1 / (1 + F.exp(-(6 * density - 5 * abstraction - 0.5))), 9).alias("beta"))


@query("rag14_longest_names", "WITH n AS (SELECT DISTINCT p_brand, p_type AS name FROM part), k AS (SELECT * FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.p_brand = a.p_brand AND contains(b.name, a.name) AND length(b.name) > length(a.name))) SELECT p_brand, name FROM k QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY length(name) DESC, name) <= 2")
def longest_names(t: Tables) -> DataFrame:
    names = t.part.select("p_brand", F.col("p_type").alias("name")).distinct()
    longer = names.select("p_brand", F.col("name").alias("other"))
    kept = names.join(longer, (names["p_brand"] == longer["p_brand"]) & F.contains("other", "name") & (F.length("other") > F.length("name")), "left_anti")
    return kept.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc(F.length("name")), "name"))).where("r <= 2").select("p_brand", "name")


@query("rag02_layers", f"WITH {_TERMS} SELECT query_id, lang AS layer, doc_id, round_even(1 / (60.0 + row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id)), 4) AS score FROM s JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id) <= 5")
def layers(t: Tables) -> DataFrame:
    """The best five of each layer for each query, with the fused score of their place; the languages are the layers."""
    scored = text_scores(t).join(t.documents.select("doc_id", F.col("lang").alias("layer")), "doc_id")
    placed = scored.withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "layer").orderBy(F.desc("score"), "doc_id"))).where("pos <= 5")
    return placed.select("query_id", "layer", "doc_id", F.bround(1 / (60.0 + F.col("pos")), 4).alias("score"))


@query("rag03_backfill", "WITH c AS (SELECT conv_id, turn, CAST(unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS VARCHAR) AS code FROM conversations), d AS (SELECT doc_id, split_part(text, ' ', 1) AS code FROM documents) SELECT conv_id, c.code, min(doc_id) AS doc_id FROM c JOIN d ON d.code = c.code GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY c.code) <= 6")
def backfill(t: Tables) -> DataFrame:
    """Codes that a conversation names, resolved to the first text that begins with them; six for each at most."""
    said = t.conversations.select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"))).alias("code")).distinct()
    heads = t.documents.groupBy(F.split_part("text", F.lit(" "), F.lit(1)).alias("code")).agg(F.min("doc_id").alias("doc_id"))
    met = said.join(heads, "code")
    return met.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("code"))).where("r <= 6").select("conv_id", "code", "doc_id")


@query("rag05_context_merge", "WITH a AS (SELECT 1 AS channel, p_partkey AS id FROM part WHERE p_size = 7 UNION ALL SELECT 2, p_partkey FROM part WHERE p_name LIKE '%a%' AND p_size < 4 UNION ALL SELECT 3, l_partkey FROM lineitem WHERE l_quantity = 50 AND l_tax = 0) SELECT id, min(channel) AS channel FROM a GROUP BY id ORDER BY channel, id LIMIT 40")
def context_merge(t: Tables) -> DataFrame:
    channels = [t.part.where("p_size = 7").select(F.lit(1).alias("channel"), F.col("p_partkey").alias("id")), t.part.where("p_name LIKE '%a%' AND p_size < 4").select(F.lit(2).alias("channel"), F.col("p_partkey").alias("id")), t.lineitem.where("l_quantity = 50 AND l_tax = 0").select(F.lit(3).alias("channel"), F.col("l_partkey").alias("id"))]
    both = channels[0].unionByName(channels[1]).unionByName(channels[2])
    return both.groupBy("id").agg(F.min("channel").alias("channel")).orderBy("channel", "id").limit(40)


@query("rag13_agentic_gate", r"SELECT conv_id, count(*) AS turns, max(len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}')))) >= 3 AND count(*) > 2 AS agentic FROM conversations GROUP BY conv_id")
def agentic_gate(t: Tables) -> DataFrame:
    mentions = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"))))
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), ((F.max(mentions) >= 3) & (F.count("*") > 2)).alias("agentic"))
