"""Context for an answer: bundles by marginal relevance within tiers, sections that texts refer to, merged channels, layers, the gate to more steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.texts import parent_codes, section_code, similarity
from ..registry import Tables, query
from .retrieval import _LISTS, _QUERIES, _TERMS, both_lists, fuse, nearest_to_each, text_scores
from .sections import _CHUNKS, coded_chunks
from .windows import first_by

# ---- bundles ----


def text_trigrams(text: Column) -> Column:
    """The distinct trigrams of a whole text, lower-cased and with white space squeezed, in one pass over it."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return F.array_distinct(F.regexp_extract_all(clean, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def mmr_order(items: Column, weight: float = 0.7) -> Column:
    """The refs of ``items`` (array<struct<ref, score, near map<ref, similarity>>>) by maximal marginal relevance: next is always the one of the highest
    weight * score - (1 - weight) * the greatest similarity to one already taken, the least ref of several.

    A fold over the bounded array, in as many steps as it has items. Values are compared to nine places; what ``near`` does not name is as far as can be.
    """

    def pick(taken: Column, _: Column) -> Column:
        left = F.filter(items, lambda c: ~F.array_contains(taken, c["ref"]))
        closest = lambda c: F.coalesce(F.array_max(F.transform(taken, lambda s: F.coalesce(F.element_at(c["near"], s), F.lit(0.0)))), F.lit(0.0))
        value = lambda c: F.round(F.lit(weight) * c["score"] - F.lit(1 - weight) * closest(c), 9)
        best = F.array_min(F.transform(left, lambda c: F.struct((-value(c)).alias("v"), c["ref"].alias("ref"))))
        return F.array_append(taken, best["ref"])

    return F.aggregate(F.sequence(F.lit(1), F.size(items)), F.array().cast("array<long>"), pick)


def bundles(found: DataFrame, texts: DataFrame, budget: int, weight: float = 0.7) -> DataFrame:
    """(query_id, number, item, tier, used) of ``found`` (query_id, item long, tier int, score 0 to 1; a top-k of each query) over ``texts``
    (item, text): the tiers in their order, within each the items by marginal relevance of their whole texts, cut where the ``budget`` of
    tokens (a quarter of the characters) is used up: nothing after the cut stays. A first item over the budget stays alone.
    """
    asked = found.select("item").distinct()
    rows = texts.join(asked, "item", "left_semi").select("item", F.expr("(length(coalesce(text, '')) + 3) div 4").alias("cost"), text_trigrams(F.col("text")).alias("grams"))
    rows = scratch.materialize(rows, "grams")
    kept = scratch.materialize(found.join(rows.select("item", "cost"), "item"), "found")
    other = kept.select("query_id", "tier", F.col("item").alias("other"))
    met = kept.select("query_id", "tier", "item").join(other, ["query_id", "tier"]).where("item < other")
    pairs = met.select("item", "other").distinct()
    grams = lambda end: rows.select(F.col("item").alias(end), F.col("grams").alias(f"{end}_grams"))
    near = pairs.join(grams("item"), "item").join(grams("other"), "other").select("item", "other", F.round(similarity(F.col("item_grams"), F.col("other_grams")), 9).alias("sim"))
    near = scratch.materialize(near.unionByName(near.select(F.col("other").alias("item"), F.col("item").alias("other"), "sim")), "near")
    sims = kept.select("query_id", "tier", "item").join(near, "item").join(other, ["query_id", "tier", "other"]).groupBy("query_id", "tier", "item").agg(F.map_from_entries(F.collect_list(F.struct("other", "sim"))).alias("near"))
    member = F.struct(F.col("item").alias("ref"), "score", F.coalesce("near", F.map_from_arrays(F.array().cast("array<long>"), F.array().cast("array<double>"))).alias("near"))
    layers = kept.join(sims, ["query_id", "tier", "item"], "left").groupBy("query_id", "tier").agg(F.collect_list(member).alias("items"))
    placed = layers.select("query_id", "tier", F.posexplode(mmr_order(F.col("items"), weight)).alias("place", "item")).join(kept.select("query_id", "item", "cost"), ["query_id", "item"])
    order = Window.partitionBy("query_id").orderBy("tier", "place")
    used = placed.withColumn("used", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("number", F.row_number().over(order))
    return used.where((F.col("used") <= budget) | (F.col("number") == 1)).select("query_id", "number", "item", "tier", "used")


_CLEAN = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(
    "rag06_bundles",
    f"""WITH RECURSIVE {_LISTS.removeprefix("WITH ")}, f AS (SELECT query_id, item, round(sum(1 / (60 + pos + 1)), 9) AS score, min(list_id * 1000 + pos) AS first FROM a GROUP BY 1, 2),
    t AS (SELECT query_id, doc_id AS item, CASE quality WHEN 1 THEN 1 WHEN 0 THEN 3 ELSE 2 END AS tier, score, (length(text) + 3) // 4 AS cost FROM (SELECT f.*, doc_id, text FROM f JOIN documents ON doc_id = item) LEFT JOIN labels USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, item) <= 12),
    c AS MATERIALIZED (SELECT query_id, item, tier, round(score / max(score) OVER (PARTITION BY query_id), 9) AS score, cost FROM t),
    cleaned AS (SELECT doc_id AS item, {_CLEAN} AS s FROM documents WHERE doc_id IN (SELECT item FROM c)), g AS MATERIALIZED (SELECT item, list_distinct(list_concat(regexp_extract_all(s, '(?s).{{3}}'), regexp_extract_all(substr(s, 2), '(?s).{{3}}'), regexp_extract_all(substr(s, 3), '(?s).{{3}}'))) AS g FROM cleaned),
    e AS (SELECT DISTINCT a.item, b.item AS other FROM c a JOIN c b ON a.query_id = b.query_id AND a.tier = b.tier AND a.item <> b.item),
    n AS (SELECT e.item, e.other, round(CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0 ELSE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) END, 9) AS sim FROM e JOIN g a ON a.item = e.item JOIN g b ON b.item = e.other),
    m AS MATERIALIZED (SELECT item, map(list(other), list(sim)) AS near FROM n GROUP BY item),
    picks AS (SELECT DISTINCT query_id, tier, CAST([] AS BIGINT[]) AS taken FROM c
      UNION ALL SELECT p.query_id, p.tier, list_append(p.taken, arg_min(c.item, (-round(0.7 * c.score - (1 - 0.7) * coalesce(list_max(list_transform(p.taken, lambda s: coalesce(m.near[s], 0))), 0), 9), c.item)))
      FROM picks p JOIN c ON c.query_id = p.query_id AND c.tier = p.tier AND NOT list_contains(p.taken, c.item) LEFT JOIN m ON m.item = c.item GROUP BY p.query_id, p.tier, p.taken),
    o AS (SELECT query_id, tier, taken[i] AS item, i AS place FROM (SELECT * FROM picks QUALIFY row_number() OVER (PARTITION BY query_id, tier ORDER BY len(taken) DESC) = 1), unnest(range(1, len(taken) + 1)) AS u(i)),
    u AS (SELECT o.query_id, o.item, o.tier, row_number() OVER w AS number, sum(cost) OVER w AS used FROM o JOIN c ON c.query_id = o.query_id AND c.item = o.item WINDOW w AS (PARTITION BY o.query_id ORDER BY o.tier, place))
    SELECT query_id, number, item, tier, CAST(used AS BIGINT) AS used FROM u WHERE used <= 4000 OR number = 1""",
)
def bundled(t: Tables) -> DataFrame:
    """The twelve best rows of each query's fused lists; good labels come first, unlabelled documents next, bad ones last."""
    fused = fuse(both_lists(t).withColumn("bonus", F.lit(0.0)), 60, "query_id")
    known = t.documents.select(F.col("doc_id").alias("item")).join(t.labels.select(F.col("doc_id").alias("item"), "quality"), "item", "left")
    tier = F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 3).otherwise(2)
    best = first_by(fused.join(known.select("item", tier.alias("tier")), "item"), ["query_id"], F.desc("score"), "first", "item", n=12)
    share = F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 9)  # twelve rows each
    return bundles(best.select("query_id", "item", "tier", share.alias("score")), t.documents.select(F.col("doc_id").alias("item"), "text"), 4000)


@query("rag06_mmr_budget")
def mmr_budget(t: Tables) -> DataFrame:
    """The forty longest texts of each language by marginal relevance of their whole texts, cut by a budget: a language is a query of one tier."""
    best = first_by(t.documents.where("lang IS NOT NULL").select("doc_id", "lang", "n_chars"), ["lang"], F.desc("n_chars"), "doc_id", n=40)
    share = F.col("n_chars") / F.greatest(F.lit(1), F.max("n_chars").over(Window.partitionBy("lang")))  # forty rows each
    found = best.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item"), F.lit(1).alias("tier"), share.alias("score"))
    made = bundles(found, t.documents.select(F.col("doc_id").alias("item"), "text"), 12_000)
    return made.select(F.col("query_id").alias("lang"), F.col("item").alias("doc_id"), F.col("number").alias("place"), "used")


# ---- sections that texts refer to ----

#: A reference: the sign and a code of numbers, points and a letter (fixed value).
REFERENCE = r"§\s*(\d{1,4}(?:\.\d+)*(?:\.?[a-z])?)"


def backfilled(context: DataFrame, chunks: DataFrame, tiers: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, number, code, source, chunk_index): the sections that the texts of a context refer to and that it lacks.

    ``context`` (query_id, place, text, source, code) is a bounded list for each query, in order (the question last, without source and code),
    ``chunks`` (source, code, chunk_index) the index, ``tiers`` (source, tier) the authority. A code that the index lacks falls back to its
    nearest ancestor there; codes of the context and repeats go; the first ``most`` by mention stay. Of a section's chunks the one of a source
    of the context comes first, then the better tier, then the earlier chunk.
    """
    said = context.select("query_id", "place", F.posexplode(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1))).alias("at", "raw"))
    said = said.groupBy("query_id", section_code(F.col("raw")).alias("said")).agg(F.min(F.struct("place", "at")).alias("first"))
    ways = said.select("query_id", "said", "first", F.posexplode(F.concat(F.array("said"), F.reverse(parent_codes(F.col("said"))))).alias("up", "code"))
    known = chunks.where("code IS NOT NULL").select("code").distinct()
    resolved = ways.join(known, "code").groupBy("query_id", "said", "first").agg(F.min_by("code", "up").alias("code"))
    present = context.where("code IS NOT NULL").select("query_id", "code").distinct()
    lacking = resolved.join(present, ["query_id", "code"], "left_anti").groupBy("query_id", "code").agg(F.min("first").alias("first"))
    chosen = lacking.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).where(F.col("number") <= most)
    own = context.where("source IS NOT NULL").select("query_id", "source").distinct().withColumn("own", F.lit(0))
    # A code that every document has meets one chunk of each source at most, and of all sources the best: never all its chunks.
    chosen = scratch.materialize(chosen, "chosen")
    first = chunks.where("code IS NOT NULL").groupBy("source", "code").agg(F.min("chunk_index").alias("chunk_index")).join(tiers, "source", "left")
    first = scratch.materialize(first.select("code", "source", F.struct(F.coalesce("tier", F.lit(2**31 - 1)).alias("tier"), "chunk_index", "source").alias("b")), "first")
    of_own = chosen.join(own, "query_id").join(first, ["source", "code"]).select("query_id", "number", "code", F.struct("own", "b").alias("w"))
    of_all = chosen.join(first.groupBy("code").agg(F.min("b").alias("b")), "code").select("query_id", "number", "code", F.struct(F.lit(1).alias("own"), "b").alias("w"))
    return of_own.unionByName(of_all).groupBy("query_id", "number", "code").agg(F.min("w").alias("w")).select("query_id", "number", "code", "w.b.source", "w.b.chunk_index")


@query(
    "rag03_sections",
    rf"""WITH {_CHUNKS}, ix AS (SELECT source, regexp_replace(code, '^\d+\.', '') AS code, chunk_index FROM chunks WHERE contains(code, '.')),
    tiers AS (SELECT source, count(*) FILTER (toxic = 1) AS tier FROM documents JOIN labels USING (doc_id) GROUP BY source),
    ctx AS (SELECT conv_id AS query_id, turn AS place, text || ' §' || length(text) % 40 || '.' || turn % 3 || ' §' || length(text) % 11 || '.9a § ' || turn AS text, NULL AS source, NULL AS code FROM conversations
      UNION ALL SELECT conv_id, -1, 'see §3.1, §900.1', source, length(text) % 5 || '.1' FROM (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY conv_id) JOIN documents ON doc_id = conv_id),
    r AS (SELECT query_id, place, i, m[i] AS raw FROM (SELECT *, regexp_extract_all(text, '§\s*(\d{{1,4}}(?:\.\d+)*(?:\.?[a-z])?)', 1) AS m FROM ctx), unnest(range(1, len(m) + 1)) AS u(i)),
    s AS (SELECT query_id, CASE WHEN regexp_matches(raw, '[a-z]$') THEN rtrim(regexp_replace(raw, '[a-z]$', ''), '.') || '.' || right(raw, 1) ELSE raw END AS said, min((place, i)) AS first FROM r GROUP BY ALL),
    w AS (SELECT query_id, said, first, k, array_to_string(string_split(said, '.')[1:k], '.') AS code FROM s, unnest(range(1, len(string_split(said, '.')) + 1)) AS u(k)),
    z AS (SELECT query_id, said, first, arg_max(code, k) AS code FROM w WHERE code IN (SELECT code FROM ix) GROUP BY ALL),
    l AS (SELECT query_id, code, min(first) AS first FROM z WHERE NOT EXISTS (SELECT 1 FROM ctx WHERE ctx.query_id = z.query_id AND ctx.code = z.code) GROUP BY ALL),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS number FROM l QUALIFY number <= 6)
    SELECT query_id, number, c.code, ix.source, chunk_index FROM c JOIN ix USING (code) LEFT JOIN tiers ON tiers.source = ix.source
    QUALIFY row_number() OVER (PARTITION BY query_id, number ORDER BY CASE WHEN EXISTS (SELECT 1 FROM ctx WHERE ctx.query_id = c.query_id AND ctx.source = ix.source) THEN 0 ELSE 1 END, coalesce(tier, 2147483647), chunk_index, ix.source) = 1""",
)
def backfilled_sections(t: Tables) -> DataFrame:
    """Conversations that refer to numbered lines of documents; codes are the same in every document, so the source decides."""
    chunks = coded_chunks(t).where(F.contains("code", F.lit("."))).select("source", F.regexp_replace("code", r"^\d+\.", "").alias("code"), "chunk_index")
    tiers = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("tier"))
    n = F.length("text")
    text = F.concat("text", F.lit(" §"), n % 40, F.lit("."), F.col("turn") % 3, F.lit(" §"), n % 11, F.lit(".9a § "), "turn")
    none = F.lit(None).cast("string")
    turns = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), text.alias("text"), none.alias("source"), none.alias("code"))
    heads = t.conversations.select(F.col("conv_id").alias("doc_id")).distinct().join(t.documents, "doc_id")
    found = heads.select(F.col("doc_id").alias("query_id"), F.lit(-1).cast("long").alias("place"), F.lit("see §3.1, §900.1").alias("text"), "source", F.concat(F.length("text") % 5, F.lit(".1")).alias("code"))
    return backfilled(turns.unionByName(found), chunks, tiers)


# ---- layers, channels, escalation ----


def layered(lists: DataFrame, of: DataFrame, order: list[str], take: int, depth: int = 30) -> DataFrame:
    """(query_id, layer, place, item, score): in each layer the lists of a query are cut to ``depth``, fused, and give ``take`` items.

    ``lists`` (query_id, list_id, item, worth: more is better), ``of`` (item, layer); ``order`` names the layers searched, the highest first.
    """
    rows = lists.join(of.where(F.col("layer").isin(order)), "item")
    place = F.row_number().over(Window.partitionBy("query_id", "layer", "list_id").orderBy(F.desc("worth"), "item"))
    cut = rows.withColumn("pos", place - 1).where(F.col("pos") < depth).withColumn("bonus", F.lit(0.0))
    fused = fuse(cut, 60, "query_id", "layer")
    best = fused.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "layer").orderBy(F.desc("score"), "first", "item"))).where(F.col("place") <= take)
    return best.select("query_id", "layer", F.array_position(F.array(*map(F.lit, order)), F.col("layer")).cast("int").alias("rank"), "place", "item", F.bround("score", 4).alias("score"))


@query(
    "rag02_fused_layers",
    f"""WITH {_TERMS}, v AS (SELECT query_id, 1 AS list_id, vec_id AS item, place, -place AS worth FROM ({_QUERIES} WHERE q.vec_id IN (SELECT item_id FROM benchmark) QUALIFY place <= 100)),
    l AS (SELECT query_id, list_id, item, CAST(worth AS DOUBLE) AS worth FROM v UNION ALL SELECT query_id, 2, doc_id, score FROM s),
    kinds AS (SELECT doc_id AS item, CASE quality WHEN 1 THEN 'checked' WHEN 0 THEN 'doubtful' ELSE lang END AS layer FROM documents LEFT JOIN labels USING (doc_id)),
    c AS (SELECT query_id, layer, list_id, item, row_number() OVER (PARTITION BY query_id, layer, list_id ORDER BY worth DESC, item) - 1 AS pos FROM l JOIN kinds USING (item) WHERE layer IN ('checked', 'en', 'de', 'fr', 'doubtful') QUALIFY pos < 30),
    f AS (SELECT query_id, layer, item, round(sum(1 / (60 + pos + 1)), 9) AS score, min(list_id * 1000 + pos) AS first FROM c GROUP BY ALL)
    SELECT query_id, layer, list_position(['checked', 'en', 'de', 'fr', 'doubtful'], layer) AS rank, row_number() OVER (PARTITION BY query_id, layer ORDER BY score DESC, first, item) AS place, item, round_even(score, 4) AS score FROM f QUALIFY place <= 5""",
)
def fused_layers(t: Tables) -> DataFrame:
    """Vector and text lists fused in each layer: labelled documents above and below the unlabelled ones of each language."""
    asked = t.benchmark.select(F.col("item_id").alias("vec_id")).distinct()
    vectors = t.embeddings.join(asked, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    by_vector = nearest_to_each(t.embeddings, vectors, 100).select("query_id", F.lit(1).alias("list_id"), F.col("vec_id").alias("item"), (-F.col("place")).cast("double").alias("worth"))
    by_text = text_scores(t).select("query_id", F.lit(2).alias("list_id"), F.col("doc_id").alias("item"), F.col("score").alias("worth"))
    layer = F.when(F.col("quality") == 1, "checked").when(F.col("quality") == 0, "doubtful").otherwise(F.col("lang"))
    of = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("item"), layer.alias("layer"))
    return layered(by_vector.unionByName(by_text), of, ["checked", "en", "de", "fr", "doubtful"], 5)


def merged_channels(channels: list[tuple[DataFrame, int]], total: int) -> DataFrame:
    """(query_id, number, item, channel): the first rows of each channel (query_id, pos, item) up to its own cap, one channel after the other,
    every item at its first place, ``total`` at most for each query."""
    parts = [df.withColumn("_p", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "item"))).where(F.col("_p") <= cap).select("query_id", "item", F.lit(k + 1).alias("channel"), "_p") for k, (df, cap) in enumerate(channels)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    once = rows.groupBy("query_id", "item").agg(F.min(F.struct("channel", "_p")).alias("first"))
    best = once.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "item"))).where(F.col("number") <= total)
    return best.select("query_id", "number", "item", F.col("first.channel").alias("channel"))


@query(
    "rag05_channels",
    """WITH q AS (SELECT DISTINCT p_brand AS query_id, p_name AS name FROM part WHERE p_size <= 25), w AS (SELECT DISTINCT query_id, unnest(string_split(name, ' ')) AS word FROM q),
    c AS (SELECT query_id, 1 AS channel, row_number() OVER (PARTITION BY query_id ORDER BY p_size, p_partkey) AS p, p_partkey AS item FROM q JOIN part ON p_name = name QUALIFY p <= 3
      UNION ALL SELECT query_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY -count(*), p_partkey) AS p, p_partkey FROM w JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) USING (word) GROUP BY query_id, p_partkey QUALIFY p <= 8
      UNION ALL SELECT query_id, 3, row_number() OVER (PARTITION BY query_id ORDER BY r, p_partkey) AS p, p_partkey FROM (SELECT DISTINCT query_id, p_partkey, min(r) AS r FROM (SELECT query_id, word FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY word) <= 2) JOIN
        (SELECT word, p_partkey, row_number() OVER (PARTITION BY word ORDER BY p_partkey) AS r FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) QUALIFY r <= 4) USING (word) GROUP BY query_id, p_partkey) QUALIFY p <= 8
      UNION ALL SELECT p_brand, 4, row_number() OVER (PARTITION BY p_brand ORDER BY -p_retailprice, p_partkey) AS p, p_partkey FROM part QUALIFY p <= 4),
    f AS (SELECT query_id, item, min(channel * 1000 + p) AS first FROM c GROUP BY ALL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first, item) AS number, item, first // 1000 AS channel FROM f QUALIFY number <= 16""",
)
def channels(t: Tables) -> DataFrame:
    """For each brand as a question: items named by it, items that share most of its words, examples of its first words, its dearest items."""
    names = t.part.where("p_size <= 25").select(F.col("p_brand").alias("query_id"), F.col("p_name").alias("name")).distinct()
    words = names.select("query_id", F.explode(F.split("name", " ")).alias("word")).distinct()
    # Items of one name are alike to the first channels, so the first ones of each name stand for all; ``p_partkey`` is a key.
    of_name = lambda n, *order: t.part.select("p_name", "p_size", "p_partkey").where("p_name IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("p_name").orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    items = scratch.materialize(of_name(8, "p_partkey"), "items").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    named = names.join(of_name(3, "p_size", "p_partkey"), F.col("p_name") == F.col("name")).select("query_id", F.struct("p_size", "p_partkey").alias("pos"), F.col("p_partkey").alias("item"))
    lexical = words.join(items, "word").groupBy("query_id", F.col("p_partkey").alias("item")).agg((-F.count("*")).alias("pos"))
    examples = items.withColumn("pos", F.row_number().over(Window.partitionBy("word").orderBy("p_partkey"))).where("pos <= 4")
    two = words.withColumn("_w", F.row_number().over(Window.partitionBy("query_id").orderBy("word"))).where("_w <= 2")
    mechanic = two.join(examples, "word").groupBy("query_id", F.col("p_partkey").alias("item")).agg(F.min("pos").alias("pos"))
    dear = t.part.select(F.col("p_brand").alias("query_id"), (-F.col("p_retailprice")).alias("pos"), F.col("p_partkey").alias("item"))
    return merged_channels([(named, 3), (lexical, 8), (mechanic, 8), (dear, 4)], 16)


def distinct_mentions(mentions: DataFrame, key: str, name: str) -> DataFrame:
    """(key, mentions): how many different names each key mentions, in any case, without those that a longer one of its names contains.

    A name is contained in a longer one as one of its stretches of characters: stretches of the lengths that names have meet
    names by equality, so no two names are compared one by one.
    """
    rows = scratch.materialize(mentions.select(key, F.lower(name).alias("n")).where("trim(n) <> ''").distinct(), "mentions")
    lengths = sorted(r[0] for r in rows.select(F.length("n")).distinct().collect())  # one row for each length of a name
    if not lengths:
        return rows.groupBy(key).agg(F.count("*").alias("mentions"))
    size = F.array(*map(F.lit, lengths))
    parts = F.flatten(F.transform(F.filter(size, lambda x: x < F.length("n")), lambda x: F.transform(F.sequence(F.lit(1), F.length("n") - x + 1), lambda i: F.substring("n", i, x))))
    inside = rows.select(F.col(key).alias("_k"), F.explode(parts).alias("_part")).distinct()
    held = rows.join(inside, F.col(key).eqNullSafe(F.col("_k")) & (F.col("n") == F.col("_part")), "left")
    return held.groupBy(key).agg(F.count_if(F.col("_part").isNull()).alias("mentions"))


def escalates(kind: Column, mentions: Column, empty: Column, mode: Column, image: Column) -> Column:
    """Whether a question goes to several steps: never with an image, always when forced; else where a ruling has two names or nothing was found."""
    return F.when(image, False).when(mode == "force", True).when(mode == "auto", ((kind == "ruling") & (mentions >= 2)) | empty).otherwise(False)


@query(
    "rag13_escalation",
    r"""WITH m AS (SELECT DISTINCT conv_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}'))) AS n FROM conversations),
    d AS (SELECT conv_id, count(*) AS mentions FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.conv_id = a.conv_id AND length(b.n) > length(a.n) AND contains(b.n, a.n)) GROUP BY conv_id),
    c AS (SELECT conv_id, count(*) AS turns, bool_or(contains(text, '?')) AS asks, max(length(text)) AS longest FROM conversations GROUP BY conv_id)
    SELECT conv_id, coalesce(mentions, 0) AS mentions, CASE WHEN longest > 3000 THEN false WHEN turns > 6 THEN true ELSE (turns <= 4 AND coalesce(mentions, 0) >= 2) OR longest < 40 END AS agentic FROM c LEFT JOIN d USING (conv_id)""",
)
def escalation(t: Tables) -> DataFrame:
    """Conversations as questions: names are capitalised words, long talks are forced, very long texts stand for images."""
    said = t.conversations.select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{2,})"))).alias("name"))
    talks = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.length("text")).alias("longest"))
    rows = talks.join(distinct_mentions(said, "conv_id", "name"), "conv_id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    kind, mode = F.when(F.col("turns") <= 4, "ruling").otherwise("other"), F.when(F.col("turns") > 6, "force").otherwise("auto")
    return rows.select("conv_id", "mentions", escalates(kind, F.col("mentions"), F.col("longest") < 40, mode, F.col("longest") > 3000).alias("agentic"))
