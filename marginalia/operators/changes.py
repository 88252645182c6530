"""Change detection, upserts as frames, and text pipelines: sections, chunks, keywords, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..registry import ORACLES, Tables, query
from .ranges import previous, running


def upserted(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` inserted or merged over it column by column: new values win where they aren't null."""
    o, n = old.select(key, *(F.col(v).alias(f"_o_{v}") for v in values)), new.select(key, *(F.col(v).alias(f"_n_{v}") for v in values))
    return o.join(n, key, "full").select(key, *(F.coalesce(f"_n_{v}", f"_o_{v}").alias(v) for v in values))


@query("snk01_upsert", "WITH o AS (SELECT p_partkey AS k, p_size AS size, p_brand AS brand FROM part WHERE p_partkey % 3 > 0), n AS (SELECT p_partkey AS k, p_size + 100 AS size, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand FROM part WHERE p_partkey % 3 < 2) SELECT coalesce(o.k, n.k) AS k, coalesce(n.size, o.size) AS size, coalesce(n.brand, o.brand) AS brand FROM o FULL JOIN n ON o.k = n.k")
def upsert(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    new = p.where("k % 3 < 2").select("k", (F.col("size") + 100).alias("size"), F.when(F.col("k") % 2 == 0, F.col("brand")).alias("brand"))
    return upserted(p.where("k % 3 > 0"), new, "k", ["size", "brand"])


@query("snk04_conditional_update", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 40 ELSE p_size END AS p_size FROM part")
def conditional_update(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(F.col("p_size") > 40, 40).otherwise(F.col("p_size")).alias("p_size"))


@query("snk05_purge", "SELECT event_id FROM events WHERE NOT (ts < (SELECT max(ts) FROM events) - INTERVAL 14 DAY AND event_type = 'error')")
def purge(t: Tables) -> DataFrame:
    rows = t.events.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("now"))))
    return rows.where("NOT (ts < now - INTERVAL 14 DAYS AND event_type = 'error')").select("event_id")


@query("snk06_reconcile", "WITH o AS (SELECT DISTINCT l_partkey AS k, 'old' AS detected FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT DISTINCT l_partkey AS k, 'new' AS detected FROM lineitem WHERE l_quantity > 49) SELECT n.k, coalesce(o.detected, n.detected) AS detected FROM n LEFT JOIN o ON o.k = n.k")
def reconcile_by_key(t: Tables) -> DataFrame:
    """Keeps the first detection of what is still there, inserts what is new, leaves out what has gone."""
    keys = lambda where: t.lineitem.where(where).select(F.col("l_partkey").alias("k")).distinct()
    return keys("l_quantity > 49").join(keys("l_returnflag = 'A'").withColumn("o", F.lit("old")), "k", "left").select("k", F.coalesce("o", F.lit("new")).alias("detected"))


@query("snk08_repoint", "SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT l_partkey // 2 AS x, l_suppkey // 2 AS y FROM lineitem) WHERE x <> y")
def repoint(t: Tables) -> DataFrame:
    """Pairs after their keys were merged two by two: ordered again, without pairs of one key and without repeats."""
    pairs = t.lineitem.select(F.expr("l_partkey div 2").alias("x"), F.expr("l_suppkey div 2").alias("y")).where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


@query("snk11_monotone", "SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) AS strength FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.value > 95) GROUP BY user_id")
def monotone(t: Tables) -> DataFrame:
    """The strongest status of each key; keys with a live tombstone are left out."""
    tombstones = t.events.where("event_type = 'error' AND value > 95").select("user_id")
    strength = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    return t.events.join(tombstones, "user_id", "left_anti").groupBy("user_id").agg(F.max(strength).alias("strength"))


@query("cdc01_hash_gate", r"SELECT doc_id, coalesce(h <> lag(h) OVER (PARTITION BY source ORDER BY doc_id), true) AS changed FROM (SELECT doc_id, source, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents)")
def hash_gate(t: Tables) -> DataFrame:
    h = t.documents.select("doc_id", "source", F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256).alias("h"))
    return previous(h, ["source"], ["doc_id"], "before", F.col("h")).select("doc_id", F.coalesce(F.col("h") != F.col("before"), F.lit(True)).alias("changed"))


@query("cdc05_change_feed", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'login' AND value > 10 ORDER BY ts DESC, event_id DESC LIMIT 50")
def change_feed(t: Tables) -> DataFrame:
    return t.events.where("event_type <> 'login' AND value > 10").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "value")


@query("cdc06_recheck_plan", "SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{10,}'))) AS w FROM documents) JOIN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{10,}')) AS w FROM benchmark) USING (w)")
def recheck_plan(t: Tables) -> DataFrame:
    changed = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{10,})"))).alias("w")).distinct()
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{10,})")))).alias("w"))
    return words.join(changed, "w", "left_semi").select("doc_id").distinct()


@query("cdc08_upgrade_plan", "SELECT vec_id, place <= 40 AS now FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings WHERE label <> 3)")
def upgrade_plan(t: Tables) -> DataFrame:
    placed = running(t.embeddings.where("label <> 3").select("vec_id", "label"), ["label"], ["vec_id"], "place")
    return placed.select("vec_id", (F.col("place") <= 40).alias("now"))


@query("cdc09_staleness", "SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 1000 THEN 'small' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN year(o_orderdate) < 1993 THEN 'old' END], lambda x: x IS NOT NULL) AS reasons FROM orders")
def staleness(t: Tables) -> DataFrame:
    triggers = [F.when(F.col("o_totalprice") < 1000, "small"), F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.year("o_orderdate") < 1993, "old")]
    return t.orders.select("o_orderkey", F.array_compact(F.array(*triggers)).alias("reasons"))


@query("cdc10_lifecycle", "WITH a(x, y) AS (VALUES ('view', 'click'), ('click', 'purchase'), ('login', 'view'), ('view', 'view')) SELECT event_id, before IS NULL OR x IS NOT NULL AS valid FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) LEFT JOIN a ON x = before AND y = event_type")
def lifecycle(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([("view", "click"), ("click", "purchase"), ("login", "view"), ("view", "view")], "before string, event_type string").withColumn("ok", F.lit(True))
    steps = t.events.select("event_id", "event_type", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))
    return steps.join(F.broadcast(allowed), ["before", "event_type"], "left").select("event_id", (F.col("before").isNull() | F.col("ok").isNotNull()).alias("valid"))


@query("cdc11_gaps", "SELECT event_type, count(*) FILTER (value < 5) AS empties, count(*) FILTER (event_type = 'error') AS failures, max(ts) AS last_seen FROM events GROUP BY 1")
def gaps(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_if(F.col("value") < 5).alias("empties"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max("ts").alias("last_seen"))


def sentences(text: Column) -> Column:
    """The sentences of a text: split after a full stop and white space, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\.\s+"), lambda s: F.trim(s)), lambda s: s != "")


@query("txt01_sections", "SELECT doc_id, i - 1 AS section, left(trim(s[i]), 60) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i) WHERE length(trim(s[i])) > 40")
def sections(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "body"))
    return rows.where(F.length(F.trim("body")) > 40).select("doc_id", F.col("section").cast("long").alias("section"), F.left(F.trim("body"), F.lit(60)).alias("body"))


@query("txt02_overlap_chunks", "SELECT doc_id, c AS chunk, substr(text, c * 780 + 1, 900) AS body FROM documents, unnest(range(0, greatest(1, (length(text) - 120 + 779) // 780))) AS u(c)")
def overlap_chunks(t: Tables) -> DataFrame:
    """Chunks of 900 characters that share 120 with the one before."""
    last = F.greatest(F.lit(0), F.expr("(length(text) - 120 + 779) div 780") - 1)
    rows = t.documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk"))
    return rows.select("doc_id", "chunk", F.substring("text", F.col("chunk").cast("int") * 780 + 1, F.lit(900)).alias("body"))


@query("txt06_harvest", "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS term FROM documents) WHERE lower(term) NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark) GROUP BY 1 HAVING count(*) > 2")
def harvest(t: Tables) -> DataFrame:
    known = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("w")).distinct()
    counted = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{6,})"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where("n > 2")
    return counted.join(known, F.lower("term") == F.col("w"), "left_anti")


@query("txt07_context", "SELECT doc_id, CASE WHEN p > 61 THEN '…' ELSE '' END || substr(text, greatest(1, p - 60), p - greatest(1, p - 60) + 60) || CASE WHEN p + 60 <= length(text) THEN '…' ELSE '' END AS snippet FROM (SELECT doc_id, text, instr(text, 'tion') AS p FROM documents) WHERE p > 0")
def context(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", F.locate("tion", "text").alias("p")).where("p > 0")
    start = F.greatest(F.lit(1), F.col("p") - 60)
    snippet = F.concat(F.when(F.col("p") > 61, "…").otherwise(""), F.substring("text", start, F.col("p") - start + 60), F.when(F.col("p") + 60 <= F.length("text"), "…").otherwise(""))
    return rows.select("doc_id", snippet.alias("snippet"))


@query("txt08_shortest_definition", "SELECT lang, min(length(s)) AS chars FROM (SELECT lang, trim(unnest(string_split(text, chr(10)))) AS s FROM documents) WHERE s <> '' GROUP BY lang")
def shortest_definition(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", F.explode(F.split("text", "\n")).alias("s")).select("lang", F.trim("s").alias("s")).where("s <> ''")
    return rows.groupBy("lang").agg(F.min(F.length("s")).alias("chars"))


@query("txt09_evidence_gate", r"SELECT doc_id, regexp_matches(text, '\[[^\]]+\]') AS bracketed, regexp_matches(lower(text), '(^|[^\pL])(may|can|peut|kann)([^\pL]|$)') AS optional FROM documents")
def evidence_gate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("text").rlike(r"\[[^\]]+\]").alias("bracketed"), F.lower("text").rlike(r"(^|[^\pL])(may|can|peut|kann)([^\pL]|$)").alias("optional"))


@query("txt10_promotion", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'review' ELSE 'verified' END AS status, toxic = 1 AS tombstone FROM labels")
def promotion(t: Tables) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "review").otherwise("verified")
    return t.labels.select("doc_id", status.alias("status"), (F.col("toxic") == 1).alias("tombstone"))


@query("txt12_support_tokens", "SELECT doc_id, len(list_filter(list_distinct(string_split(lower(text), ' ')), lambda w: length(w) >= 4)) AS support FROM documents")
def support_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.filter(F.array_distinct(F.split(F.lower("text"), " ")), lambda w: F.length(w) >= 4)).cast("long").alias("support"))


@query("snk03_replace_partition", "SELECT doc_id, lang, 'old' AS origin FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id + 1000000, lang, 'new' FROM documents WHERE lang = 'fr' AND n_chars > 100")
def replace_partition(t: Tables) -> DataFrame:
    """One partition is replaced as a whole, the others stay: the frame that a dynamic partition overwrite leaves."""
    new = t.documents.where("lang = 'fr' AND n_chars > 100").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "lang", F.lit("new").alias("origin"))
    return t.documents.where("lang <> 'fr'").select("doc_id", "lang", F.lit("old").alias("origin")).unionByName(new)


@query("cdc02_flip_flop", "SELECT doc_id, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) > 1 AND md5(text) IS DISTINCT FROM lag(md5(text)) OVER (PARTITION BY source ORDER BY doc_id) AS flip FROM documents")
def flip_flop(t: Tables) -> DataFrame:
    """A content that was seen before, though not just before."""
    return flips(t.documents)


def flips(docs: DataFrame) -> DataFrame:
    """(doc_id, flip) of ``docs`` (doc_id, source, text): whole texts that their source had before, though not just before.

    Rows are dealt by ranges of (source, doc_id), so one source may spread over many tasks; the first row of a range
    takes the text before it from the ranges of its source that come earlier.
    """
    h = docs.select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    firsts = h.groupBy("source", "h").agg(F.min("doc_id").alias("first")).alias("f")
    rows = previous(h, ["source"], ["doc_id"], "before", F.col("h")).alias("r")
    rows = rows.join(firsts, F.col("r.source").eqNullSafe(F.col("f.source")) & F.col("r.h").eqNullSafe(F.col("f.h")))
    return rows.select("r.doc_id", ((F.col("first") < F.col("r.doc_id")) & ~F.col("r.h").eqNullSafe(F.col("before"))).alias("flip"))


@query("cdc02_flip_flop_whole", ORACLES["cdc02_flip_flop"])
def flip_flop_whole(t: Tables) -> DataFrame:
    return flips(t.documents)


@query("cdc07_invalidation", "SELECT DISTINCT a.l_partkey AS erratum, b.l_partkey AS dependent FROM lineitem a JOIN part ON p_partkey = a.l_partkey AND p_size = 1 JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE b.l_partkey <> a.l_partkey")
def invalidation(t: Tables) -> DataFrame:
    """For each erratum (a changed item) what depends on it, itself left out: whatever shares an order with it."""
    errata = t.part.where("p_size = 1").select(F.col("p_partkey").alias("erratum"))
    hit = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("erratum")).join(errata, "erratum").distinct()
    return t.lineitem.select("l_orderkey", F.col("l_partkey").alias("dependent")).join(hit, "l_orderkey").where("dependent <> erratum").select("erratum", "dependent").distinct()


_FOLDED = "trim(regexp_replace(lower(translate({0}, '\u2018\u2019\u02bc\u2032\u201c\u201d\u2033\u2013\u2014\u2212\u00a0\u202f\u2009', '" + "''" * 4 + '"""---   ' + "')), '\\s+', ' ', 'g'))"


@query("txt11_grounded_quote", f"WITH f AS (SELECT doc_id, {_FOLDED.format('text')} AS low FROM documents), q AS (SELECT item_id, {_FOLDED.format('text')} AS quote FROM benchmark) SELECT item_id, (SELECT count(DISTINCT doc_id) FROM f WHERE quote <> '' AND contains(low, quote)) AS texts FROM q")
def grounded_quote(t: Tables) -> DataFrame:
    return grounded(t.benchmark, t.documents)


def grounded(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, texts): in how many of ``docs`` (doc_id, text) the whole quote (item_id, text) stands, 0 where in none.

    Case, blanks, quotation marks and dashes are folded. The second and third word of a quote of four or more are whole
    words of any text that holds it and make the equi key; all texts are searched for shorter quotes. A blank quote is in none.
    """
    plain = lambda c: F.translate(c, "\u2018\u2019\u02bc\u2032\u201c\u201d\u2033\u2013\u2014\u2212\u00a0\u202f\u2009", "'" * 4 + '"' * 3 + "-" * 3 + " " * 3)
    folded = lambda c: F.trim(F.regexp_replace(F.lower(plain(c)), r"\s+", " "))
    every = quotes.select("item_id", folded("text").alias("quote"))
    asked = every.where("quote <> ''").distinct().withColumn("q", F.split("quote", " "))
    texts = docs.select("doc_id", folded("text").alias("low"))
    long = asked.where(F.size("q") > 3).select("item_id", "quote", F.concat_ws(" ", F.col("q")[1], F.col("q")[2]).alias("key"))
    w = F.split("low", " ")
    pairs = F.array_distinct(F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.lit(1), F.size(w))), lambda x, y: F.concat_ws(" ", x, y)))
    near = texts.select("doc_id", F.explode(pairs).alias("key")).join(scratch.maybe_broadcast(long), "key").select("doc_id", "item_id", "quote")
    # Texts that no key leads to are not read again: only the rows of candidate ids are folded and searched.
    near = scratch.materialize(near, "near")
    asked_of = docs.join(scratch.maybe_broadcast(near.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", folded("text").alias("low"))
    found = near.join(asked_of, "doc_id").where(F.contains("low", "quote")).select("item_id", "doc_id")
    short = texts.join(scratch.maybe_broadcast(asked.where(F.size("q") <= 3)), F.contains("low", "quote")).select("item_id", "doc_id")
    counts = found.unionByName(short).groupBy("item_id").agg(F.countDistinct("doc_id").alias("texts"))
    return every.select("item_id").distinct().join(counts, "item_id", "left").select("item_id", F.coalesce("texts", F.lit(0)).alias("texts"))


@query("txt11_grounded_quote_whole", ORACLES["txt11_grounded_quote"])
def grounded_quote_whole(t: Tables) -> DataFrame:
    return grounded(t.benchmark, t.documents)


@query("txt05_keywords", r"SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\b[A-Z][a-z]+ ?[0-9]*'), lambda x: trim(regexp_replace(x, '[0-9]+', ''))), lambda x: length(x) BETWEEN 8 AND 20))) AS terms FROM documents")
def keywords(t: Tables) -> DataFrame:
    raw = F.regexp_extract_all("text", F.lit(r"((?<![A-Za-z0-9_])[A-Z][a-z]+ ?[0-9]*)"))
    bare = F.filter(F.transform(raw, lambda x: F.trim(F.regexp_replace(x, "[0-9]+", ""))), lambda x: F.length(x).between(8, 20))
    return t.documents.select("doc_id", F.array_sort(F.array_distinct(bare)).alias("terms"))


@query("cdc03_rebaseline", r"""WITH h AS (SELECT doc_id, source, doc_id // 50 AS parser, sha256(text) AS h FROM documents), l AS (SELECT *, lag(parser) OVER w AS p, lag(h) OVER w AS b FROM h WINDOW w AS (PARTITION BY source ORDER BY doc_id))
    SELECT doc_id, CASE WHEN p IS NULL THEN 'new' WHEN p <> parser THEN 'rebaselined' WHEN b = h THEN 'same' ELSE 'changed' END AS state FROM l""")
def rebaseline(t: Tables) -> DataFrame:
    """A text of another parser version gives a new baseline and no change; only texts of one version are held against each other."""
    h = t.documents.select("doc_id", "source", F.floor(F.col("doc_id") / 50).alias("parser"), F.sha2("text", 256).alias("h"))
    rows = previous(h, ["source"], ["doc_id"], "b", F.struct("parser", "h"))
    state = F.when(F.col("b").isNull(), "new").when(F.col("b.parser") != F.col("parser"), "rebaselined").when(F.col("b.h") == F.col("h"), "same").otherwise("changed")
    return rows.select("doc_id", state.alias("state"))


@query("cdc04_real_differences", r"""WITH s AS (SELECT doc_id, md5(text) AS h, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS l FROM documents),
    v AS (SELECT doc_id, doc_id + 1 AS next_id, h, l FROM s UNION ALL SELECT doc_id, -doc_id - 1, h, l FROM s), n AS (SELECT doc_id AS next_id, h, l FROM s UNION ALL SELECT -doc_id - 1, md5('again ' || h), list_reverse(l) FROM s)
    SELECT v.doc_id, v.next_id, len(list_filter(n.l, lambda x: NOT list_contains(v.l, x))) AS inserted, len(list_filter(v.l, lambda x: NOT list_contains(n.l, x))) AS deleted FROM v JOIN n USING (next_id) WHERE v.h <> n.h AND len(list_filter(n.l, lambda x: NOT list_contains(v.l, x))) + len(list_filter(v.l, lambda x: NOT list_contains(n.l, x))) > 0""")
def real_differences(t: Tables) -> DataFrame:
    """Versions with another hash are a change only if some line is new or gone: the same lines in another order or layout are none."""
    bare = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))
    s = t.documents.select("doc_id", F.md5("text").alias("h"), bare.alias("l"))
    old = s.select("doc_id", (F.col("doc_id") + 1).alias("next_id"), "h", "l").unionByName(s.select("doc_id", (-F.col("doc_id") - 1).alias("next_id"), "h", "l"))
    turned = s.select((-F.col("doc_id") - 1).alias("next_id"), F.md5(F.concat(F.lit("again "), "h")).alias("nh"), F.reverse("l").alias("nl"))
    new = s.select(F.col("doc_id").alias("next_id"), F.col("h").alias("nh"), F.col("l").alias("nl")).unionByName(turned)
    both = old.join(new, "next_id").where("h <> nh")
    counted = both.select("doc_id", "next_id", F.size(F.array_except("nl", "l")).cast("long").alias("inserted"), F.size(F.array_except("l", "nl")).cast("long").alias("deleted"))
    return counted.where("inserted + deleted > 0")


#: Days after which a fact of a tier is looked at again; null never.
STALE_DAYS = {"1-URGENT": None, "2-HIGH": 730, "3-MEDIUM": 365, "4-NOT SPECIFIED": 210, "5-LOW": 30}


@query("cdc09_triggers", """WITH m AS (SELECT max(o_orderdate) AS m FROM orders), e AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity = 50), c AS (SELECT l_orderkey, avg(l_discount) AS now, max(l_discount) AS base, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1)
    SELECT o_orderkey, list_filter([CASE WHEN (epoch_us(m) - epoch_us(o_orderdate)) / 864e8 > CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 730 WHEN '3-MEDIUM' THEN 365 WHEN '4-NOT SPECIFIED' THEN 210 WHEN '5-LOW' THEN 30 ELSE 365 END THEN 'age' END, CASE WHEN o_orderstatus <> 'F' THEN 'model' END, CASE WHEN o_custkey % 3 <> 0 THEN 'embedding' END,
      CASE WHEN now < base - 0.04 THEN 'corroboration' END, CASE WHEN e.l_orderkey IS NOT NULL THEN 'errata' END, CASE WHEN bad >= 3 THEN 'negative' END], lambda x: x IS NOT NULL) AS reasons FROM orders LEFT JOIN e ON e.l_orderkey = o_orderkey LEFT JOIN c ON c.l_orderkey = o_orderkey, m""")
def triggers(t: Tables) -> DataFrame:
    """All six reasons to look at a fact again: age by tier, model, embedding, less corroboration, new errata, negative signals.

    A mean that stands at the bound goes to either side by the rounding of its sum, so an order's few lines are added up as the files hold them.
    """
    lines = t.lineitem.select("*", F.when(F.col("l_discount").isNotNull(), F.struct("_metadata.file_path", "_metadata.row_index", "l_discount")).alias("at"))
    total = F.aggregate(F.array_sort(F.collect_list("at")), F.lit(0.0), lambda s, x: s + x["l_discount"])
    per = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.try_divide(total, F.count("l_discount")).alias("now"), F.max("l_discount").alias("base"), F.count_if(F.col("l_returnflag") == "R").alias("bad"), F.max(F.col("l_quantity") == 50).alias("erratum"))
    rows = t.orders.join(per, "o_orderkey", "left").crossJoin(F.broadcast(t.orders.agg(F.max("o_orderdate").alias("m"))))
    most = F.lit(365)
    for tier, days in STALE_DAYS.items():
        most = F.when(F.col("o_orderpriority") == tier, F.lit(days).cast("int")).otherwise(most)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    found = {"age": (micros("m") - micros("o_orderdate")) / 864e8 > most, "model": F.col("o_orderstatus") != "F", "embedding": F.col("o_custkey") % 3 != 0, "corroboration": F.col("now") < F.col("base") - 0.04, "errata": F.col("erratum"), "negative": F.col("bad") >= 3}
    return rows.select("o_orderkey", F.array_compact(F.array(*(F.when(c, n) for n, c in found.items()))).alias("reasons"))
