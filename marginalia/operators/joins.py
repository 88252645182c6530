"""Joins: equi, semi and anti joins, as-of, containment, banded and rule-driven joins. Theta joins get an equi key first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from ..functions.texts import contains_word
from ..registry import Tables, query
from .filters import tokens
from .pairs import block_pairs
from .ranges import previous


def latest_before(events: DataFrame, prices: DataFrame, by: str, at: str, since: str, tie: str, values: list[str]) -> DataFrame:
    """As-of join: each event with ``values`` of the latest price of its ``by`` that began at or before it (then the highest ``tie``).

    A price list that fits a broadcast meets the events where they are (``_by_cells``). For a longer one, both sides are put in one ordered
    stream for each key and the last price is carried forward, over ranges of time, so a key with a third of all events spreads
    over many tasks.
    """
    prices = scratch.materialize(prices.select(by, since, F.col(tie).cast("long").alias(tie), *(v for v in values if v not in (by, since, tie))), "prices")
    if scratch.within(prices, scratch.BROADCAST_BYTES // 3):  # the cells hold a price three times at most, on average
        return _by_cells(events, prices, by, at, since, tie, values)
    held = F.struct(*values)
    kept = [c for c in events.columns if c != by]
    left = events.select(by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.struct(*kept).alias("_event"), F.lit(None).cast(prices.select(held.alias("h")).schema["h"].dataType).alias("_price"))
    right = prices.select(by, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), F.lit(None).cast(left.schema["_event"].dataType).alias("_event"), held.alias("_price"))
    carried = previous(left.unionByName(right), [by], ["_at", "_side", "_tie"], "_last", F.col("_price"), F.col("_side") == 0).where("_side = 1")
    return carried.select(by, *(F.col(f"_event.{c}").alias(c) for c in kept), *(F.col(f"_last.{v}").alias(v) for v in values))


def _seconds(at: Column, kind: T.DataType) -> Column:
    """Whole seconds of a moment, in the order of moments; other numbers stand for themselves."""
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_date(F.to_date(at)).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60 + F.second(at)
    return F.unix_seconds(at) if isinstance(kind, T.TimestampType) else F.floor(at)


def _by_cells(events: DataFrame, prices: DataFrame, by: str, at: str, since: str, tie: str, values: list[str]) -> DataFrame:
    """The as-of join by a broadcast: each price holds until the next one of its key, and stands in every cell of time that it touches; an event
    meets the prices of its key and cell. There are as many cells as a key has prices on average, so the cells hold three rows a price at most."""
    kept = [c for c in events.columns if c != by]
    second = _seconds(F.col(since), prices.schema[since].dataType)
    low, high, n, keys = prices.agg(F.min(second), F.max(second), F.count("*"), F.count_distinct(by)).first()
    cells = max(1, (n or 0) // max(1, keys or 0))
    width = max(1, ((high or 0) - (low or 0)) // cells + 1)
    cell = lambda x: F.greatest(F.lit(0), F.least(F.lit(cells), F.floor((x - F.lit(low or 0)) / width)))
    until = F.lead(since).over(Window.partitionBy(by).orderBy(since, tie))
    ends = prices.where(F.col(since).isNotNull()).select(F.col(by).alias("_by"), F.col(since).alias("_since"), until.alias("_until"), F.struct(*values).alias("_price"), second.alias("_s"))
    last = F.when(F.col("_until").isNull(), F.lit(cells)).otherwise(cell(_seconds(F.col("_until"), prices.schema[since].dataType)))
    ends = ends.where("_until IS NULL OR _since < _until").withColumn("_cell", F.explode(F.sequence(cell(F.col("_s")), last)))
    rows = events.withColumn("_event_cell", cell(_seconds(F.col(at), events.schema[at].dataType)))
    held = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_event_cell") == F.col("_cell")) & (F.col("_since") <= F.col(at)) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    return rows.join(F.broadcast(ends), held, "left").select(by, *kept, *(F.col(f"_price.{v}").alias(v) for v in values))


@query("join01_inner", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45")
def inner(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 45").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand")


@query("join02_topk_then_join", "SELECT o_orderkey, o_totalprice, c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25) JOIN customer ON o_custkey = c_custkey")
def topk_then_join(t: Tables) -> DataFrame:
    best = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    return F.broadcast(best).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_name")


@query("join03_two_outer", "SELECT l_orderkey, l_linenumber, sn.n_name AS supplier_nation, cn.n_name AS customer_nation FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey")
def two_outer(t: Tables) -> DataFrame:
    sn, cn = (t.nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(n)) for k, n in (("s_nationkey", "supplier_nation"), ("c_nationkey", "customer_nation")))
    sides = t.supplier.join(sn, "s_nationkey", "left").select(F.col("s_suppkey").alias("l_suppkey"), "supplier_nation")
    owners = t.orders.join(t.customer.join(cn, "c_nationkey", "left"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("l_orderkey"), "customer_nation")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(sides, "l_suppkey", "left").join(owners, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "supplier_nation", "customer_nation")


@query("join04_lookup_default", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def lookup_default(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("join05_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)")
def semi(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_discount > 0.09"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("join06_nested_exists", "SELECT o_orderkey FROM orders o WHERE o_orderpriority = '1-URGENT' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size = 1))")
def nested_exists(t: Tables) -> DataFrame:
    small = t.lineitem.join(t.part.where("p_size = 1"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    flagged = t.orders.join(small.withColumn("hit", F.lit(True)), "o_orderkey", "left")
    return flagged.where("hit OR o_orderpriority = '1-URGENT'").select("o_orderkey")


@query("join07_anti_computed_key", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE 'customer:' || o_custkey = 'customer:' || c_custkey)")
def anti_computed_key(t: Tables) -> DataFrame:
    seen = t.orders.select(F.concat(F.lit("customer:"), "o_custkey").alias("ref"))
    return t.customer.withColumn("ref", F.concat(F.lit("customer:"), "c_custkey")).join(seen, "ref", "left_anti").select("c_custkey")


_NAMED = r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), v AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS word FROM benchmark)"""


@query("join08_containment", _NAMED + " SELECT doc_id, count(DISTINCT v.word) AS n_names, CASE WHEN count(DISTINCT item_id) = 1 THEN min(item_id) END AS item_id FROM w JOIN v USING (word) GROUP BY doc_id")
def containment(t: Tables) -> DataFrame:
    """Texts that contain a name at word boundaries: an inverted index makes the containment an equi join; several owners give null."""
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")))).alias("word"))
    names = t.benchmark.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{7,})")))).alias("word"))
    met = words.join(names, "word").groupBy("doc_id").agg(F.countDistinct("word").alias("n_names"), F.min("item_id").alias("least"), F.max("item_id").alias("most"))
    return met.select("doc_id", "n_names", F.when(F.col("least") == F.col("most"), F.col("least")).alias("item_id"))


@query("join09_legality", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'illegal' WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') THEN 'incomplete' ELSE 'legal' END AS legality FROM orders")
def legality(t: Tables) -> DataFrame:
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_returnflag") == "R").alias("banned"), F.max(F.col("l_linestatus") == "F").alias("filled"))
    state = F.when(F.col("banned"), "illegal").when(~F.coalesce("filled", F.lit(False)), "incomplete").otherwise("legal")
    return t.orders.select("o_orderkey").join(flags, "o_orderkey", "left").select("o_orderkey", state.alias("legality"))


_TARIFF = """tariff AS (SELECT event_type, ts AS effective_from, CAST(round(value, 2) AS DECIMAL(18,6)) AS price, event_id AS id FROM events WHERE event_id % 97 = 0)"""


def tariff(t: Tables) -> DataFrame:
    """A price list that the events themselves give: now and then an event sets the price of its type."""
    return t.events.where("event_id % 97 = 0").select("event_type", F.col("ts").alias("effective_from"), F.round("value", 2).cast("decimal(18,6)").alias("price"), F.col("event_id").alias("id"))


@query("join10_as_of", f"WITH {_TARIFF} SELECT event_id, (SELECT price FROM tariff p WHERE p.event_type = e.event_type AND effective_from <= e.ts ORDER BY effective_from DESC, id DESC LIMIT 1) AS price FROM events e")
def as_of(t: Tables) -> DataFrame:
    return latest_before(t.events.select("event_type", "event_id", "ts"), tariff(t), "event_type", "ts", "effective_from", "id", ["price"]).select("event_id", "price")


@query("join11_bridge", "SELECT s_suppkey, list_sort(list(DISTINCT l_partkey)) AS parts FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def bridge(t: Tables) -> DataFrame:
    return t.supplier.join(t.lineitem, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))


@query("join12_self_children", "WITH e AS (SELECT event_id, min(event_id) OVER (PARTITION BY user_id) AS head FROM events) SELECT head AS event_id, list_sort(list(event_id)) AS followers FROM e WHERE event_id <> head GROUP BY head")
def self_children(t: Tables) -> DataFrame:
    heads = t.events.groupBy("user_id").agg(F.min("event_id").alias("head"))
    return t.events.select("event_id", "user_id").join(heads, "user_id").where("event_id <> head").groupBy(F.col("head").alias("event_id")).agg(F.array_sort(F.collect_list("event_id")).alias("followers"))


@query("join13_canonical", "SELECT p_partkey, coalesce(c.canonical, p_partkey) AS canonical FROM part p LEFT JOIN (SELECT p_name, min(p_partkey) AS canonical FROM part GROUP BY p_name HAVING count(*) > 1) c USING (p_name)")
def canonical(t: Tables) -> DataFrame:
    heads = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("canonical"), F.count("*").alias("n")).where("n > 1")
    return t.part.join(heads, "p_name", "left").select("p_partkey", F.coalesce("canonical", "p_partkey").alias("canonical"))


@query("join14_fallback_chain", "SELECT p.p_partkey, coalesce(a.vec_id, b.vec_id, c.vec_id) AS vec_id FROM part p LEFT JOIN (SELECT vec_id FROM embeddings WHERE label < 3) a ON a.vec_id = p.p_partkey LEFT JOIN embeddings b ON b.vec_id = p.p_partkey + 1 LEFT JOIN (SELECT p_name, min(p_partkey) AS vec_id FROM part GROUP BY 1) c ON c.p_name = p.p_name")
def fallback_chain(t: Tables) -> DataFrame:
    own = t.embeddings.where("label < 3").select(F.col("vec_id").alias("a"))
    near = t.embeddings.select(F.col("vec_id").alias("b"))
    named = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("c"))
    found = t.part.join(own, F.col("p_partkey") == F.col("a"), "left").join(near, F.col("b") == F.col("p_partkey") + 1, "left").join(named, "p_name", "left")
    return found.select("p_partkey", F.coalesce("a", "b", "c").alias("vec_id"))


@query("join15_blocked_pairs", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON left(a.p_name, 4) = left(b.p_name, 4) AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def blocked_pairs(t: Tables) -> DataFrame:
    return block_pairs(t.part.select("p_partkey", F.left("p_name", F.lit(4)).alias("block"), "p_size"), "p_partkey", ["block", "p_size"], [], {})


@query("join15_block_classes", """WITH p AS (SELECT p_partkey, left(p_name, 4) AS block, p_size FROM part), o AS (SELECT p_partkey, block, p_size, count(*) AS own FROM p WHERE p_partkey IS NOT NULL GROUP BY ALL), g AS (SELECT block, p_size, min(p_partkey) AS class, sum(own) AS n FROM o GROUP BY ALL)
    SELECT p_partkey, coalesce(class, p_partkey) AS class, CAST(coalesce(n - own, 0) AS BIGINT) AS links FROM p LEFT JOIN o USING (p_partkey, block, p_size) LEFT JOIN g ON o.block = g.block AND o.p_size = g.p_size""")
def block_classes(t: Tables) -> DataFrame:
    """(p_partkey, class, links): every two rows of a block and size are a pair, so the block's least key and how many rows a row is paired with say all.

    A row is linked with those of its class that have another key. Rows without a key, name or size are linked with nothing.
    """
    rows = t.part.groupBy("p_partkey", F.left("p_name", F.lit(4)).alias("block"), "p_size").agg(F.count("*").alias("own"))
    groups = rows.where("p_partkey IS NOT NULL").groupBy("block", "p_size").agg(F.min("p_partkey").alias("class"), F.sum("own").alias("n"))
    told = rows.join(groups, ["block", "p_size"], "left").select("p_partkey", F.when(F.col("p_partkey").isNotNull(), F.coalesce("class", "p_partkey")).alias("class"), F.when(F.col("p_partkey").isNotNull(), F.col("n") - F.col("own")).alias("links"), F.explode(F.sequence(F.lit(1).cast("long"), "own")))
    return told.select("p_partkey", "class", F.coalesce("links", F.lit(0)).alias("links"))


@query("join16_banded", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.event_type = b.event_type AND a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 259200000000")
def banded(t: Tables) -> DataFrame:
    """Pairs at most 72 hours apart: each event goes to its 72-hour cell, its partners to that cell and both next to it."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t.events.select("event_id", "event_type", "user_id", micros.alias("at")).withColumn("cell", F.floor(F.col("at") / 259_200_000_000))
    near = e.select(F.col("event_id").alias("b"), "event_type", "user_id", F.col("at").alias("bt"), F.explode(F.array(*(F.col("cell") + d for d in (-1, 0, 1)))).alias("cell"))
    return e.join(near, ["event_type", "user_id", "cell"]).where("event_id < b AND abs(at - bt) <= 259200000000").select(F.col("event_id").alias("a"), "b")


@query("join17_inverted_index", r"""WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split_regex(lower(p_name), '\s+'))) AS word FROM part), g AS (SELECT word FROM w GROUP BY word HAVING count(*) BETWEEN 2 AND 12)
    SELECT a.p_partkey AS a, b.p_partkey AS b, count(*) AS shared FROM w a JOIN w b USING (word) JOIN g USING (word) WHERE a.p_partkey < b.p_partkey GROUP BY 1, 2""")
def inverted_index(t: Tables) -> DataFrame:
    """Pairs that share a word that 2 to 12 rows have: small groups by definition of the operator."""
    words = t.part.select("p_partkey", F.explode(tokens()).alias("word"))
    groups = words.groupBy("word").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 12").select("word")
    kept = words.join(groups, "word")
    return kept.withColumnRenamed("p_partkey", "a").join(kept.withColumnRenamed("p_partkey", "b"), "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


_RULES = "rules(agent, patient, kind) AS (VALUES ('R', 'A', 'offsets'), ('N', 'R', 'meets'), ('A', 'N', 'feeds'))"


@query("join18_rules", f"WITH {_RULES} SELECT DISTINCT a.l_orderkey, a.l_linenumber AS x, b.l_linenumber AS y, kind FROM lineitem a JOIN rules ON a.l_returnflag = agent JOIN lineitem b ON b.l_returnflag = patient AND a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber")
def rules(t: Tables) -> DataFrame:
    listed = t.spark.createDataFrame([("R", "A", "offsets"), ("N", "R", "meets"), ("A", "N", "feeds")], "agent string, patient string, kind string")
    line, n = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), t.lineitem.count()
    agents = line.join(F.broadcast(listed), F.col("l_returnflag") == F.col("agent")).select("l_orderkey", F.col("l_linenumber").alias("x"), "patient", "kind")
    patients = line.select("l_orderkey", F.col("l_linenumber").alias("y"), F.col("l_returnflag").alias("patient"))
    met = scratch.spread(agents, n, "l_orderkey", "patient").join(scratch.spread(patients, n, "l_orderkey", "patient"), ["l_orderkey", "patient"]).where("x <> y")
    # A kind has one patient, so equal rows are where they met.
    return met.select("l_orderkey", "patient", "x", "y", "kind").distinct().drop("patient")


@query("join21_lateral_top1", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_order FROM customer")
def lateral_top1(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.col("m.o_orderkey").alias("last_order"))


@query("join22_children", "SELECT o_orderkey, list(l_linenumber ORDER BY l_linenumber) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def children(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))


@query("join23_url_variants", "SELECT a.page_id, b.page_id AS other FROM pages a JOIN pages b ON rtrim(regexp_replace(a.url, '^https?://(www\\.)?', ''), '/') = rtrim(regexp_replace(b.url, '^https?://(www\\.)?', ''), '/') AND a.page_id < b.page_id")
def url_variants(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", F.rtrim(F.regexp_replace("url", r"^https?://(www\.)?", ""), F.lit("/")).alias("key"))
    return p.join(p.select(F.col("page_id").alias("other"), "key"), "key").where("page_id < other").select("page_id", "other")


@query("join24_work_queue", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50) ORDER BY p_partkey LIMIT 101")
def work_queue(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(done, "p_partkey", "left_anti").orderBy("p_partkey").limit(101)


def first_told(words: DataFrame, n: int) -> DataFrame:
    """(a, b, kind 1): the first ``n`` pairs a < b of ids in ``words`` (p_partkey, word) with two words in common, one of an even id, the other's divisible by three.

    Pairs come by their smaller id, so smaller ids meet all larger ones in blocks, each four times the one before, until the
    blocks have given ``n`` pairs: what comes after can't be among the first. Without that many pairs every id has its turn.
    """
    words = scratch.materialize(words.where("p_partkey IS NOT NULL AND (p_partkey % 2 = 0 OR p_partkey % 3 = 0)"), "words")
    given, size, least = None, 16, None
    while True:
        rest = words if least is None else words.where(F.col("p_partkey") > least)
        block = scratch.materialize(rest.select("p_partkey").distinct().orderBy("p_partkey").limit(size), "block")
        least = block.agg(F.max("p_partkey")).first()[0]
        if least is None:
            return given if given is not None else words.select(F.col("p_partkey").alias("a"), F.col("p_partkey").alias("b"), F.lit(1).alias("kind")).limit(0)
        mine = rest.join(scratch.maybe_broadcast(block), "p_partkey", "left_semi").withColumnRenamed("p_partkey", "a")
        met = scratch.maybe_broadcast(scratch.materialize(mine, "mine")).join(rest.withColumnRenamed("p_partkey", "b"), "word").where("a < b AND (a % 2 = 0 AND b % 3 = 0 OR a % 3 = 0 AND b % 2 = 0)")
        told = met.groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2").select("a", "b", F.lit(1).alias("kind"))
        told = scratch.materialize((told if given is None else given.unionByName(told)).orderBy("a", "b").limit(n), "told")
        given, size = told, size * 4
        if given.count() >= n:
            return given


@query("join17_effects", r"""WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS word FROM part), x AS (SELECT p_partkey AS a, word FROM w WHERE p_partkey % 2 = 0), y AS (SELECT p_partkey AS b, word FROM w WHERE p_partkey % 3 = 0), m AS (SELECT p_type || p_brand || p_size AS m, p_partkey FROM part), g AS (SELECT m FROM m GROUP BY m HAVING count(*) BETWEEN 2 AND 12),
    c AS (SELECT least(a, b) AS a, greatest(a, b) AS b, 1 AS kind FROM (SELECT a, b, count(*) AS n FROM x JOIN y USING (word) WHERE a <> b GROUP BY 1, 2 HAVING count(*) >= 2) UNION ALL SELECT p.p_partkey, q.p_partkey, 2 FROM m p JOIN m q USING (m) JOIN g USING (m) WHERE p.p_partkey < q.p_partkey)
    SELECT a, b, min(kind) AS kind FROM c GROUP BY 1, 2 ORDER BY kind, a, b LIMIT 200""")
def effects(t: Tables) -> DataFrame:
    """Pairs where the effect of one names the trigger of the other (two words in common), then pairs of small groups with one mechanic; each pair once, the first 200."""
    w = t.part.select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("word"))
    told = first_told(w, 200)
    m = t.part.select(F.concat("p_type", "p_brand", F.col("p_size").cast("string")).alias("m"), "p_partkey")
    groups = m.groupBy("m").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 12").select("m")
    kept = m.join(groups, "m")
    alike = kept.withColumnRenamed("p_partkey", "a").join(kept.withColumnRenamed("p_partkey", "b"), "m").where("a < b").select("a", "b", F.lit(2).alias("kind"))
    return told.unionByName(alike).groupBy("a", "b").agg(F.min("kind").alias("kind")).orderBy("kind", "a", "b").limit(200)


@query("join18_hypotheses", """WITH rules(agent, patient, kind, same, domains) AS (VALUES ('R', 'A', 'offsets', false, true), ('N', 'R', 'meets', true, false), ('A', 'N', 'feeds', false, false)), f AS (SELECT l_orderkey AS o, l_linenumber AS ref, l_returnflag AS pred, l_linestatus AS token, [l_suppkey % 3, l_partkey % 3] AS domains FROM lineitem)
    SELECT a.o, a.ref AS x, b.ref AS y, list_sort(list(DISTINCT kind)) AS kinds FROM f a JOIN rules r ON a.pred = agent JOIN f b ON b.o = a.o AND b.pred = patient AND b.ref <> a.ref WHERE (NOT same OR a.token = b.token) AND (NOT r.domains OR list_has_any(a.domains, b.domains)) GROUP BY 1, 2, 3""")
def hypotheses(t: Tables) -> DataFrame:
    """Pairs that rules predict from what both hold; a rule may ask for equal tokens and for a domain in common. What led to a pair is gathered."""
    listed = t.spark.createDataFrame([("R", "A", "offsets", False, True), ("N", "R", "meets", True, False), ("A", "N", "feeds", False, False)], "pred string, patient string, kind string, same boolean, domains boolean")
    facts = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ref"), F.col("l_returnflag").alias("pred"), F.col("l_linestatus").alias("token"), F.array((F.col("l_suppkey") % 3).alias("d"), F.col("l_partkey") % 3).alias("d"))
    agents = facts.join(F.broadcast(listed), "pred").select("o", F.col("ref").alias("x"), "patient", "kind", "same", "domains", F.col("token").alias("tx"), F.col("d").alias("dx"))
    both = agents.join(facts.select("o", F.col("ref").alias("y"), F.col("pred").alias("patient"), "token", "d"), ["o", "patient"]).where("x <> y AND (NOT same OR tx = token) AND (NOT domains OR arrays_overlap(dx, d))")
    return both.groupBy("o", "x", "y").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


@query("join08_longest_name", r"WITH n AS (SELECT DISTINCT item_id, trim(lower(regexp_extract(text, '^([A-Za-z]+(?: [A-Za-z]+){0,2})', 1))) AS name FROM benchmark UNION SELECT DISTINCT item_id, trim(lower(regexp_extract(text, '^([A-Za-z]+)', 1))) FROM benchmark), o AS (SELECT name, CASE WHEN count(DISTINCT item_id) = 1 THEN min(item_id) END AS item_id FROM n WHERE length(name) >= 4 GROUP BY name), m AS (SELECT doc_id, o.name, item_id FROM documents JOIN o ON contains(lower(text), o.name) AND regexp_matches(lower(text), '(^|[^\pL\p{Nd}])' || o.name || '($|[^\pL\p{Nd}])')) SELECT doc_id, name, item_id FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) = 1")
def longest_name(t: Tables) -> DataFrame:
    """The longest of the names that stand in each text at word boundaries; a name of several owners gives null.

    A name's first word is the key that texts are joined by; only then is the whole name looked for.
    """
    whole, first = (F.trim(F.lower(F.regexp_extract("text", p, 1))) for p in ("^([A-Za-z]+(?: [A-Za-z]+){0,2})", "^([A-Za-z]+)"))
    named = t.benchmark.select("item_id", F.explode(F.array_distinct(F.array(whole, first))).alias("name")).where(F.length("name") >= 4)
    owners = named.groupBy("name").agg(F.min("item_id").alias("least"), F.max("item_id").alias("most")).select("name", F.when(F.col("least") == F.col("most"), F.col("least")).alias("item_id"), F.split_part("name", F.lit(" "), F.lit(1)).alias("word"))
    low = t.documents.select("doc_id", F.lower("text").alias("low"))
    keyed = low.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(r"([\p{L}\p{Nd}]+)")))).alias("word")).join(owners, "word")
    met = keyed.join(low, "doc_id").where(F.contains("low", "name")).where(contains_word(F.col("low"), F.col("name")))
    best = met.groupBy("doc_id").agg(F.min(F.struct((-F.length("name")).alias("n"), "name", "item_id")).alias("b"))
    return best.select("doc_id", "b.name", "b.item_id")
