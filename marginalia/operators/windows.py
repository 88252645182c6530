"""Latest rows, precedence, islands, neighbours, budgets and state by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import Tables, query
from .ranges import previous, running


def first_by(df: DataFrame, keys: list[str], *order, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


@query("win01_latest_row", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_row(t: Tables) -> DataFrame:
    return first_by(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("win02_precedence", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END, l_shipdate DESC NULLS LAST, l_quantity DESC, l_linenumber DESC) = 1")
def precedence(t: Tables) -> DataFrame:
    tier = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3)
    return first_by(t.lineitem, ["l_orderkey"], tier, F.desc_nulls_last("l_shipdate"), F.desc("l_quantity"), F.desc("l_linenumber")).select("l_orderkey", "l_linenumber")


@query("agg20_superseded_by", "SELECT l_orderkey, first_value(l_linenumber) OVER w AS winner, l_linenumber FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_returnflag, l_shipdate DESC NULLS LAST, l_linenumber DESC) QUALIFY row_number() OVER w > 1 AND (min(l_suppkey) OVER (PARTITION BY l_orderkey)) <> (max(l_suppkey) OVER (PARTITION BY l_orderkey))")
def superseded_by(t: Tables) -> DataFrame:
    whole = Window.partitionBy("l_orderkey")
    order = whole.orderBy("l_returnflag", F.desc_nulls_last("l_shipdate"), F.desc("l_linenumber"))
    rows = t.lineitem.withColumn("winner", F.first("l_linenumber").over(order)).withColumn("r", F.row_number().over(order))
    several = F.min("l_suppkey").over(whole) != F.max("l_suppkey").over(whole)
    return rows.withColumn("s", several).where("s AND r > 1").select("l_orderkey", "winner", "l_linenumber")


@query("win03_islands", "WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM a) SELECT event_id, CAST(island AS BIGINT) AS island, row_number() OVER (PARTITION BY user_id, island ORDER BY ts DESC, event_id DESC) AS place FROM b")
def islands(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumn("c", F.when(F.lag("event_type").over(w) == F.col("event_type"), 0).otherwise(1)).withColumn("island", F.sum("c").over(w))
    return rows.select("event_id", "island", F.row_number().over(Window.partitionBy("user_id", "island").orderBy(F.desc("ts"), F.desc("event_id"))).alias("place"))


_CODES = "WITH c AS (SELECT doc_id, pos, m AS code FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS m, unnest(range(1, len(regexp_extract_all(text, '[A-Z][a-z]{5,}')) + 1)) AS pos FROM documents)), f AS (SELECT doc_id, code, min(pos) AS pos FROM c GROUP BY 1, 2)"


def codes(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"))).alias("pos", "code"))
    return found.groupBy("doc_id", "code").agg((F.min("pos") + 1).alias("pos"))


@query("win05_neighbours", _CODES + " SELECT doc_id, code, lag(code) OVER w AS before, lead(code) OVER w AS after FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def neighbours(t: Tables) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    return codes(t).select("doc_id", "code", F.lag("code").over(w).alias("before"), F.lead("code").over(w).alias("after"))


@query("win06_first_chunk", "SELECT source, lang, min(doc_id) AS first_id, left(arg_min(text, doc_id), 40) AS preview FROM documents GROUP BY 1, 2")
def first_chunk(t: Tables) -> DataFrame:
    # Only ids are grouped; the chosen texts are joined afterwards, so that no text is carried through the shuffle.
    first = t.documents.groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
    return t.documents.select("doc_id", F.left("text", F.lit(40)).alias("preview")).join(first, "doc_id").select("source", "lang", F.col("doc_id").alias("first_id"), "preview")


@query("win07_dedupe_capped", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1 ORDER BY n_chars DESC, doc_id LIMIT 25")
def dedupe_capped(t: Tables) -> DataFrame:
    return first_by(t.documents.select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], F.desc("n_chars"), "doc_id").orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "source")


@query("win08_token_budget", "WITH d AS (SELECT doc_id, source, (length(text) + 3) // 4 AS cost, row_number() OVER w AS pos, sum((length(text) + 3) // 4) OVER w AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) SELECT doc_id, CAST(used AS BIGINT) AS used FROM d WHERE used <= 3000 OR pos = 1")
def token_budget(t: Tables) -> DataFrame:
    costs = t.documents.select("doc_id", "source", F.expr("(length(text) + 3) div 4").alias("cost"))
    # The first row of a source is the one whose running sum is its own cost; costs may be 0, so the least id decides.
    first = costs.groupBy("source").agg(F.min("doc_id").alias("first"))
    used = running(costs, ["source"], ["doc_id"], "used", F.col("cost"))
    return used.join(first.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("used <= 3000 OR doc_id = first").select("doc_id", "used")


@query("win10_budgeted_pick", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_size = 1) DESC, p_type, p_retailprice DESC, p_partkey) <= 4")
def budgeted_pick(t: Tables) -> DataFrame:
    return first_by(t.part, ["p_brand"], F.desc(F.col("p_size") == 1), "p_type", F.desc("p_retailprice"), "p_partkey", n=4).select("p_brand", "p_partkey")


@query("win11_state", "SELECT user_id, event_id FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def state(t: Tables) -> DataFrame:
    return first_by(t.events.where("event_type <> 'error'"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("win12_seen_before", "SELECT doc_id, lag(doc_id) OVER w AS previous, count(*) OVER (PARTITION BY source, md5(text) ORDER BY doc_id) > 1 AS seen FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def seen_before(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", "source", F.md5("text").alias("h"))
    first = hashed.groupBy("source", "h").agg(F.min("doc_id").alias("first")).toDF("s", "g", "first")
    rows = previous(hashed, ["source"], ["doc_id"], "previous", F.col("doc_id"))
    return rows.join(first, F.col("source").eqNullSafe(F.col("s")) & F.col("h").eqNullSafe(F.col("g"))).select("doc_id", "previous", (F.col("first") < F.col("doc_id")).alias("seen"))


@query("topk05_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def per_group(t: Tables) -> DataFrame:
    return first_by(t.orders, ["o_custkey"], F.desc("o_totalprice"), "o_orderkey", n=3).select("o_custkey", "o_orderkey")


@query("win04_rank_in_list", "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents")
def rank_in_list(t: Tables) -> DataFrame:
    placed = running(t.documents.select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], "place")
    return placed.select("lang", "doc_id", (F.col("place") - 1).alias("pos"))


@query("win09_nearest_ancestor", "WITH c AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || '.' || (p_partkey % 4) || '.' || (p_partkey % 3) AS code FROM part), s AS (SELECT DISTINCT code FROM c WHERE p_partkey % 2 = 0), a AS (SELECT p_partkey, c.code, unnest([split_part(c.code, '.', 1) || '.' || split_part(c.code, '.', 2) || '.0', split_part(c.code, '.', 1) || '.0.0']) AS up, unnest([2, 1]) AS depth FROM c) SELECT p_partkey, arg_max(up, depth) AS ancestor FROM a WHERE up <> code AND up IN (SELECT code FROM s) GROUP BY p_partkey")
def nearest_ancestor(t: Tables) -> DataFrame:
    """The deepest ancestor of a dotted code that is itself present."""
    code = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 4).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    c = t.part.select("p_partkey", code.alias("code"))
    part = lambda k: F.split_part("code", F.lit("."), F.lit(k))
    ups = F.array(F.struct(F.concat(part(1), F.lit("."), part(2), F.lit(".0")).alias("up"), F.lit(2).alias("depth")), F.struct(F.concat(part(1), F.lit(".0.0")).alias("up"), F.lit(1).alias("depth")))
    present = c.where("p_partkey % 2 = 0").select(F.col("code").alias("up")).distinct()
    rows = c.select("p_partkey", "code", F.inline(ups)).where("up <> code").join(present, "up", "left_semi")
    return rows.groupBy("p_partkey").agg(F.max_by("up", "depth").alias("ancestor"))
