"""Projections, filters, sorts, pages and set operations. Every limit has a total order; null places are explicit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..registry import Tables, query
from .pairs import block_pairs
from .ranges import ranked


def tokens(column: str = "p_name") -> Column:
    """The distinct words of a name, sorted."""
    return F.array_sort(F.array_distinct(F.split(F.lower(column), r"\s+")))


def folded(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """``df`` with every condition that is given: optional filters of a listing."""
    return reduce(lambda d, c: d if c is None else d.where(c), conditions, df)


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """One page of ``df`` in a total order; page numbers are clamped to 1 .. 100,000."""
    number = min(max(number, 1), 100_000)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


@query("src02_point_lookup", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 42 LIMIT 1")
def point_lookup(t: Tables) -> DataFrame:
    return t.part.where("p_partkey = 42").select("p_partkey", "p_name", "p_brand").limit(1)


@query("src03_exists", "SELECT EXISTS (SELECT 1 FROM documents WHERE lang = 'fr') AS found")
def exists(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'fr'").limit(1).agg((F.count("*") > 0).alias("found"))


@query("prj01_pruned", "SELECT vec_id, label FROM embeddings")
def pruned(t: Tables) -> DataFrame:
    return t.embeddings.drop("embedding")


@query("prj02_coalesce_chain", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), nullif(o_orderstatus, 'O'), 'none') AS tag, o_totalprice * 0.9 AS net FROM orders")
def coalesce_chain(t: Tables) -> DataFrame:
    tag = F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.nullif("o_orderstatus", F.lit("O")), F.lit("none"))
    return t.orders.select("o_orderkey", tag.alias("tag"), (F.col("o_totalprice") * 0.9).alias("net"))


@query("prj03_preview", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS preview FROM documents")
def preview(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.length("text") > 80, F.concat(F.left("text", F.lit(80)), F.lit("…"))).otherwise(F.col("text")).alias("preview"))


@query("prj04_case_label", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'paid' WHEN value > 50 THEN 'heavy' ELSE 'light' END AS path FROM events")
def case_label(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(F.col("event_type") == "purchase", "paid").when(F.col("value") > 50, "heavy").otherwise("light").alias("path"))


@query("prj05_null_guard", "SELECT vec_id, embedding IS NOT NULL AS has_vector FROM embeddings")
def null_guard(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("embedding").isNotNull().alias("has_vector"))


@query("flt01_optional_predicates", "SELECT p_partkey, p_name, p_size FROM part WHERE p_brand = 'Brand#12' AND p_size <= 30")
def optional_predicates(t: Tables) -> DataFrame:
    brand, kind, most = "Brand#12", "", 30
    return folded(t.part, F.col("p_brand") == brand if brand else None, F.col("p_type") == kind if kind else None, F.col("p_size") <= most if most else None).select("p_partkey", "p_name", "p_size")


@query("flt02_null_safe_range", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL AND c_acctbal BETWEEN 0 AND 2500")
def null_safe_range(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_acctbal").isNotNull() & F.col("c_acctbal").between(0, 2500)).select("c_custkey", "c_acctbal")


@query("flt03_array_contains", "SELECT p_partkey FROM part WHERE list_contains(string_split_regex(lower(p_name), '\\s+'), split_part((SELECT min(lower(p_name)) FROM part), ' ', 1))")
def array_member(t: Tables) -> DataFrame:
    first = t.part.agg(F.split(F.min(F.lower("p_name")), " ")[0].alias("first"))
    return t.part.crossJoin(F.broadcast(first)).where(F.array_contains(tokens(), F.col("first"))).select("p_partkey")


@query("flt04_in_list", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def in_list(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part.where("p_size = 1"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("flt05_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%E%' ESCAPE '\\'")
def case_blind_like(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").ilike("%A%E%")).select("p_partkey", "p_name")


@query("flt07_prefix", "SELECT c_custkey, substr(c_name, 10) AS rest FROM customer WHERE starts_with(c_name, 'Customer#')")
def prefix(t: Tables) -> DataFrame:
    return t.customer.where(F.startswith("c_name", F.lit("Customer#"))).select("c_custkey", F.expr("substring(c_name, 10)").alias("rest"))


@query("flt08_status_switch", "SELECT event_id FROM events WHERE event_type NOT IN ('login')")
def status_switch(t: Tables) -> DataFrame:
    wanted = "default"
    condition = {"default": ~F.col("event_type").isin("login"), "archived": F.col("event_type") == "login", "all": F.lit(True)}.get(wanted, F.col("event_type") == wanted)
    return t.events.where(condition).select("event_id")


_LAST_EVENT = "(SELECT max(ts) FROM events)"


@query("flt09_date_windows", f"SELECT event_id, ts >= date_trunc('day', {_LAST_EVENT}) AS today, ts > {_LAST_EVENT} - INTERVAL 7 DAY AS week FROM events WHERE ts > {_LAST_EVENT} - INTERVAL 30 DAY")
def date_windows(t: Tables) -> DataFrame:
    rows = t.events.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("as_of"))))
    return rows.where("ts > as_of - INTERVAL 30 DAYS").select("event_id", F.expr("ts >= date_trunc('day', as_of)").alias("today"), F.expr("ts > as_of - INTERVAL 7 DAYS").alias("week"))


@query("flt10_calendar", "SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN 'announced' WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 'upcoming' ELSE 'legal' END AS state FROM orders")
def calendar(t: Tables) -> DataFrame:
    date = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.when(date.isNull(), "announced").when(date > F.lit("1997-01-01").cast("timestamp_ntz"), "upcoming").otherwise("legal").alias("state"))


@query("flt11_due_check", f"SELECT user_id, max(ts) IS NULL OR epoch({_LAST_EVENT}) - epoch(max(ts)) >= 86400 - 1800 AS due FROM events GROUP BY user_id")
def due_check(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("now"))))
    return last.select("user_id", F.expr("last IS NULL OR now - last >= INTERVAL 84600 SECONDS").alias("due"))


@query("flt12_sample_unprocessed", "SELECT o_orderkey FROM orders o WHERE o_orderkey % 4 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_orderkey LIMIT 51")
def sample_unprocessed(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.where("o_orderkey % 4 = 0").select("o_orderkey").join(done, "o_orderkey", "left_anti").orderBy("o_orderkey").limit(51)


@query("flt13_effective_in_time", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus <> 'X' AND l_shipdate <= TIMESTAMP '1997-06-01' AND l_shipdate + INTERVAL 90 DAY >= TIMESTAMP '1997-06-01'")
def effective_in_time(t: Tables) -> DataFrame:
    return t.lineitem.where("l_linestatus <> 'X' AND l_shipdate <= TIMESTAMP_NTZ '1997-06-01' AND l_shipdate + INTERVAL 90 DAYS >= TIMESTAMP_NTZ '1997-06-01'").select("l_orderkey", "l_linenumber")


@query("flt14_stale_model", "SELECT vec_id FROM embeddings WHERE embedding IS NULL OR label IS NULL OR label <> 3")
def stale_model(t: Tables) -> DataFrame:
    return t.embeddings.where(F.col("embedding").isNull() | ~F.col("label").eqNullSafe(3)).select("vec_id")


@query("flt15_url_guard", r"""SELECT page_id, regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '^https?://(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|\[)') AS allowed FROM pages""")
def url_guard(t: Tables) -> DataFrame:
    private = r"^https?://(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|\[)"
    return t.pages.select("page_id", (F.col("url").rlike("^https?://") & ~F.col("url").rlike(private)).alias("allowed"))


@query("flt16_nothing", "SELECT event_id FROM events WHERE 1 = 0")
def nothing(t: Tables) -> DataFrame:
    return t.events.where(F.lit(False)).select("event_id")


@query("sort01_mixed", "SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC NULLS LAST, s_suppkey) AS place FROM supplier")
def mixed_sort(t: Tables) -> DataFrame:
    # The order itself is the result; places are given by a sort over partitions, so that no task holds all rows.
    return ranked(t.supplier, "place", F.col("s_nationkey").asc_nulls_last(), F.col("s_acctbal").desc_nulls_last(), F.col("s_suppkey").asc()).select("s_suppkey", "place")


@query("sort02_case_rank", "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS place FROM orders")
def case_rank(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return ranked(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "place", rank.asc(), F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "o_orderstatus", "place")


@query("sort03_custom_sequence", "SELECT event_id, event_type, row_number() OVER (ORDER BY coalesce(list_position(['purchase', 'view', 'click'], event_type), 99), event_id) AS place FROM events")
def custom_sequence(t: Tables) -> DataFrame:
    at = F.array_position(F.array(*map(F.lit, ("purchase", "view", "click"))), F.col("event_type"))
    return ranked(t.events.select("event_id", "event_type"), "place", F.when(at > 0, at).otherwise(99).asc(), F.asc("event_id"))


@query("sort04_inside_array", "SELECT l_orderkey, list_sort(list(l_partkey)) AS parts FROM lineitem GROUP BY l_orderkey")
def inside_array(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))


@query("topk01_latest", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20")
def latest(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("topk04_grouped_counts", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 15")
def grouped_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(15)


@query("page01_offset", "SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_name, p_partkey LIMIT 60 OFFSET 60")
def offset_page(t: Tables) -> DataFrame:
    return page(t.part, 2, 60, "p_name", "p_partkey").select("p_partkey", "p_name").crossJoin(F.broadcast(t.part.agg(F.count("*").alias("total"))))


@query(
    "page02_merged",
    """WITH a AS (SELECT o_orderdate AS moment, 'order' AS kind, o_orderkey AS id FROM orders ORDER BY moment DESC, id LIMIT 40), b AS (SELECT ts AS moment, 'event' AS kind, event_id AS id FROM events ORDER BY moment DESC, id LIMIT 40)
    SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY moment DESC, kind, id LIMIT 20 OFFSET 20""",
)
def merged_page(t: Tables) -> DataFrame:
    number, size = 2, 20
    a = t.orders.select(F.col("o_orderdate").alias("moment"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    b = t.events.select(F.col("ts").alias("moment"), F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    newest = [x.orderBy(F.desc("moment"), "id").limit(number * size) for x in (a, b)]
    return page(newest[0].unionByName(newest[1]), number, size, F.desc("moment"), "kind", "id")


@query("page03_one_more", "SELECT o_orderkey, count(*) OVER () > 25 AS more FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 26) ORDER BY o_orderkey LIMIT 25")
def one_more(t: Tables) -> DataFrame:
    fetched = t.orders.where("o_totalprice > 100000").select("o_orderkey").orderBy("o_orderkey").limit(26)
    return fetched.orderBy("o_orderkey").limit(25).crossJoin(F.broadcast(fetched.agg((F.count("*") > 25).alias("more"))))


@query("set01_union_all", "SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS weight FROM orders UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer")
def union_all(t: Tables) -> DataFrame:
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("weight"))
    return a.unionByName(t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("weight")))


@query(
    "set02_priority_union",
    """WITH c AS (SELECT 1 AS channel, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos, doc_id FROM documents QUALIFY pos <= 30 UNION ALL SELECT 2, row_number() OVER (ORDER BY doc_id), doc_id FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= 30),
    f AS (SELECT doc_id, min(channel * 1000 + pos) AS place FROM c GROUP BY doc_id) SELECT doc_id, place FROM f ORDER BY place LIMIT 40""",
)
def priority_union(t: Tables) -> DataFrame:
    def channel(number: int, *order) -> DataFrame:
        best = t.documents.select("doc_id", "n_chars").orderBy(*order).limit(30)
        return ranked(best, "pos", *order).select("doc_id", (F.lit(number * 1000) + F.col("pos")).alias("place"))

    both = channel(1, F.desc("n_chars"), F.asc("doc_id")).unionByName(channel(2, F.asc("doc_id")))
    return both.groupBy("doc_id").agg(F.min("place").alias("place")).orderBy("place").limit(40)


@query("set03_sentence_difference", r"""WITH s AS (SELECT doc_id, list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines FROM documents),
    d AS (SELECT a.doc_id, list_filter(b.lines, lambda x: NOT list_contains(a.lines, x)) AS i, list_filter(a.lines, lambda x: NOT list_contains(b.lines, x)) AS d FROM s a JOIN s b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, len(i) AS inserted, len(d) AS deleted, sha256(array_to_string(list_sort(i)[1:40], chr(10))) AS inserted_sha, sha256(array_to_string(list_sort(d)[1:40], chr(10))) AS deleted_sha FROM d""")
def sentence_difference(t: Tables) -> DataFrame:
    """What one version has and the other has not, both ways: all are counted, forty of each are shown."""
    lines = t.documents.select("doc_id", F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("lines"))
    after = lines.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lines").alias("new"))
    both = lines.join(after, "doc_id").select("doc_id", F.array_except("new", "lines").alias("i"), F.array_except("lines", "new").alias("d"))
    shown = lambda c: F.sha2(F.array_join(F.slice(F.array_sort(c), 1, 40), "\n"), 256)
    return both.select("doc_id", F.size("i").cast("long").alias("inserted"), F.size("d").cast("long").alias("deleted"), shown("i").alias("inserted_sha"), shown("d").alias("deleted_sha"))


@query("set04_shared_tokens", r"""WITH p AS (SELECT p_partkey, p_brand, p_size, list_distinct(string_split_regex(lower(p_name), '\s+')) AS w FROM part)
    SELECT a.p_partkey AS a, b.p_partkey AS b, list_sort(list_intersect(a.w, b.w)) AS shared FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def shared_tokens(t: Tables) -> DataFrame:
    """The words that every two items of a brand and size share: none if the second has no name, null if the first has none."""
    p = t.part.select("p_partkey", "p_brand", "p_size", tokens().alias("w"))
    shared = lambda x, y: F.when(x["w"].isNotNull(), F.coalesce(F.array_sort(F.array_intersect(x["w"], y["w"])), F.array().cast("array<string>")))
    return block_pairs(p, "p_partkey", ["p_brand", "p_size"], ["w"], {"shared": shared})


@query("set04_class_tokens", r"""WITH p AS (SELECT p_partkey, p_brand, p_size, list_sort(list_distinct(string_split_regex(lower(p_name), '\s+'))) AS w FROM part),
    c AS (SELECT p_brand, p_size, w, coalesce('w' || array_to_string(w, ' '), '') AS told, min(p_partkey) AS class FROM p WHERE p_partkey IS NOT NULL AND p_brand IS NOT NULL AND p_size IS NOT NULL GROUP BY p_brand, p_size, w)
    SELECT 'pair' AS kind, a.class AS a, b.class AS b, CASE WHEN a.w IS NOT NULL AND b.w IS NOT NULL THEN list_sort(list_intersect(a.w, b.w)) END AS shared FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND (a.class < b.class OR a.class = b.class AND a.told < b.told)
    UNION ALL SELECT 'member', CASE WHEN p_partkey IS NOT NULL THEN coalesce(c.class, p_partkey) END, p_partkey, p.w FROM p LEFT JOIN c ON p.p_brand = c.p_brand AND p.p_size = c.p_size AND p.w IS NOT DISTINCT FROM c.w""")
def class_tokens(t: Tables) -> DataFrame:
    """What every two items of a brand and size share, by classes of items of the same brand, size and words, named by their least key.

    A row ``pair`` has two classes and the words that each item of the one shares with each item of the other; a row ``member`` an item (b),
    its class (a) and its words, which are what it shares with the other items of its class. Items without a key, brand or size share nothing.
    """
    p = t.part.select("p_partkey", "p_brand", "p_size", tokens().alias("w"))
    c = p.where("p_partkey IS NOT NULL AND p_brand IS NOT NULL AND p_size IS NOT NULL").groupBy("p_brand", "p_size", "w").agg(F.min("p_partkey").alias("class"))
    c = scratch.materialize(c.withColumn("told", F.coalesce(F.concat(F.lit("w"), F.array_join("w", " ")), F.lit(""))), "classes")
    a, b = c.select("p_brand", "p_size", F.col("class").alias("a"), F.col("w").alias("v"), "told"), c.select("p_brand", "p_size", F.col("class").alias("b"), F.col("w").alias("u"), F.col("told").alias("told_b"))
    pairs = a.join(b, ["p_brand", "p_size"]).where("a < b OR a = b AND told < told_b").select(F.lit("pair").alias("kind"), "a", "b", F.array_sort(F.array_intersect("v", "u")).alias("shared"))
    same = (p["p_brand"] == c["p_brand"]) & (p["p_size"] == c["p_size"]) & p["w"].eqNullSafe(c["w"])
    own = F.when(F.col("p_partkey").isNotNull(), F.coalesce("class", "p_partkey"))
    return pairs.unionByName(p.join(c, same, "left").select(F.lit("member").alias("kind"), own.alias("a"), F.col("p_partkey").alias("b"), p["w"].alias("shared")))


@query("set05_unknown_keys", "SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def unknown_keys(t: Tables) -> DataFrame:
    known = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_custkey").distinct().join(known, "o_custkey", "left_anti")


@query("set06_distinct_by_key", "SELECT ref, min(label) AS label FROM (SELECT 'n' || n_regionkey AS ref, 'nation' AS label FROM nation UNION ALL SELECT 'n' || r_regionkey, 'region' FROM region) GROUP BY ref")
def distinct_by_key(t: Tables) -> DataFrame:
    a = t.nation.select(F.concat(F.lit("n"), "n_regionkey").alias("ref"), F.lit("nation").alias("label"))
    return a.unionByName(t.region.select(F.concat(F.lit("n"), "r_regionkey").alias("ref"), F.lit("region").alias("label"))).groupBy("ref").agg(F.min("label").alias("label"))


@query("set07_covered_by", "SELECT o_orderkey AS id, 'primary' AS origin FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT l_orderkey, 'legacy' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey = l_orderkey)")
def covered_by(t: Tables) -> DataFrame:
    primary = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    legacy = t.lineitem.select(F.col("l_orderkey").alias("id")).distinct().join(primary, "id", "left_anti")
    return primary.withColumn("origin", F.lit("primary")).unionByName(legacy.withColumn("origin", F.lit("legacy")))


@query("set08_overlaps", r"SELECT p_partkey FROM part WHERE list_has_any(string_split(lower(p_type), ' '), ['brass', 'steel', 'large', 'small'])")
def overlaps(t: Tables) -> DataFrame:
    wanted = F.array(*map(F.lit, ("brass", "steel", "large", "small")))
    return t.part.where(F.arrays_overlap(F.split(F.lower("p_type"), " "), wanted)).select("p_partkey")


@query("flt06_reversed_containment", "SELECT doc_id, count(*) AS n FROM documents, (SELECT DISTINCT lower(r_name) AS name FROM region UNION SELECT DISTINCT lower(n_name) FROM nation) WHERE length(name) >= 4 AND contains(lower(text), name) GROUP BY doc_id")
def reversed_containment(t: Tables) -> DataFrame:
    """Texts that contain names of a small fixed list: the list is broadcast, each text is read once."""
    names = t.region.select(F.lower("r_name").alias("name")).unionByName(t.nation.select(F.lower("n_name").alias("name"))).distinct().where(F.length("name") >= 4)
    return t.documents.select("doc_id", F.lower("text").alias("low")).join(scratch.maybe_broadcast(names), F.contains("low", "name")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("topk02_recent_window", "SELECT o_orderkey FROM orders ORDER BY coalesce(o_orderdate, TIMESTAMP '1990-01-01') DESC, o_orderkey LIMIT 500")
def recent_window(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc(F.coalesce("o_orderdate", F.lit("1990-01-01").cast("timestamp_ntz"))), "o_orderkey").limit(500).select("o_orderkey")
