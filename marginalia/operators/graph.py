"""Graph operators over ``nodes`` (ref, label, name) and ``edges`` (src, dst, type) that are projected from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..registry import Tables, query
from .filters import tokens

_NODES = "nodes AS (SELECT 'c' || c_custkey AS ref, 'customer' AS label, c_name AS name FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region', r_name FROM region)"
_EDGES = "edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'LIVES_IN' AS type FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'BASED_IN' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF' FROM nation)"


def _ref(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def nodes(t: Tables) -> DataFrame:
    kinds = [(t.customer, "c", "c_custkey", "customer", "c_name"), (t.supplier, "s", "s_suppkey", "supplier", "s_name"), (t.nation, "n", "n_nationkey", "nation", "n_name"), (t.region, "r", "r_regionkey", "region", "r_name")]
    parts = [df.select(_ref(letter, key).alias("ref"), F.lit(label).alias("label"), F.col(name).alias("name")) for df, letter, key, label, name in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def edges(t: Tables) -> DataFrame:
    kinds = [(t.customer, "c", "c_custkey", "n", "c_nationkey", "LIVES_IN"), (t.supplier, "s", "s_suppkey", "n", "s_nationkey", "BASED_IN"), (t.nation, "n", "n_nationkey", "r", "n_regionkey", "PART_OF")]
    parts = [df.select(_ref(a, x).alias("src"), _ref(b, y).alias("dst"), F.lit(kind).alias("type")) for df, a, x, b, y, kind in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("grf01_nodes", f"WITH {_NODES} SELECT * FROM nodes")
def project_nodes(t: Tables) -> DataFrame:
    return nodes(t)


@query("agg29_label_counts", f"WITH {_NODES} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def label_counts(t: Tables) -> DataFrame:
    return nodes(t).groupBy("label").agg(F.count("*").alias("n"))


@query("grf02_facet_edges", r"SELECT 'p' || p_partkey AS src, 'w:' || unnest(list_distinct(string_split_regex(lower(p_name), '\s+'))) AS dst FROM part")
def facet_edges(t: Tables) -> DataFrame:
    return t.part.select(_ref("p", "p_partkey").alias("src"), F.explode(tokens()).alias("w")).select("src", F.concat(F.lit("w:"), "w").alias("dst"))


@query("grf03_hierarchy", "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation JOIN region ON n_regionkey = r_regionkey")
def hierarchy(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(_ref("n", "n_nationkey").alias("src"), _ref("r", "n_regionkey").alias("dst"))


@query("grf04_about_edges", "SELECT DISTINCT 'd' || doc_id AS src, 'b' || item_id AS dst FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))) AS w FROM documents) JOIN (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))) AS w FROM benchmark) USING (w)")
def about_edges(t: Tables) -> DataFrame:
    long_words = lambda df, key: df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})")))).alias("w"))
    met = long_words(t.documents, "doc_id").join(long_words(t.benchmark, "item_id"), "w")
    return met.select(_ref("d", "doc_id").alias("src"), _ref("b", "item_id").alias("dst")).distinct()


@query("grf06_orphans", f"WITH {_NODES}, {_EDGES} SELECT ref FROM nodes WHERE ref NOT IN (SELECT src FROM edges) AND ref NOT IN (SELECT dst FROM edges)")
def orphans(t: Tables) -> DataFrame:
    ends = edges(t).select(F.col("src").alias("ref")).unionByName(edges(t).select(F.col("dst").alias("ref"))).distinct()
    return nodes(t).join(ends, "ref", "left_anti").select("ref")


@query("grf07_whitelist_merge", f"WITH {_NODES}, {_EDGES} SELECT type, count(*) AS n, count(*) FILTER (a.ref IS NOT NULL AND b.ref IS NOT NULL) AS written FROM (SELECT DISTINCT * FROM edges) e LEFT JOIN nodes a ON a.ref = src AND a.label <> 'region' LEFT JOIN nodes b ON b.ref = dst AND b.label IN ('nation', 'region') GROUP BY type")
def whitelist_merge(t: Tables) -> DataFrame:
    known = nodes(t)
    a = known.where("label <> 'region'").select(F.col("ref").alias("src"), F.lit(True).alias("a"))
    b = known.where("label IN ('nation', 'region')").select(F.col("ref").alias("dst"), F.lit(True).alias("b"))
    return edges(t).distinct().join(a, "src", "left").join(b, "dst", "left").groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("a") & F.col("b")).alias("written"))


def neighbours(e: DataFrame, refs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(ref, other, type, way): the edges at each of ``refs``, out and in; other is null for a node without any."""
    both = e.select(F.col("src").alias("ref"), F.col("dst").alias("other"), "type", F.lit("out").alias("way")).unionByName(e.select(F.col("dst").alias("ref"), F.col("src").alias("other"), "type", F.lit("in").alias("way")))
    return refs.join(both.where(F.col("type").isin(types)) if types else both, "ref", "left")


@query("grf08_neighbours", f"WITH {_EDGES} SELECT 'n1' AS ref, dst AS other, type, 'out' AS way FROM edges WHERE src = 'n1' UNION ALL SELECT 'n1', src, type, 'in' FROM edges WHERE dst = 'n1'")
def node_neighbours(t: Tables) -> DataFrame:
    return neighbours(edges(t), nodes(t).where("ref = 'n1'").select("ref"))


def shortest_paths(e: DataFrame, start: str, most: int) -> DataFrame:
    """(ref, hops, path): breadth first from ``start`` over undirected edges, at most ``most`` hops, the least path where several are as short."""
    # The edges are written once, and so is every hop: no hop works out those before it again.
    both = scratch.materialize(e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    seen = e.sparkSession.createDataFrame([(start, 0, start)], "ref string, hops int, path string")
    frontier = seen
    for hop in range(1, most + 1):
        step = frontier.join(both, F.col("ref") == F.col("src")).groupBy(F.col("dst").alias("ref")).agg(F.min(F.concat_ws(">", "path", "dst")).alias("path"))
        frontier = scratch.materialize(step.join(seen.select("ref"), "ref", "left_anti").select("ref", F.lit(hop).alias("hops"), "path"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


@query("grf09_shortest_path", f"""WITH RECURSIVE {_EDGES}, b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)),
    p AS (SELECT 's1' AS ref, 0 AS hops, 's1' AS path UNION SELECT dst, hops + 1, path || '>' || dst FROM p JOIN b ON ref = src WHERE hops < 3 AND NOT contains('>' || path || '>', '>' || dst || '>')) SELECT ref, hops, min(path) AS path FROM p WHERE (ref, hops) IN (SELECT ref, min(hops) FROM p GROUP BY ref) GROUP BY ref, hops""")
def shortest_path(t: Tables) -> DataFrame:
    return shortest_paths(edges(t), "s1", 3)


@query("grf10_expansion", f"WITH {_EDGES} SELECT ref, other FROM (SELECT src AS ref, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges) WHERE ref IN ('n1', 'n2', 'n3', 'n4') QUALIFY row_number() OVER (PARTITION BY ref ORDER BY other) <= 12")
def expansion(t: Tables) -> DataFrame:
    seeds = nodes(t).where(F.col("ref").isin("n1", "n2", "n3", "n4")).select("ref")
    near = neighbours(edges(t), seeds).where("other IS NOT NULL")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("ref").orderBy("other"))).where("r <= 12").select("ref", "other")


@query("grf11_adjacency", "SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS a, greatest(a.l_partkey, b.l_partkey) AS b FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey")
def adjacency(t: Tables) -> DataFrame:
    """Every two items that an order ties, once each."""
    n = t.lineitem.count()
    rows = scratch.spread(t.lineitem.select("l_orderkey", "l_partkey"), n, "l_orderkey").distinct()
    pairs = rows.withColumnRenamed("l_partkey", "a").join(rows.withColumnRenamed("l_partkey", "b"), "l_orderkey").where("a < b").select("a", "b")
    return scratch.spread(pairs, 3 * n, "a", "b").distinct()


@query("grf12_path_cost", f"WITH {_NODES}, {_EDGES} SELECT a.src AS start, b.dst AS stop, round(1 / 0.7 + 1 / 0.9, 6) AS cost FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'BASED_IN' ORDER BY cost, start, stop LIMIT 10")
def path_cost(t: Tables) -> DataFrame:
    weighted = edges(t).withColumn("confidence", F.when(F.col("type") == "PART_OF", 0.9).otherwise(0.7))
    a = weighted.where("type = 'BASED_IN'").select(F.col("src").alias("start"), F.col("dst").alias("mid"), F.col("confidence").alias("c1"))
    b = weighted.select(F.col("src").alias("mid"), F.col("dst").alias("stop"), F.col("confidence").alias("c2"))
    cost = F.aggregate(F.array("c1", "c2"), F.lit(0.0), lambda s, c: s + 1 / F.greatest(F.lit(1e-6), c))
    return a.join(b, "mid").select("start", "stop", F.round(cost, 6).alias("cost")).orderBy("cost", "start", "stop").limit(10)


@query("grf14_reified", "SELECT o_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) END AS flag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN max(l_linestatus) END AS status, count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1 AS reified_only FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def reified(t: Tables) -> DataFrame:
    single = lambda c: F.when(F.min(c) == F.max(c), F.max(c))
    several = (F.min("l_returnflag") != F.max("l_returnflag")) | (F.min("l_linestatus") != F.max("l_linestatus"))
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(single("l_returnflag").alias("flag"), single("l_linestatus").alias("status"), several.alias("reified_only"))


@query("grf15_versions", "SELECT event_id, lead(event_id) OVER w AS next_id, lead(event_id) OVER w IS NULL AS current FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY CAST(json_extract_string(props, '$.k') AS INTEGER), ts, event_id)")
def versions(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy(F.get_json_object("props", "$.k").cast("int"), "ts", "event_id")
    return t.events.select("event_id", F.lead("event_id").over(w).alias("next_id")).withColumn("current", F.col("next_id").isNull())


@query("rsn01_chain", f"WITH {_EDGES} SELECT DISTINCT a.src, b.dst, a.type || '/' || b.type AS chain FROM edges a JOIN edges b ON a.dst = b.src")
def chain(t: Tables) -> DataFrame:
    e = edges(t)
    b = e.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("type").alias("last"))
    return e.join(b, "dst").select("src", F.col("end").alias("dst"), F.concat_ws("/", "type", "last").alias("chain")).distinct()


@query("rsn02_symmetric", f"WITH {_EDGES} SELECT dst AS src, src AS dst FROM edges EXCEPT SELECT src, dst FROM edges")
def symmetric(t: Tables) -> DataFrame:
    e = edges(t).select("src", "dst")
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().join(e, ["src", "dst"], "left_anti")


@query("rsn03_collapse", f"WITH {_EDGES} SELECT DISTINCT src, dst, CASE WHEN type IN ('LIVES_IN', 'BASED_IN') THEN 'LOCATED_IN' ELSE type END AS type FROM edges")
def collapse(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([("LIVES_IN", "LOCATED_IN"), ("BASED_IN", "LOCATED_IN")], "type string, above string")
    return edges(t).join(F.broadcast(kinds), "type", "left").select("src", "dst", F.coalesce("above", "type").alias("type")).distinct()


@query("rsn04_contradictions", "SELECT a.l_orderkey, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber AND a.l_returnflag <> b.l_returnflag ORDER BY 1, 2, 3 LIMIT 500")
def contradictions(t: Tables) -> DataFrame:
    a = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("x"), F.col("l_returnflag").alias("fx"))
    b = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("y"), F.col("l_returnflag").alias("fy"))
    return a.join(b, ["l_orderkey", "l_suppkey"]).where("x < y AND fx <> fy").select("l_orderkey", "x", "y").orderBy("l_orderkey", "x", "y").limit(500)


@query("ont02_validation", f"WITH {_NODES}, {_EDGES}, shapes(type, a, b) AS (VALUES ('LIVES_IN', 'customer', 'nation'), ('BASED_IN', 'supplier', 'nation'), ('PART_OF', 'nation', 'region')) SELECT e.type, CASE WHEN x.ref IS NULL THEN 'domain' WHEN y.ref IS NULL THEN 'range' ELSE 'ok' END AS reason, count(*) AS n FROM edges e JOIN shapes s USING (type) LEFT JOIN nodes x ON x.ref = src AND x.label = s.a LEFT JOIN nodes y ON y.ref = dst AND y.label = s.b GROUP BY 1, 2")
def validation(t: Tables) -> DataFrame:
    shapes = t.spark.createDataFrame([("LIVES_IN", "customer", "nation"), ("BASED_IN", "supplier", "nation"), ("PART_OF", "nation", "region")], "type string, a string, b string")
    known = nodes(t)
    x = known.select(F.col("ref").alias("src"), F.col("label").alias("a"), F.lit(True).alias("x"))
    y = known.select(F.col("ref").alias("dst"), F.col("label").alias("b"), F.lit(True).alias("y"))
    checked = edges(t).join(F.broadcast(shapes), "type").join(x, ["src", "a"], "left").join(y, ["dst", "b"], "left")
    return checked.groupBy("type", F.when(F.col("x").isNull(), "domain").when(F.col("y").isNull(), "range").otherwise("ok").alias("reason")).agg(F.count("*").alias("n"))


@query("ont04_fingerprint", "SELECT p_brand, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT DISTINCT p_brand, p_type || ':' || p_size AS line FROM part) GROUP BY 1")
def fingerprint(t: Tables) -> DataFrame:
    lines = t.part.select("p_brand", F.concat_ws(":", "p_type", "p_size").alias("line"))
    return lines.groupBy("p_brand").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("line")), "\n"), 256).alias("fingerprint"))


@query("grf13_citations", f"WITH {_EDGES} SELECT start, ref, row_number() OVER (PARTITION BY start ORDER BY place, ref) AS number FROM (SELECT start, ref, min(place) AS place FROM (SELECT a.src AS start, unnest([a.src, a.dst, b.dst]) AS ref, unnest([1, 2, 3]) AS place FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'BASED_IN') GROUP BY 1, 2)")
def citations(t: Tables) -> DataFrame:
    """The nodes along the paths from each start, numbered at their first place."""
    e = edges(t)
    b = e.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
    hops = e.where("type = 'BASED_IN'").join(b, "dst").select(F.col("src").alias("start"), F.posexplode(F.array("src", "dst", "end")).alias("place", "ref"))
    first = hops.groupBy("start", "ref").agg(F.min("place").alias("place"))
    return first.select("start", "ref", F.row_number().over(Window.partitionBy("start").orderBy("place", "ref")).alias("number"))


@query("rsn05_recompute", f"WITH {_EDGES}, d AS (SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src) SELECT src, dst, EXISTS (SELECT 1 FROM customer WHERE 'c' || c_custkey = src AND c_acctbal < 0) AS known FROM d")
def recompute(t: Tables) -> DataFrame:
    """Derived edges anew, with what was known of them before."""
    e = edges(t)
    derived = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst")).distinct()
    old = t.customer.where("c_acctbal < 0").select(_ref("c", "c_custkey").alias("src"), F.lit(True).alias("k")).distinct()
    return derived.join(old, "src", "left").select("src", "dst", F.coalesce("k", F.lit(False)).alias("known"))


def filtered_neighbours(e: DataFrame, n: DataFrame, refs: DataFrame, way: str = "both", types: list[str] | None = None, kinds: list[str] | None = None, take: int = 12) -> DataFrame:
    """(ref, found, other, type, way): at most ``take`` neighbours of each of ``refs``, by direction, type of edge and label of the
    neighbour. ``found`` tells a ref that is no node (false, one row) from a node without neighbours (true, other null)."""
    known = refs.join(n.select("ref", F.lit(True).alias("found")), "ref", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    near = neighbours(e, refs, types).where("other IS NOT NULL")
    if way != "both":
        near = near.where(F.col("way") == way)
    if kinds:
        near = near.join(n.where(F.col("label").isin(kinds)).select(F.col("ref").alias("other")), "other", "left_semi").select("ref", "other", "type", "way")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("ref").orderBy("other", "type", "way"))).where(F.col("r") <= take).drop("r")
    return known.join(near, "ref", "left")


@query("grf08_filtered", f"WITH {_NODES}, {_EDGES}, a(ref) AS (VALUES ('n1'), ('n2'), ('r3'), ('nowhere')), m AS (SELECT a.ref, src AS other, type, 'in' AS way FROM a JOIN edges ON dst = a.ref JOIN nodes x ON x.ref = src AND label IN ('customer', 'nation') WHERE type IN ('LIVES_IN', 'PART_OF') QUALIFY row_number() OVER (PARTITION BY a.ref ORDER BY src, type) <= 5) SELECT a.ref, n.ref IS NOT NULL AS found, other, type, way FROM a LEFT JOIN nodes n ON n.ref = a.ref LEFT JOIN m ON m.ref = a.ref")
def filtered(t: Tables) -> DataFrame:
    refs = t.spark.createDataFrame([("n1",), ("n2",), ("r3",), ("nowhere",)], "ref string")
    return filtered_neighbours(edges(t), nodes(t), refs, "in", ["LIVES_IN", "PART_OF"], ["customer", "nation"], 5)


def path_outcome(e: DataFrame, n: DataFrame, start: str, stop: str, most: int, types: list[str] | None = None) -> DataFrame:
    """(outcome, hops, path): the shortest path between two nodes over edges of some types, or why there is none."""
    ends = n.where(F.col("ref").isin(start, stop)).agg(F.countDistinct("ref").alias("known"))
    used = e.where(F.col("type").isin(types)) if types else e
    way = shortest_paths(used, start, most).where(F.col("ref") == stop).agg(F.min("hops").alias("hops"), F.min("path").alias("path"))
    missing = F.col("known") < (1 if start == stop else 2)
    outcome = F.when(missing, "endpoint missing").when(F.col("hops").isNull(), "none").otherwise("found")
    return ends.crossJoin(way).select(outcome.alias("outcome"), F.when(~missing, F.col("hops")).alias("hops"), F.when(~missing, F.col("path")).alias("path"))


@query("grf09_outcomes", f"""WITH RECURSIVE {_EDGES}, b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges WHERE type <> 'LIVES_IN' UNION ALL SELECT dst, src FROM edges WHERE type <> 'LIVES_IN')),
    p AS (SELECT 's1' AS ref, 0 AS hops, 's1' AS path UNION SELECT dst, hops + 1, path || '>' || dst FROM p JOIN b ON ref = src WHERE hops < 4 AND NOT contains('>' || path || '>', '>' || dst || '>')), f AS (SELECT ref, min(hops) AS hops FROM p GROUP BY ref), w AS (SELECT p.ref, p.hops, min(path) AS path FROM p JOIN f USING (ref, hops) GROUP BY 1, 2)
    SELECT 's2' AS stop, CASE WHEN (SELECT count(*) FROM w WHERE ref = 's2') > 0 THEN 'found' ELSE 'none' END AS outcome, (SELECT hops FROM w WHERE ref = 's2') AS hops, (SELECT path FROM w WHERE ref = 's2') AS path UNION ALL SELECT 'c1', 'none', NULL, NULL UNION ALL SELECT 'nowhere', 'endpoint missing', NULL, NULL""")
def outcomes(t: Tables) -> DataFrame:
    """From one supplier to another over what they are based in, to a customer (whose edges are left out), and to no node at all."""
    parts = [path_outcome(edges(t), nodes(t), "s1", stop, 4, ["BASED_IN", "PART_OF"]).withColumn("stop", F.lit(stop)) for stop in ("s2", "c1", "nowhere")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("stop", "outcome", "hops", "path")


def chains(e: DataFrame, last: str, most: int) -> DataFrame:
    """(src, dst, chain, hops): what chains of up to ``most`` edges imply whose last edge is of type ``last``; each step is a join."""
    tail = e.where(F.col("type") == last).select("src", "dst", F.col("type").alias("chain"), F.lit(1).alias("hops"))
    found = tail
    for hop in range(2, most + 1):
        tail = e.select("src", F.col("dst").alias("mid"), "type").join(tail.withColumnRenamed("src", "mid"), "mid").select("src", "dst", F.concat_ws("/", "type", "chain").alias("chain"), F.lit(hop).alias("hops")).distinct()
        found = found.unionByName(tail)
    return found.where("hops > 1")


@query("rsn01_deep_chains", f"WITH RECURSIVE {_EDGES}, m AS (SELECT * FROM edges UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'MADE_BY' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)), c AS (SELECT src, dst, type AS chain, 1 AS hops FROM m WHERE type = 'PART_OF' UNION SELECT m.src, c.dst, m.type || '/' || chain, hops + 1 FROM c JOIN m ON m.dst = c.src WHERE hops < 4) SELECT src, dst, chain, hops FROM c WHERE hops > 1")
def deep_chains(t: Tables) -> DataFrame:
    """Parts, suppliers, customers and nations tied to regions by chains of up to four edges."""
    made = t.lineitem.select(_ref("p", "l_partkey").alias("src"), _ref("s", "l_suppkey").alias("dst"), F.lit("MADE_BY").alias("type")).distinct()
    return chains(edges(t).unionByName(made), "PART_OF", 4)


@query("rsn04_patterns", """WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A'), d AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'N') > 0 AND max(l_tax) < 0.08)
    SELECT 'claim against official' AS pattern, CAST(l_orderkey AS VARCHAR) AS subject, CAST(l_partkey AS VARCHAR) AS counter FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = a.l_orderkey)
    UNION ALL SELECT 'ruling collision', CAST(x.l_linenumber AS VARCHAR) || '@' || x.l_orderkey, CAST(y.l_linenumber AS VARCHAR) || '@' || y.l_orderkey FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey = y.l_suppkey AND x.l_linenumber < y.l_linenumber AND x.l_returnflag <> y.l_returnflag
    UNION ALL SELECT 'disjoint labels', CAST(l_partkey AS VARCHAR), NULL FROM d""")
def patterns(t: Tables) -> DataFrame:
    """Three kinds of contradictions: claims without official support, rulings on one target that differ, subjects with two labels that exclude each other."""
    text = lambda c: F.col(c).cast("string")
    supported = t.lineitem.where("l_linestatus = 'F' AND l_returnflag = 'A'").select("l_orderkey")
    claims = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct().join(supported, "l_orderkey", "left_anti")
    claims = claims.select(F.lit("claim against official").alias("pattern"), text("l_orderkey").alias("subject"), text("l_partkey").alias("counter"))
    x = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("x"), F.col("l_returnflag").alias("fx"))
    y = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("y"), F.col("l_returnflag").alias("fy"))
    at = lambda c: F.concat_ws("@", text(c), text("l_orderkey"))
    rulings = x.join(y, ["l_orderkey", "l_suppkey"]).where("x < y AND fx <> fy").select(F.lit("ruling collision").alias("pattern"), at("x").alias("subject"), at("y").alias("counter"))
    both = t.lineitem.groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("n"), F.max("l_tax").alias("tax")).where("a > 0 AND n > 0 AND tax < 0.08")
    return claims.unionByName(rulings).unionByName(both.select(F.lit("disjoint labels").alias("pattern"), text("l_partkey").alias("subject"), F.lit(None).cast("string").alias("counter")))


@query("rsn05_new_conflicts", f"WITH {_EDGES}, d AS (SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src), old AS (SELECT 'c' || c_custkey || '|' || 'r' || (c_custkey % 5) AS key FROM customer) SELECT src || '|' || dst AS key FROM d WHERE src || '|' || dst NOT IN (SELECT key FROM old)")
def new_conflicts(t: Tables) -> DataFrame:
    """Derived edges are made anew each time; what they tell is kept only where its key is not known yet."""
    e = edges(t)
    derived = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select(F.concat_ws("|", "src", "end").alias("key")).distinct()
    old = t.customer.select(F.concat(_ref("c", "c_custkey"), F.lit("|r"), (F.col("c_custkey") % 5).cast("string")).alias("key"))
    return derived.join(old, "key", "left_anti")
