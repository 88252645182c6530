"""The whole graph from the tables: all kinds of nodes, facet edges, the hierarchy of sections, expansion around anchors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.texts import parent_codes
from ..registry import Tables, query
from .sections import _CHUNKS, coded_chunks

#: Kind, letters of its refs, table, key column, name column. A kind whose key is its name has no row of its own in the tables.
KINDS = [
    ("customer", "c", "customer", "c_custkey", "c_name"), ("supplier", "s", "supplier", "s_suppkey", "s_name"), ("nation", "n", "nation", "n_nationkey", "n_name"), ("region", "r", "region", "r_regionkey", "r_name"),
    ("item", "p", "part", "p_partkey", "p_name"), ("brand", "brand:", "part", "p_brand", "p_brand"), ("type", "type:", "part", "p_type", "p_type"), ("order", "o", "orders", "o_orderkey", "o_orderkey"),
    ("priority", "priority:", "orders", "o_orderpriority", "o_orderpriority"), ("segment", "segment:", "customer", "c_mktsegment", "c_mktsegment"), ("document", "d", "documents", "doc_id", "doc_id"), ("source", "source:", "documents", "source", "source"),
    ("language", "lang:", "documents", "lang", "lang"), ("question", "q", "benchmark", "item_id", "item_id"), ("talk", "t", "conversations", "conv_id", "conv_id"), ("event_kind", "event:", "events", "event_type", "event_type"),
]
#: Type, table, letters and column of the source, letters and column of the target.
FACETS = [
    ("OF_BRAND", "part", "p", "p_partkey", "brand:", "p_brand"), ("OF_TYPE", "part", "p", "p_partkey", "type:", "p_type"), ("IN_SEGMENT", "customer", "c", "c_custkey", "segment:", "c_mktsegment"), ("LIVES_IN", "customer", "c", "c_custkey", "n", "c_nationkey"),
    ("BASED_IN", "supplier", "s", "s_suppkey", "n", "s_nationkey"), ("PART_OF", "nation", "n", "n_nationkey", "r", "n_regionkey"), ("ORDERED_BY", "orders", "o", "o_orderkey", "c", "o_custkey"), ("OF_PRIORITY", "orders", "o", "o_orderkey", "priority:", "o_orderpriority"),
    ("HOLDS", "lineitem", "o", "l_orderkey", "p", "l_partkey"), ("SUPPLIED_BY", "lineitem", "p", "l_partkey", "s", "l_suppkey"), ("FROM_SOURCE", "documents", "d", "doc_id", "source:", "source"), ("IN_LANGUAGE", "documents", "d", "doc_id", "lang:", "lang"), ("DID", "events", "c", "user_id", "event:", "event_type"),
]


def all_nodes(t: Tables) -> DataFrame:
    """(ref, label, name): every kind of node, each once; a row without a key is none."""
    parts = [getattr(t, table).where(f"{key} IS NOT NULL").groupBy(F.concat(F.lit(letters), F.col(key).cast("string")).alias("ref")).agg(F.min(F.col(name).cast("string")).alias("name")).select("ref", F.lit(kind).alias("label"), "name") for kind, letters, table, key, name in KINDS]
    words = t.part.select(F.explode(F.split(F.lower("p_name"), r"\s+")).alias("w")).where("w <> ''").distinct()
    return reduce(DataFrame.unionByName, [*parts, words.select(F.concat(F.lit("word:"), "w").alias("ref"), F.lit("word").alias("label"), F.col("w").alias("name"))])


def facet_edges(t: Tables) -> DataFrame:
    """(src, dst, type): the edges of all facets, each once; an end without a value gives none."""
    ends = lambda letters, column, name: F.concat(F.lit(letters), F.col(column).cast("string")).alias(name)
    parts = [getattr(t, table).select(ends(a, x, "src"), ends(b, y, "dst"), F.lit(kind).alias("type")).where("src IS NOT NULL AND dst IS NOT NULL").distinct() for kind, table, a, x, b, y in FACETS]
    words = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("src"), F.explode(F.array_distinct(F.split(F.lower("p_name"), r"\s+"))).alias("w")).where("w <> ''")
    return reduce(DataFrame.unionByName, [*parts, words.select("src", F.concat(F.lit("word:"), "w").alias("dst"), F.lit("HAS_WORD").alias("type"))])


_ALL_NODES = " UNION ALL ".join(f"SELECT '{letters}' || {key} AS ref, '{kind}' AS label, min(CAST({name} AS VARCHAR)) AS name FROM {table} WHERE {key} IS NOT NULL GROUP BY {key}" for kind, letters, table, key, name in KINDS)
_FACET_EDGES = " UNION ALL ".join(f"SELECT DISTINCT '{a}' || {x} AS src, '{b}' || {y} AS dst, '{kind}' AS type FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for kind, table, a, x, b, y in FACETS)
_WORDS = r"(SELECT p_partkey, unnest(list_distinct(string_split_regex(lower(p_name), '\s+'))) AS w FROM part)"


@query("grf01_all_nodes", f"{_ALL_NODES} UNION ALL SELECT DISTINCT 'word:' || w, 'word', w FROM {_WORDS} WHERE w <> ''")
def projected_nodes(t: Tables) -> DataFrame:
    return all_nodes(t)


@query("grf01_facet_edges", f"{_FACET_EDGES} UNION ALL SELECT 'p' || p_partkey, 'word:' || w, 'HAS_WORD' FROM {_WORDS} WHERE w <> ''")
def projected_edges(t: Tables) -> DataFrame:
    return facet_edges(t)


@query("grf01_dangling", f"SELECT type, count(*) AS n FROM ({_FACET_EDGES}) e WHERE dst NOT IN (SELECT ref FROM ({_ALL_NODES})) OR src NOT IN (SELECT ref FROM ({_ALL_NODES})) GROUP BY type")
def dangling(t: Tables) -> DataFrame:
    """Facet edges to nodes that the tables lack, by type.

    The keys of each end are held against those of its kind of node; only the edges of keys that are missing are brought together. A column
    that makes the nodes itself can't miss any.
    """
    home = {letters: (table, key) for _, letters, table, key, _ in KINDS}

    def missing(table: str, column: str, letters: str) -> DataFrame | None:
        if (table, column) == home[letters]:
            return None
        keys = getattr(t, table).select(F.col(column).alias("_k")).where("_k IS NOT NULL").distinct()
        known = getattr(t, home[letters][0]).select(F.col(home[letters][1]).alias("_k"))
        return scratch.materialize(keys.join(known, "_k", "left_anti"), "missing")

    found = []
    for kind, table, a, x, b, y in FACETS:
        rows = getattr(t, table).select(F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL").withColumns({"_gx": F.lit(None).cast("boolean"), "_gy": F.lit(None).cast("boolean")})
        gone = {end: m for end, m in (("x", missing(table, x, a)), ("y", missing(table, y, b))) if m is not None and not m.isEmpty()}
        for end, m in gone.items():
            rows = rows.drop(f"_g{end}").join(scratch.maybe_broadcast(m.select(F.col("_k").alias(f"_{end}"), F.lit(True).alias(f"_g{end}"))), f"_{end}", "left")
        if gone:
            found.append(rows.where("_gx OR _gy").select("_x", "_y").distinct().agg(F.count("*").alias("n")).select(F.lit(kind).alias("type"), "n").where("n > 0"))
    if not found:
        return t.spark.createDataFrame([], "type string, n long")
    return reduce(DataFrame.unionByName, found)


def part_of(sections: DataFrame) -> DataFrame:
    """(source, code, ancestor): the nearest ancestor of each section (source, code) that its source has; sections without any are left out."""
    known = sections.where("code IS NOT NULL").select("source", "code").distinct()
    ways = known.select("source", "code", F.posexplode(parent_codes(F.col("code"))).alias("depth", "ancestor"))
    return ways.join(known.select("source", F.col("code").alias("ancestor")), ["source", "ancestor"]).groupBy("source", "code").agg(F.max_by("ancestor", "depth").alias("ancestor"))


@query(
    "grf03_part_of",
    f"""WITH {_CHUNKS}, k AS (SELECT DISTINCT source, code FROM chunks WHERE length(text) % 3 > 0), a AS (SELECT source, code, u.n, array_to_string(string_split(code, '.')[1:u.n], '.') AS ancestor FROM k, unnest(range(1, len(string_split(code, '.')))) AS u(n))
    SELECT a.source, a.code, arg_max(ancestor, n) AS ancestor FROM a JOIN k ON k.source = a.source AND k.code = a.ancestor GROUP BY ALL""",
)
def section_tree(t: Tables) -> DataFrame:
    """Numbered lines of documents of which a third is missing: a line hangs below the nearest one that is there."""
    return part_of(coded_chunks(t).where(F.length("text") % 3 > 0))


def expansion(edges: DataFrame, seeds: DataFrame, chunks: DataFrame, most_seeds: int = 4, most_near: int = 12) -> DataFrame:
    """(query_id, element, a, b, type, confidence): the surroundings of the first seeds of each query, every node, edge and chunk once.

    ``edges`` (src, dst, type, confidence), of which a missing confidence counts as 0.7 and others stay within 0 and 1; ``seeds`` (query_id, ref, rank);
    ``chunks`` (ref, chunk). Of a seed's neighbours, either way, the surest come first, then the least ref and type. Tasks keep as many for
    each seed, so a hub is no hot spot.
    """
    first = seeds.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "ref"))).where(F.col("_r") <= most_seeds).select("query_id", "ref")
    sure = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence").cast("double"))), F.lit(0.7))
    ties = edges.select("src", "dst", "type", sure.alias("confidence"))
    both = ties.select(F.col("src").alias("ref"), F.col("dst").alias("other"), "src", "dst", "type", "confidence").unionByName(ties.select(F.col("dst").alias("ref"), F.col("src").alias("other"), "src", "dst", "type", "confidence"))
    near = first.select("ref").distinct().join(both, "ref").withColumn("_n", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("confidence"), "other", "type", "src"))).where(F.col("_n") <= most_near)
    met = first.join(near.drop("_n"), "ref", "left")
    none = F.lit(None)
    nodes = met.select("query_id", F.explode(F.array("ref", "other")).alias("a")).where("a IS NOT NULL").distinct()
    found = nodes.select("query_id", F.lit("node").alias("element"), "a", none.cast("string").alias("b"), none.cast("string").alias("type"), none.cast("double").alias("confidence"))
    kept = met.where("other IS NOT NULL").groupBy("query_id", "src", "dst", "type").agg(F.max("confidence").alias("confidence"))
    found = found.unionByName(kept.select("query_id", F.lit("edge").alias("element"), F.col("src").alias("a"), F.col("dst").alias("b"), "type", "confidence"))
    told = nodes.join(chunks.select(F.col("ref").alias("a"), F.col("chunk").cast("string").alias("b")).distinct(), "a").select("query_id", "b").distinct()
    return found.unionByName(told.select("query_id", F.lit("chunk").alias("element"), F.col("b").alias("a"), none.cast("string").alias("b"), none.cast("string").alias("type"), none.cast("double").alias("confidence")))


@query(
    "grf10_surroundings",
    """WITH e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'LIVES_IN' AS type, c_acctbal / 10000 AS confidence FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'BASED_IN', NULL FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF', 2.0 FROM nation),
    s AS (SELECT n_regionkey AS query_id, 'n' || n_nationkey AS ref FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, 'n' || n_nationkey) <= 4),
    t AS (SELECT src, dst, type, coalesce(least(1, greatest(0, confidence)), 0.7) AS confidence FROM e), b AS (SELECT src AS ref, dst AS other, * FROM t UNION ALL SELECT dst, src, * FROM t),
    m AS (SELECT s.query_id, b.* FROM s JOIN (SELECT * FROM b WHERE ref IN (SELECT ref FROM s) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY confidence DESC, other, type, src) <= 12) b USING (ref)),
    n AS (SELECT query_id, ref AS a FROM s UNION SELECT query_id, other FROM m), k AS (SELECT 'c' || c_custkey AS ref, c_mktsegment AS chunk FROM customer UNION ALL SELECT 'n' || n_nationkey, 'nation text' FROM nation)
    SELECT query_id, 'node' AS element, a, NULL AS b, NULL AS type, NULL AS confidence FROM n UNION ALL SELECT query_id, 'edge', src, dst, type, max(confidence) FROM m GROUP BY query_id, src, dst, type
    UNION ALL SELECT DISTINCT query_id, 'chunk', chunk, NULL, NULL, NULL FROM n JOIN k ON k.ref = n.a""",
)
def surroundings(t: Tables) -> DataFrame:
    """Each region as a question: its first four nations, their surest customers, suppliers without a known confidence, the region itself."""
    ref = lambda letter, c, name: F.concat(F.lit(letter), F.col(c).cast("string")).alias(name)
    edges = t.customer.select(ref("c", "c_custkey", "src"), ref("n", "c_nationkey", "dst"), F.lit("LIVES_IN").alias("type"), (F.col("c_acctbal") / 10000).alias("confidence"))
    edges = edges.unionByName(t.supplier.select(ref("s", "s_suppkey", "src"), ref("n", "s_nationkey", "dst"), F.lit("BASED_IN").alias("type"), F.lit(None).cast("double").alias("confidence")))
    edges = edges.unionByName(t.nation.select(ref("n", "n_nationkey", "src"), ref("r", "n_regionkey", "dst"), F.lit("PART_OF").alias("type"), F.lit(2.0).alias("confidence")))
    seeds = t.nation.select(F.col("n_regionkey").alias("query_id"), ref("n", "n_nationkey", "ref"), F.col("n_name").alias("rank"))
    chunks = t.customer.select(ref("c", "c_custkey", "ref"), F.col("c_mktsegment").alias("chunk")).unionByName(t.nation.select(ref("n", "n_nationkey", "ref"), F.lit("nation text").alias("chunk")))
    return expansion(edges, seeds, chunks)
