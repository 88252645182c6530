"""Entity linking and resolution: gazetteers, blocking, trigrams, variants and consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..components import connected_components
from ..registry import Tables, query
from .windows import first_by


def trigrams(name: Column) -> Column:
    """The distinct trigrams of a padded lower-case name."""
    padded = F.concat(F.lit("  "), F.lower(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


_TRI = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || lower({0}) || ' ', i, 3)))"


@query("ent01_gazetteer", r"""WITH w AS (SELECT conv_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS surface FROM conversations), g AS (SELECT DISTINCT lower(left(word, 1)) || substr(lower(word), 2) AS surface, item_id FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS word FROM benchmark))
    SELECT conv_id, count(DISTINCT surface) AS surfaces, count(DISTINCT item_id) AS entries FROM w JOIN g USING (surface) GROUP BY conv_id""")
def gazetteer(t: Tables) -> DataFrame:
    listed = t.benchmark.select("item_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"))).alias("w")).select("item_id", F.lower("w").alias("surface")).distinct()
    said = t.conversations.select("conv_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})")))).alias("surface"))
    return said.join(listed, "surface").groupBy("conv_id").agg(F.countDistinct("surface").alias("surfaces"), F.countDistinct("item_id").alias("entries"))


@query("ent02_linking", "SELECT vec_id, label, round(0.30 * (label % 4) / 3 + 0.25 * (vec_id % 7) / 6 + 0.35 * (vec_id % 3) / 2 + 0.10, 6) AS score FROM embeddings WHERE round(0.30 * (label % 4) / 3 + 0.25 * (vec_id % 7) / 6 + 0.35 * (vec_id % 3) / 2 + 0.10, 6) >= 0.2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1")
def linking(t: Tables) -> DataFrame:
    score = F.round(0.30 * (F.col("label") % 4) / 3 + 0.25 * (F.col("vec_id") % 7) / 6 + 0.35 * (F.col("vec_id") % 3) / 2 + 0.10, 6)
    return first_by(t.embeddings.select("vec_id", "label", score.alias("score")).where("score >= 0.2"), ["label"], F.desc("score"), "vec_id")


@query("ent03_resolution", f"WITH p AS (SELECT p_partkey, left(lower(p_name), 4) AS block, p_brand, {_TRI.format('p_name')} AS g FROM part), j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS s FROM p a JOIN p b ON a.block = b.block AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey) SELECT a, b, s, CASE WHEN s >= 0.85 THEN 'auto' ELSE 'review' END AS verdict FROM j WHERE s >= 0.45")
def resolution(t: Tables) -> DataFrame:
    """Pairs of one block and brand whose names are alike. Names are compared once for all rows that have them; rows meet by the names that are."""
    names = t.part.select(F.lower("p_name").alias("name")).distinct().select("name", F.left("name", F.lit(4)).alias("block"), trigrams(F.col("name")).alias("g"))
    others = names.select(F.col("name").alias("other"), "block", F.col("g").alias("h"))
    alike = names.join(others, "block").select("name", "other", F.round(jaccard(F.col("g"), F.col("h")), 6).alias("s")).where("s >= 0.45")
    alike = scratch.maybe_broadcast(scratch.materialize(alike, "alike"))
    p = t.part.select(F.col("p_partkey").alias("a"), F.lower("p_name").alias("name"), "p_brand")
    pairs = p.join(alike, "name").join(p.select(F.col("a").alias("b"), F.col("name").alias("other"), "p_brand"), ["other", "p_brand"]).where("a < b")
    return pairs.select("a", "b", "s", F.when(F.col("s") >= 0.85, "auto").otherwise("review").alias("verdict"))


@query("ent04_precision_gate", "SELECT count(*) FILTER (quality = 1) AS predicted, count(*) FILTER (quality = 1 AND toxic = 0) AS right_ones, count(*) FILTER (quality = 1) >= 1 AND count(*) FILTER (quality = 1 AND toxic = 0) / count(*) FILTER (quality = 1) >= 0.95 AS open FROM labels")
def precision_gate(t: Tables) -> DataFrame:
    predicted, right = F.count_if(F.col("quality") == 1), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0))
    return t.labels.agg(predicted.alias("predicted"), right.alias("right_ones"), ((predicted >= 1) & (right / predicted >= 0.95)).alias("open"))


def consolidated(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node that pairs (a, b) lead to; the order of pairs doesn't matter."""
    return connected_components(pairs).select("node", F.col("component").alias("root"))


@query("ent05_consolidation", """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.08 AND l_tax > 0.07 AND l_returnflag = 'R'), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT a AS node, a AS root FROM s UNION SELECT s.b, root FROM r JOIN s ON s.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def consolidation(t: Tables) -> DataFrame:
    pairs = t.lineitem.where("l_quantity = 50 AND l_discount > 0.08 AND l_tax > 0.07 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b")).distinct()
    return consolidated(pairs)


@query("ent05_consolidation_all")
def consolidation_all(t: Tables) -> DataFrame:
    return consolidated(t.lineitem.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b")))


_URL = r"rtrim(regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?', ''), '[?#].*$', ''), '/')"


@query("ent06_source_merge", f"SELECT key, count(*) AS n, min(page_id) AS winner FROM (SELECT page_id, regexp_extract({_URL}, '^[^/]+') AS key FROM pages) GROUP BY key HAVING count(*) > 1")
def source_merge(t: Tables) -> DataFrame:
    url = F.regexp_replace(F.regexp_replace(F.lower("url"), r"^https?://(www\.)?", ""), "[?#].*$", "")
    rows = t.pages.select("page_id", F.regexp_extract(F.rtrim(url, F.lit("/")), "^[^/]+", 0).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("winner")).where("n > 1")


@query("ent07_variants", "SELECT base, arg_min(p_partkey, (-p_size, p_retailprice, p_partkey)) AS canonical, count(*) AS variants FROM (SELECT *, split_part(p_name, ' ', 1) AS base FROM part) GROUP BY base")
def variants(t: Tables) -> DataFrame:
    rows = t.part.withColumn("base", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return rows.groupBy("base").agg(F.min_by("p_partkey", F.struct(-F.col("p_size"), "p_retailprice", "p_partkey")).alias("canonical"), F.count("*").alias("variants"))


@query("ent08_code_linker", "WITH k AS (SELECT DISTINCT p_brand FROM part) SELECT l_orderkey, l_linenumber, coalesce(a.p_brand, b.p_brand, 'none') AS brand FROM lineitem LEFT JOIN k a ON a.p_brand = 'Brand#' || l_suppkey LEFT JOIN k b ON b.p_brand = 'Brand#' || (11 + l_linenumber)")
def code_linker(t: Tables) -> DataFrame:
    known = t.part.select("p_brand").distinct()
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("Brand#"), "l_suppkey").alias("exact"), F.concat(F.lit("Brand#"), F.lit(11) + F.col("l_linenumber")).alias("loose"))
    for form in ("exact", "loose"):
        rows = rows.join(known.select(F.col("p_brand").alias(form), F.col("p_brand").alias(f"found_{form}")), form, "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("found_exact", "found_loose", F.lit("none")).alias("brand"))
