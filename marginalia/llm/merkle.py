"""Operator 12: Merkle manifest of a dataset, its leaves placed by ranks in compressed bitmaps.

Each group of rows (a language) keeps the bitmap of its integer keys: only words of 64 keys that hold one are stored, merged
by ``bit_or`` before any shuffle, and next to it the number of rows of each word. A directory of such counts over nodes of
4,096 words, and of 4,096 of these nodes, says how many rows stand before a word; the bits below a key say how many stand before
it inside the word. This rank is the coordinate of a leaf: leaves are never sorted. Leaves then meet by (group, coordinate / 8)
in arrays of eight keyed slots, whose digest is the node above, level by level, and the tops of the groups meet alike in
the order of their groups. On the way down each node hands its steps (what stands before and after it in its run) to its children.

Null keys come before all others, rows that repeat a key go by the digest of their leaf (rows with equal digests are alike, each keeps
a place of its own); only words that hold such rows are ranked by a distributed sort. A null group is a group, the first one. Null fields
count as ``-``, empty ones as length 0; texts of any length are hashed whole. Columns that are not named are left out, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranges
from . import common

#: Children of a node of the directory, as bits of their number, and the slots of a run.
FAN_BITS, RUN = 12, 8


def digest(*parts: Column) -> Column:
    """The hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as ``-`` if null, else its length in bytes, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join by ``keys`` in which nulls meet nulls."""
    told = right.select(*(F.col(k).alias(f"_r{j}") for j, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = [left[k].eqNullSafe(told[f"_r{j}"]) for j, k in enumerate(keys)]
    return left.join(told, on).drop(*(f"_r{j}" for j in range(len(keys))))


def bitmaps(rows: DataFrame) -> DataFrame:
    """(grp, word, bits, n): the words of each group's bitmap of keys that hold one, and how many rows each word has."""
    return rows.groupBy("grp", F.shiftright("key", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(key & 63 AS int)))").alias("bits"), F.count("*").alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """``words`` with ``before``, the rows of the group in earlier words, and ``total``, all rows of the group."""
    least, most = words.agg(F.min("word"), F.max("word")).first()
    nodes, tables = words.select("grp", F.col("word").alias("node"), "n"), []
    for _ in range(-(-58 // FAN_BITS)):  # a word has 58 bits
        if least == most:
            break
        least, most = least >> FAN_BITS, most >> FAN_BITS
        above = F.shiftright("node", FAN_BITS)
        tables.append(nodes.withColumn("above", above).withColumn("inside", _sum_before("grp", "above")))
        nodes = nodes.groupBy("grp", above.alias("node")).agg(F.sum("n").alias("n"))
    found = nodes.withColumn("before", _sum_before("grp")).withColumn("total", F.sum("n").over(Window.partitionBy("grp")))
    for table in reversed(tables):
        tops = found.select("grp", F.col("node").alias("above"), F.col("before").alias("start"), "total")
        found = _meet(table, tops, ["grp", "above"]).select("grp", "node", "n", (F.col("start") + F.col("inside")).alias("before"), "total")
    return _meet(words, found.select("grp", F.col("node").alias("word"), "before", "total"), ["grp", "word"])


def _sum_before(*keys: str) -> Column:
    """Rows in earlier nodes below the same parent: at most as many nodes as a parent has."""
    return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.col("node").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` (grp, key, leaf and more) with ``place``, from 0 in each group, and ``total``, by rank queries on the bitmaps."""
    told = directory(words)
    again = told.where("n > coalesce(bit_count(bits), 0)")
    keyed = rows.withColumn("word", F.shiftright("key", 6))
    rank = F.expr("before + bit_count(bits & ~shiftleft(-1L, CAST(key & 63 AS int)))")
    if words.where("n > coalesce(bit_count(bits), 0)").isEmpty():
        return _meet(keyed, told, ["grp", "word"]).withColumn("place", rank).drop("word", "bits", "n", "before")
    keyed = common.materialize(keyed, "leaves")
    plain = _meet(keyed, told.where("n = bit_count(bits)"), ["grp", "word"]).withColumn("place", rank).drop("word", "bits", "n", "before")
    crowded = ranges.ranked(_meet(keyed, again, ["grp", "word"]), "_at", F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"))
    crowded = common.materialize(crowded, "crowded")
    first = crowded.groupBy("grp", "word").agg(F.min("_at").alias("_first"))
    crowded = _meet(crowded, first, ["grp", "word"]).withColumn("place", F.col("before") + F.col("_at") - F.col("_first"))
    return plain.unionByName(crowded.select(plain.columns))


def _slots(nodes: DataFrame, member: Column) -> DataFrame:
    """(grp, place, total, slots): ``member`` of the nodes of each run, by its slot in it."""
    slot = (F.col("place") % RUN).cast("int")
    runs = nodes.groupBy("grp", F.expr(f"place div {RUN}").alias("place"), "total").agg(F.map_from_entries(F.collect_list(F.struct(slot, member))).alias("by_slot"))
    slots = F.transform(F.sequence(F.lit(0), F.size("by_slot") - 1), lambda s: F.col("by_slot")[s])
    return runs.select("grp", "place", F.expr(f"(total + {RUN - 1}) div {RUN}").alias("total"), slots.alias("slots"))


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The runs of each level above ``nodes`` (grp, place, total, node): (grp, place, total, slots, node), written."""
    out = []
    while most > 1:
        runs = _slots(nodes.where("total > 1"), F.col("node")).withColumn("node", digest(F.array_join("slots", "")))
        out.append(common.materialize(runs, "runs"))
        nodes, most = out[-1].drop("slots"), -(-most // RUN)
    return out


def _tops(levels: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """(grp, node): the node that each group ends with."""
    found = nodes.where("total = 1").select("grp", "node")
    for level in levels:
        found = found.unionByName(level.where("total = 1").select("grp", "node"))
    return found


def step(slots: Column, slot: Column) -> Column:
    """What stands before and after a slot in its run."""
    return F.struct(F.array_join(F.slice(slots, F.lit(1), slot), "").alias("pre"), F.array_join(F.slice(slots, slot + 2, F.lit(RUN)), "").alias("post"))


def _down(levels: list[DataFrame], tops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grp, place, steps, and what ``tops`` (grp, steps, ...) say of the group): the steps of each of ``nodes`` up to the root."""
    carried = [c for c in tops.columns if c not in ("grp", "steps")]
    paths = None
    for k in range(len(levels), -1, -1):
        level = levels[k - 1] if k else nodes
        own = _meet(level.where("total = 1").select("grp", "place"), tops, ["grp"]).select("grp", "place", "steps", *carried)
        paths = own if paths is None else paths.unionByName(own)
        if not k:
            return paths
        runs = _meet(level.select("grp", "place", "slots"), paths, ["grp", "place"])
        each = runs.select("grp", "place", "slots", "steps", *carried, F.posexplode("slots").alias("slot", "_node"))
        paths = each.select("grp", (F.col("place") * RUN + F.col("slot")).alias("place"), F.concat(F.array(step(F.col("slots"), F.col("slot"))), F.col("steps")).alias("steps"), *carried)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), also: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, steps, and the columns ``also``): each row's leaf and the way from it to the root.

    Leaves of a group ascend by ``key``; ``steps`` array<struct<pre, post>> holds for each level what stands before and after the
    node in its run, so that ``fold`` gives the root. ``also`` is worked out from the row beside its leaf.
    """
    also = also or {}
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(group).alias("grp"), leaf(*map(F.col, fields)).alias("leaf"), F.struct(F.lit(0).alias("_"), *(c.alias(n) for n, c in also.items())).alias("also"))
    words = common.materialize(bitmaps(rows), "bitmaps")
    most = words.groupBy("grp").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    # The lowest runs hold the leaves with what belongs to them; a group of one leaf ends with the leaf itself.
    runs = _slots(placed(rows, words).withColumn("alone", F.col("total") == 1), F.struct("key", "leaf", "also", "alone"))
    node = F.when(F.col("slots")[0]["alone"], F.col("slots")[0]["leaf"]).otherwise(digest(F.array_join(F.col("slots.leaf"), "")))
    lowest = common.materialize(runs.withColumn("node", node), "runs")
    nodes = lowest.drop("slots")
    levels = _levels(nodes, -(-most // RUN))
    # The tops of the groups, in the order of the groups, are the nodes of one more tree.
    tops = common.materialize(_tops(levels, nodes), "tops")
    heads = ranges.ranked(tops, "_at", F.col("grp").asc_nulls_first())
    groups = tops.count()
    heads = common.materialize(heads.select(F.lit(0).alias("grp"), (F.col("_at") - 1).alias("place"), F.lit(groups).cast("long").alias("total"), "node", F.col("grp").alias("of")), "heads")
    above = _levels(heads.drop("of"), groups)
    root = _tops(above, heads).select("grp", F.col("node").alias("root")).withColumn("steps", F.array().cast("array<struct<pre:string,post:string>>"))
    ends = _meet(heads.select("grp", "place", "of", F.col("node").alias("subroot")), _down(above, root, heads), ["grp", "place"])
    ends = ends.select(F.col("of").alias("grp"), "subroot", "root", "steps")
    paths = _down(levels, ends, nodes)
    each = _meet(lowest.select("grp", "place", "slots"), paths, ["grp", "place"])
    each = each.select("subroot", "root", "steps", "slots", F.posexplode("slots").alias("slot", "m"))
    own = F.when(F.col("m.alone"), F.array().cast("array<struct<pre:string,post:string>>")).otherwise(F.array(step(F.col("slots.leaf"), F.col("slot"))))
    return each.select(F.col("m.key").cast(docs.schema[key].dataType).alias(key), F.col("m.leaf").alias("leaf"), "subroot", "root", F.concat(own, F.col("steps")).alias("steps"), *(F.col(f"m.also.{n}").alias(n) for n in also))


def fold(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its steps."""
    return F.aggregate(steps, start, lambda node, s: digest(s["pre"], node, s["post"]))


def proof(steps: Column) -> Column:
    """All siblings of a leaf and of the nodes above it, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["pre"], s["post"])), "")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; rows whose id's crc32 3 divides (a null id's is not looked at) are checked with a changed text."""
    docs = common.table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lowered))
    found = manifest(docs, also={"changed": changed}).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("steps")))
    return found.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("steps"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Contract in SQL: leaves numbered by row_number, both trees level by level, each document's siblings, and the fold of its leaf.
OP12_SQL = """
WITH RECURSIVE crc_step AS (
  SELECT b, list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT range AS b FROM range(256))
), crc AS (SELECT list(v ORDER BY b) AS t FROM crc_step),
rows_in AS (
  SELECT doc_id, lang, source, n_chars, text,
    concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT) + 1, 1)) AS BIGINT))),
      lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS crc
  FROM documents, crc
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS changed
  FROM rows_in
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), tree AS (
  SELECT 0 AS level, lang, place, leaf AS node, n FROM placed
  UNION ALL
  SELECT level + 1, lang, place // 8, sha256(string_agg(node, '' ORDER BY place)), CAST(ceil(n / 8.0) AS BIGINT) FROM tree WHERE n > 1 GROUP BY level, lang, place // 8, n
), heads AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1
), upper_tree AS (
  SELECT 0 AS level, place, subroot AS node, n FROM heads
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), CAST(ceil(n / 8.0) AS BIGINT) FROM upper_tree WHERE n > 1 GROUP BY level, place // 8, n
), sides AS (
  SELECT p.lang, p.place, t.level, string_agg(t.node, '' ORDER BY t.place) FILTER (t.place < p.place // CAST(pow(8, t.level) AS BIGINT)) AS pre,
    string_agg(t.node, '' ORDER BY t.place) FILTER (t.place > p.place // CAST(pow(8, t.level) AS BIGINT)) AS post
  FROM placed p JOIN tree t ON p.lang IS NOT DISTINCT FROM t.lang AND t.n > 1 AND p.place // CAST(pow(8, t.level + 1) AS BIGINT) = t.place // 8 GROUP BY ALL
), upper_sides AS (
  SELECT p.lang, t.level, string_agg(t.node, '' ORDER BY t.place) FILTER (t.place < p.place // CAST(pow(8, t.level) AS BIGINT)) AS pre,
    string_agg(t.node, '' ORDER BY t.place) FILTER (t.place > p.place // CAST(pow(8, t.level) AS BIGINT)) AS post
  FROM heads p JOIN upper_tree t ON t.n > 1 AND p.place // CAST(pow(8, t.level + 1) AS BIGINT) = t.place // 8 GROUP BY ALL
), steps AS (
  SELECT lang, place, list({'pre': coalesce(pre, ''), 'post': coalesce(post, '')} ORDER BY level) AS s FROM sides GROUP BY ALL
), upper_steps AS (
  SELECT lang, list({'pre': coalesce(pre, ''), 'post': coalesce(post, '')} ORDER BY level) AS s FROM upper_sides GROUP BY ALL
), whole AS (
  SELECT p.doc_id, p.leaf, coalesce(p.changed, p.leaf) AS start, h.subroot, r.node AS root, list_concat(coalesce(s.s, []), coalesce(u.s, [])) AS steps
  FROM placed p JOIN heads h ON p.lang IS NOT DISTINCT FROM h.lang CROSS JOIN (SELECT node FROM upper_tree WHERE n = 1) r
  LEFT JOIN steps s ON p.lang IS NOT DISTINCT FROM s.lang AND p.place = s.place LEFT JOIN upper_steps u ON p.lang IS NOT DISTINCT FROM u.lang
), folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_reduce(list_transform(steps, lambda x: x.pre || x.post), lambda a, b: a || b), '')) AS proof_sha256,
    list_reduce(list_concat([{'pre': start, 'post': ''}], steps), lambda a, x: {'pre': sha256(x.pre || a.pre || x.post), 'post': ''}).pre AS folded_root
  FROM whole
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
