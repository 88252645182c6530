"""Feeds and reports over several tables: the change feed with its confirmations, dossiers with a timeline, gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..registry import Tables, query

# ---- the change feed ----


def change_feed(changes: DataFrame, domains: DataFrame, take: int = 50, where: Column | None = None) -> DataFrame:
    """(id, source, type, detected_at, domain, place, confirmation, confirmed_by, confirmed_at): the newest changes with a row for each confirmation.

    ``changes`` (id, source, type, detected_at, consolidated_with): primaries are those that no other one took in; editorial ones are not
    shown; ``where`` filters further. Of equal times the greater id is newer. Confirmations are the changes that a primary took in, numbered
    from the first detected; a primary without any has one row of nulls. ``domains`` (id, domain) tints a change: the least domain.
    """
    primaries = changes.where("consolidated_with IS NULL AND type <> 'editorial'")
    newest = (primaries if where is None else primaries.where(where)).orderBy(F.desc("detected_at"), F.desc("id")).limit(take)
    newest = newest.select("id", "source", "type", "detected_at")
    told = changes.where("consolidated_with IS NOT NULL").join(F.broadcast(newest.select(F.col("id").alias("_p"))), F.col("consolidated_with") == F.col("_p"))  # at most ``take`` rows
    order = Window.partitionBy("_p").orderBy("detected_at", "id")
    told = told.select("_p", F.row_number().over(order).alias("place"), F.col("id").alias("confirmation"), F.col("source").alias("confirmed_by"), F.col("detected_at").alias("confirmed_at"))
    tint = domains.join(F.broadcast(newest.select("id")), "id").groupBy("id").agg(F.min("domain").alias("domain"))
    return newest.join(tint, "id", "left").join(told, F.col("id") == F.col("_p"), "left").select("id", "source", "type", "detected_at", "domain", "place", "confirmation", "confirmed_by", "confirmed_at")


_CHANGES = """ch AS (SELECT event_id AS id, user_id AS source, CASE event_type WHEN 'view' THEN 'editorial' ELSE event_type END AS type, ts AS detected_at,
  nullif(first_value(event_id) OVER (PARTITION BY event_type, json_extract_string(props, '$.k'), CAST(ts AS DATE) ORDER BY ts, event_id), event_id) AS consolidated_with, value FROM events)"""


@query(
    "cdc05_feed",
    f"""WITH {_CHANGES}, n AS (SELECT * FROM ch WHERE consolidated_with IS NULL AND type <> 'editorial' AND value > 20 ORDER BY detected_at DESC, id DESC LIMIT 50),
    c AS (SELECT consolidated_with AS p, id, source, detected_at, row_number() OVER (PARTITION BY consolidated_with ORDER BY detected_at, id) AS place FROM ch WHERE consolidated_with IN (SELECT id FROM n))
    SELECT n.id, n.source, n.type, n.detected_at, (SELECT min(n_name) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = n.source) AS domain, c.place, c.id AS confirmation, c.source AS confirmed_by, c.detected_at AS confirmed_at FROM n LEFT JOIN c ON c.p = n.id""",
)
def feed(t: Tables) -> DataFrame:
    """Events as changes: those of one kind, subject and day confirm the first one; the nation of the user is the domain."""
    kind, subject, day = F.col("event_type"), F.get_json_object("props", "$.k"), F.to_date("ts")
    rows = t.events.withColumns({"_k": subject, "_d": day})
    first = rows.groupBy("event_type", "_k", "_d").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("_first"))
    rows = rows.join(first, rows["event_type"].eqNullSafe(first["event_type"]) & rows["_k"].eqNullSafe(first["_k"]) & rows["_d"].eqNullSafe(first["_d"])).select(rows["*"], "_first")
    changes = rows.select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.when(kind == "view", "editorial").otherwise(kind).alias("type"), F.col("ts").alias("detected_at"), F.nullif("_first", F.col("event_id")).alias("consolidated_with"), "value")
    nations = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("source"), F.col("n_name").alias("domain"))
    return change_feed(changes, changes.select("id", "source").join(nations, "source"), 50, F.col("value") > 20)


# ---- dossiers ----


#: Slices that the entries of one source are dealt to before the newest of all slices are put in one line.
SLICES = 8


def _slice(ref: str) -> Column:
    return F.pmod(F.xxhash64(F.col(ref).cast("string")), F.lit(SLICES)).alias("_slice")


def dossier(every: DataFrame, newest: int, rows: int) -> DataFrame:
    """(source, kind, n, items, place, ref, at): for each source and kind of child how many rows and distinct refs it has, with a row for each
    of the ``newest`` ones. ``every`` (source, kind, ref, at) holds all kinds in about ``rows`` rows; slices of a source are counted and cut first."""
    dealt = scratch.spread(every.select("*", _slice("ref")), rows, "source", "kind", "_slice")
    refs = dealt.groupBy("source", "kind", "_slice", "ref").agg(F.count("*").alias("c"), F.max("at").alias("at"))
    by = Window.partitionBy("source", "kind", "_slice")
    order = [F.desc_nulls_last("at"), F.asc("ref")]
    near = refs.select("*", F.sum("c").over(by).alias("cs"), F.count("*").over(by).alias("rs"), F.row_number().over(by.orderBy(*order)).alias("_p")).where(F.col("_p") <= newest)
    near = scratch.materialize(near.drop("c"), "newest")
    counts = near.where("_p = 1").groupBy("source", "kind").agg(F.sum("cs").alias("n"), F.sum("rs").alias("items"))
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("source", "kind").orderBy(*order))).where(F.col("place") <= newest)
    same = counts["source"].eqNullSafe(best["source"]) & (counts["kind"] == best["kind"])
    return counts.join(best, same).select(counts["source"], counts["kind"], "n", "items", "place", "ref", "at")


def timeline(every: DataFrame, newest: int, rows: int) -> DataFrame:
    """(source, place, ledger, ref, at): the entries of several ledgers in one line for each source, the newest first. ``every`` (source, ledger, ref,
    at) holds about ``rows`` entries; slices of a source are cut first."""
    order = [F.desc_nulls_last("at"), F.asc("ledger"), F.asc("ref")]
    dealt = scratch.spread(every.select("source", "ledger", "ref", "at", _slice("ref")), rows, "source", "_slice")
    near = dealt.withColumn("_p", F.row_number().over(Window.partitionBy("source", "_slice").orderBy(*order))).where(F.col("_p") <= newest).drop("_p", "_slice")
    return near.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("place") <= newest)


_LINES = "l AS (SELECT l_suppkey AS source, l_partkey, l_orderkey, l_linenumber, l_shipdate, l_returnflag, o_orderdate, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _supplied(t: Tables) -> tuple[DataFrame, int]:
    """The lines with their orders, and how many lines there are."""
    rows = t.lineitem.count()
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("source"), "l_shipdate", "l_returnflag")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    return scratch.spread(line, rows, "l_orderkey").join(scratch.spread(orders, rows, "l_orderkey"), "l_orderkey"), rows


@query(
    "agg37_dossiers",
    f"""WITH {_LINES}, r AS (SELECT source, 'item' AS kind, l_partkey AS ref, l_shipdate AS seen_at FROM l UNION ALL SELECT source, 'order', l_orderkey, o_orderdate FROM l UNION ALL SELECT source, 'customer', o_custkey, o_orderdate FROM l),
    f AS (SELECT source, kind, ref, count(*) AS c, max(seen_at) AS seen_at FROM r GROUP BY ALL)
    SELECT source, kind, CAST(sum(c) OVER w AS BIGINT) AS n, count(*) OVER w AS items, row_number() OVER (PARTITION BY source, kind ORDER BY seen_at DESC NULLS LAST, ref) AS place, ref, seen_at FROM f WINDOW w AS (PARTITION BY source, kind) QUALIFY place <= 5""",
)
def dossiers(t: Tables) -> DataFrame:
    """What each supplier has given: items, orders and customers, with the five newest of each."""
    lines, rows = _supplied(t)
    child = lambda kind, ref, at: F.struct(F.lit(kind).alias("kind"), F.col(ref).cast("long").alias("ref"), F.col(at).alias("at"))
    every = lines.select("source", F.inline(F.array(child("item", "l_partkey", "l_shipdate"), child("order", "l_orderkey", "o_orderdate"), child("customer", "o_custkey", "o_orderdate"))))
    return dossier(every, 5, 3 * rows).withColumnRenamed("at", "seen_at")


@query(
    "agg37_timeline",
    f"""WITH {_LINES}, r AS (SELECT source, 'ordered' AS ledger, l_orderkey AS ref, o_orderdate AS seen_at FROM l UNION ALL SELECT source, 'shipped', l_orderkey * 10 + l_linenumber, l_shipdate FROM l UNION ALL SELECT source, 'returned', l_orderkey * 10 + l_linenumber, l_shipdate + INTERVAL 7 DAY FROM l WHERE l_returnflag = 'R')
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY seen_at DESC NULLS LAST, ledger, ref) AS place, ledger, ref, seen_at FROM (SELECT DISTINCT * FROM r) QUALIFY place <= 12""",
)
def timelines(t: Tables) -> DataFrame:
    """The twelve newest entries of three ledgers of each supplier."""
    lines, rows = _supplied(t)
    line = F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")
    entry = lambda ledger, ref, at: F.struct(F.lit(ledger).alias("ledger"), ref.cast("long").alias("ref"), at.alias("at"))
    returned = F.when(F.col("l_returnflag") == "R", entry("returned", line, F.col("l_shipdate") + F.expr("INTERVAL 7 DAYS")))
    entries = F.filter(F.array(entry("ordered", F.col("l_orderkey"), F.col("o_orderdate")), entry("shipped", line, F.col("l_shipdate")), returned), lambda e: e.isNotNull())
    # Equal entries are of one order, so they are found where the lines met it.
    every = lines.select("l_orderkey", "source", F.inline(entries)).distinct()
    return timeline(every, 12, 3 * rows).withColumnRenamed("at", "seen_at")


# ---- gaps ----


@query(
    "cdc11_gap_report",
    r"""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS word FROM benchmark), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS word FROM documents)
    SELECT 'signal' AS section, 'empty_retrieval' AS key, CAST(count(*) AS DOUBLE) AS value, CASE WHEN count(*) > 0 THEN 'open' ELSE 'ok' END AS status FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM w JOIN d USING (word) WHERE w.item_id = b.item_id)
    UNION ALL SELECT 'signal', 'failure:' || user_id, count(*), CASE WHEN count(*) >= 10 THEN 'open' ELSE 'watch' END FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3
    UNION ALL SELECT 'signal', 'negative_feedback:' || source, count(*), 'open' FROM documents JOIN labels USING (doc_id) WHERE quality = 0 OR toxic = 1 GROUP BY source
    UNION ALL SELECT 'source', source, count(*) FILTER (l.doc_id IS NULL) / count(*), CASE WHEN count(l.doc_id) = 0 THEN 'never' WHEN count(l.doc_id) = count(*) THEN 'done' ELSE 'partly' END FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id WHERE source IS NOT NULL GROUP BY source
    UNION ALL SELECT 'coverage', p_brand, count(DISTINCT p_size) / max(p_size), CASE WHEN count(DISTINCT p_size) = max(p_size) THEN 'whole' ELSE 'missing' END FROM part GROUP BY p_brand
    UNION ALL SELECT 'drift', event_type, round(count(*) FILTER (ts >= half) / max(later) - count(*) FILTER (ts < half) / max(earlier), 6), CASE WHEN abs(count(*) FILTER (ts >= half) / max(later) - count(*) FILTER (ts < half) / max(earlier)) > 0.02 THEN 'drifts' ELSE 'steady' END
      FROM events, (SELECT min(ts) + INTERVAL 15 DAY AS half FROM events), (SELECT greatest(1, count(*) FILTER (ts >= (SELECT min(ts) + INTERVAL 15 DAY FROM events))) AS later, greatest(1, count(*) FILTER (ts < (SELECT min(ts) + INTERVAL 15 DAY FROM events))) AS earlier FROM events) GROUP BY event_type""",
)
def gap_report(t: Tables) -> DataFrame:
    """What is missing: questions no text meets, failures by user, bad feedback by source; sources by how far they are labelled; sizes that a
    brand lacks; kinds of events whose share has moved."""
    row = lambda section, key, value, status: [F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"), status.alias("status")]
    words = lambda df, *keys: df.select(*keys, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"))).alias("word")).distinct()
    met = words(t.benchmark, "item_id").join(words(t.documents), "word", "left_semi").select("item_id").distinct()
    lacking = t.benchmark.join(met, "item_id", "left_anti").agg(F.count("*").alias("n"))
    parts = [lacking.select(*row("signal", F.lit("empty_retrieval"), F.col("n"), F.when(F.col("n") > 0, "open").otherwise("ok")))]
    failed = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 3")
    parts.append(failed.select(*row("signal", F.concat(F.lit("failure:"), "user_id"), F.col("n"), F.when(F.col("n") >= 10, "open").otherwise("watch"))))
    bad = t.documents.join(t.labels, "doc_id").where("quality = 0 OR toxic = 1").groupBy("source").agg(F.count("*").alias("n"))
    parts.append(bad.select(*row("signal", F.concat(F.lit("negative_feedback:"), "source"), F.col("n"), F.lit("open"))))
    known = t.documents.where("source IS NOT NULL").join(t.labels.select("doc_id").distinct().withColumn("done", F.lit(1)), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("done").alias("done"))
    parts.append(known.select(*row("source", F.col("source"), (F.col("n") - F.col("done")) / F.col("n"), F.when(F.col("done") == 0, "never").when(F.col("done") == F.col("n"), "done").otherwise("partly"))))
    sizes = t.part.groupBy("p_brand").agg(F.countDistinct("p_size").alias("n"), F.max("p_size").alias("m"))
    parts.append(sizes.select(*row("coverage", F.col("p_brand"), F.col("n") / F.col("m"), F.when(F.col("n") == F.col("m"), "whole").otherwise("missing"))))
    half = t.events.agg((F.min("ts") + F.expr("INTERVAL 15 DAYS")).alias("half"))
    halves = t.events.crossJoin(F.broadcast(half)).groupBy("event_type").agg(F.count_if(F.col("ts") >= F.col("half")).alias("b"), F.count_if(F.col("ts") < F.col("half")).alias("a"))
    totals = halves.agg(F.greatest(F.lit(1), F.sum("b")).alias("later"), F.greatest(F.lit(1), F.sum("a")).alias("earlier"))
    moved = halves.crossJoin(F.broadcast(totals)).withColumn("d", F.col("b") / F.col("later") - F.col("a") / F.col("earlier"))
    parts.append(moved.select(*row("drift", F.col("event_type"), F.round("d", 6), F.when(F.abs("d") > 0.02, "drifts").otherwise("steady"))))
    return reduce(DataFrame.unionByName, parts)


# ---- aliases ----


@query(
    "agg33_alias_order",
    r"""WITH a AS (SELECT p_brand, p_name AS alias, regexp_replace(lower(trim(p_name)), '[^a-z]+', '', 'g') AS form, p_partkey FROM part), f AS (SELECT p_brand, form, min(p_partkey) AS first, arg_min(alias, p_partkey) AS alias, count(*) AS n FROM a GROUP BY ALL)
    SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY first) AS place, alias, n FROM f""",
)
def alias_order(t: Tables) -> DataFrame:
    """The names of each brand, one for each normal form (letters only, in small), in the order in which they first came; a row each, so no list grows without bound."""
    form = F.regexp_replace(F.lower(F.trim("p_name")), "[^a-z]+", "")
    forms = t.part.groupBy("p_brand", form.alias("form")).agg(F.min(F.struct("p_partkey", "p_name")).alias("f"), F.count("*").alias("n"))
    return forms.select("p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy("f.p_partkey")).cast("long").alias("place"), F.col("f.p_name").alias("alias"), "n")


# ---- drift of entities, versions of a structure ----


def entity_drift(entities: DataFrame, order: list[str]) -> DataFrame:
    """(kind, place, live, candidates, canonical, tombstones, singletons) of ``entities`` (kind, status, aliases array): live ones are candidates and canonical ones,
    singletons the live ones that took in no alias. Kinds stand in ``order``, others after them by name."""
    status, lone = F.col("status"), F.coalesce(F.size("aliases") <= 0, F.lit(True))
    counts = entities.groupBy("kind").agg(F.count_if(status == "candidate").alias("candidates"), F.count_if(status == "canonical").alias("canonical"), F.count_if(status == "merged").alias("tombstones"), F.count_if((status != "merged") & lone).alias("singletons"))
    known = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    place = F.row_number().over(Window.orderBy(F.when(known > 0, known).otherwise(len(order) + 1), "kind"))  # one row for each kind
    return counts.select("kind", place.alias("place"), (F.col("candidates") + F.col("canonical")).alias("live"), "candidates", "canonical", "tombstones", "singletons")


_DRIFT_KINDS = ["STANDARD", "SMALL", "LARGE"]


@query(
    "agg27_live_drift",
    """WITH e AS (SELECT p_type AS kind, CASE WHEN p_partkey > min(p_partkey) OVER (PARTITION BY p_name, p_brand) THEN 'merged' WHEN p_retailprice >= 1000 THEN 'canonical' ELSE 'candidate' END AS status, list_filter(string_split(p_name, ' '), lambda w: length(w) > 5) AS aliases FROM part),
    c AS (SELECT kind, count(*) FILTER (status = 'candidate') AS candidates, count(*) FILTER (status = 'canonical') AS canonical, count(*) FILTER (status = 'merged') AS tombstones, count(*) FILTER (status <> 'merged' AND len(aliases) = 0) AS singletons FROM e GROUP BY kind)
    SELECT kind, row_number() OVER (ORDER BY CASE kind WHEN 'STANDARD' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'LARGE' THEN 3 ELSE 4 END, kind) AS place, candidates + canonical AS live, candidates, canonical, tombstones, singletons FROM c""",
)
def live_drift(t: Tables) -> DataFrame:
    """Items as entities: the first of a name and brand is alive, later ones were merged into it; long words of a name are its aliases."""
    first = t.part.groupBy(F.col("p_name").alias("_n"), F.col("p_brand").alias("_b")).agg(F.min("p_partkey").alias("_first"))
    rows = t.part.join(first, F.col("p_name").eqNullSafe(F.col("_n")) & F.col("p_brand").eqNullSafe(F.col("_b")))
    status = F.when(F.col("p_partkey") > F.col("_first"), "merged").when(F.col("p_retailprice") >= 1000, "canonical").otherwise("candidate")
    aliases = F.filter(F.split("p_name", " "), lambda w: F.length(w) > 5)
    return entity_drift(rows.select(F.col("p_type").alias("kind"), status.alias("status"), aliases.alias("aliases")), _DRIFT_KINDS)


def version_changes(old: DataFrame, new: DataFrame, strict: str) -> DataFrame:
    """(name, change, added, removed): how the structures (name, axis, line) differ. The same lines are a ``patch``; lines that only came are ``minor``; a line
    that went, or any difference on the axis ``strict``, is ``major``. Lines meet by equality and are counted map-side."""
    side = lambda df, name: df.select("name", "axis", "line").distinct().withColumn(name, F.lit(1))
    rows = side(old, "was").join(side(new, "now"), ["name", "axis", "line"], "full")
    came, went = F.col("was").isNull(), F.col("now").isNull()
    found = rows.groupBy("name").agg(F.count_if(came).alias("added"), F.count_if(went).alias("removed"), F.count_if((came | went) & (F.col("axis") == strict)).alias("strict"))
    change = F.when((F.col("added") == 0) & (F.col("removed") == 0), "patch").when((F.col("removed") > 0) | (F.col("strict") > 0), "major").otherwise("minor")
    return found.select("name", change.alias("change"), "added", "removed")


@query(
    "ont04_change_class",
    """WITH o AS (SELECT p_brand AS name, unnest(['class', 'relation', 'disjoint']) AS axis, unnest([p_type, split_part(p_name, ' ', 1), CASE WHEN p_size = 50 THEN p_type END]) AS line, p_retailprice FROM part WHERE p_size <= 48 OR p_size = 50),
    a AS (SELECT DISTINCT name, axis, line FROM o WHERE line IS NOT NULL AND p_retailprice < 1090), b AS (SELECT DISTINCT name, axis, line FROM o WHERE line IS NOT NULL AND (p_retailprice < 1100 OR axis = 'class')),
    f AS (SELECT coalesce(a.name, b.name) AS name, coalesce(a.axis, b.axis) AS axis, a.name IS NULL AS came, b.name IS NULL AS went FROM a FULL JOIN b ON a.name = b.name AND a.axis = b.axis AND a.line = b.line)
    SELECT name, CASE WHEN count(*) FILTER (came OR went) = 0 THEN 'patch' WHEN count(*) FILTER (went) > 0 OR count(*) FILTER ((came OR went) AND axis = 'disjoint') > 0 THEN 'major' ELSE 'minor' END AS change, count(*) FILTER (came) AS added, count(*) FILTER (went) AS removed FROM f GROUP BY name""",
)
def change_class(t: Tables) -> DataFrame:
    """The structure of each brand before and after dearer items came: its types, the first words of its names, the types of its largest size."""
    rows = t.part.where("p_size <= 48 OR p_size = 50")
    line = lambda axis, c: F.struct(F.lit(axis).alias("axis"), c.alias("line"))
    lines = rows.select(F.col("p_brand").alias("name"), "p_retailprice", F.inline(F.array(line("class", F.col("p_type")), line("relation", F.split_part("p_name", F.lit(" "), F.lit(1))), line("disjoint", F.when(F.col("p_size") == 50, F.col("p_type")))))).where("line IS NOT NULL")
    return version_changes(lines.where("p_retailprice < 1090"), lines.where("p_retailprice < 1100 OR axis = 'class'"), "disjoint")
