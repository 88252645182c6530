"""Retrieval-evaluation metrics over expected and found lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import ORACLES, Tables, query


def overlap_scores(expected: Column, found: Column) -> dict[str, Column]:
    """Recall, precision and F1 of two lists. Nothing expected: recall 1; nothing found: precision 1; F1 0 where both are."""
    hit = F.size(F.array_intersect(expected, found))
    recall = F.when(F.size(expected) == 0, 1.0).otherwise(hit / F.size(expected))
    precision = F.when(F.size(found) == 0, 1.0).otherwise(hit / F.size(found))
    f1 = F.when(recall + precision == 0, 0.0).otherwise(2 * recall * precision / (recall + precision))
    return {"recall": recall, "precision": precision, "f1": f1}


_LISTS = "l AS (SELECT l_orderkey AS id, list_distinct(list(l_partkey) FILTER (l_linenumber % 2 = 1)) AS e, list_distinct(list(l_partkey) FILTER (l_linenumber <= 3)) AS f FROM lineitem GROUP BY 1), m AS (SELECT id, coalesce(e, []) AS e, coalesce(f, []) AS f FROM l), h AS (SELECT id, len(e) AS ne, len(f) AS nf, len(list_intersect(e, f)) AS n FROM m), s AS (SELECT id, CASE WHEN ne = 0 THEN 1.0 ELSE n / ne END AS recall, CASE WHEN nf = 0 THEN 1.0 ELSE n / nf END AS prec FROM h)"


def _lists(t: Tables) -> DataFrame:
    keep = lambda c: F.collect_set(F.when(c, F.col("l_partkey")))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(keep(F.col("l_linenumber") % 2 == 1).alias("e"), keep(F.col("l_linenumber") <= 3).alias("f"))


@query("evl01_scores", f"WITH {_LISTS} SELECT id, round(recall, 6) AS recall, round(prec, 6) AS precision, round(CASE WHEN recall + prec = 0 THEN 0.0 ELSE 2 * recall * prec / (recall + prec) END, 6) AS f1 FROM s")
def scores(t: Tables) -> DataFrame:
    found = overlap_scores(F.col("e"), F.col("f"))
    return _lists(t).select("id", *(F.round(c, 6).alias(n) for n, c in found.items()))


@query("evl02_consistency", "WITH d AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS o, l_returnflag AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey), g AS (SELECT c, o, list(f) AS fs FROM d GROUP BY 1, 2) SELECT a.c AS custkey, round(avg(len(list_intersect(a.fs, b.fs)) / (len(a.fs) + len(b.fs) - len(list_intersect(a.fs, b.fs)))), 6) AS consistency FROM g a JOIN g b ON a.c = b.c AND a.o < b.o GROUP BY 1")
def consistency(t: Tables) -> DataFrame:
    """Mean Jaccard similarity of the answers to paraphrases, over the pairs of each question."""
    both = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return agreement(both.select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.col("l_returnflag").alias("flag")))


def agreement(answers: DataFrame) -> DataFrame:
    """(custkey, consistency) of ``answers`` (custkey, o_orderkey, flag): the mean over all pairs of a customer's orders.

    Orders with equal sets are counted first and pairs of distinct sets weighted by their counts, so no customer's pairs are listed.
    """
    g = answers.groupBy("custkey", "o_orderkey").agg(F.array_sort(F.collect_set("flag")).alias("fs")).groupBy("custkey", "fs").agg(F.count("*").alias("n"))
    pairs = g.join(g.select("custkey", F.col("fs").alias("gs"), F.col("n").alias("m")), "custkey").where("fs <= gs")
    hit = F.size(F.array_intersect("fs", "gs"))
    weight = F.when(F.col("fs") == F.col("gs"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("m"))
    alike = F.when(F.col("fs") == F.col("gs"), 1.0).otherwise(hit / (F.size("fs") + F.size("gs") - hit))
    summed = pairs.groupBy("custkey").agg(F.sum(weight).alias("w"), F.sum(weight * alike).alias("s")).where("w > 0")
    return summed.select("custkey", F.round(F.col("s") / F.col("w"), 6).alias("consistency"))


@query("evl02_consistency_all", ORACLES["evl02_consistency"])
def consistency_all(t: Tables) -> DataFrame:
    return consistency(t)


@query("evl03_unpivot", f"WITH {_LISTS} SELECT metric, round(avg(x), 6) AS mean, count(*) AS samples FROM (SELECT 'recall' AS metric, recall AS x FROM s UNION ALL SELECT 'precision', prec FROM s) GROUP BY metric")
def unpivot(t: Tables) -> DataFrame:
    found = overlap_scores(F.col("e"), F.col("f"))
    long = _lists(t).select(found["recall"].alias("recall"), found["precision"].alias("precision")).select(F.expr("stack(2, 'recall', recall, 'precision', precision) AS (metric, x)"))
    return long.groupBy("metric").agg(F.round(F.avg("x"), 6).alias("mean"), F.count("*").alias("samples"))


@query("evl04_gate", "SELECT lang, list_filter([CASE WHEN avg(n_chars) < 2000 THEN 'short' END, CASE WHEN count(*) < 150 THEN 'few' END], lambda x: x IS NOT NULL) AS violations, NOT (avg(n_chars) < 2000 OR count(*) < 150) AS passed FROM documents GROUP BY lang")
def gate(t: Tables) -> DataFrame:
    rules = [F.when(F.avg("n_chars") < 2000, "short"), F.when(F.count("*") < 150, "few")]
    return t.documents.groupBy("lang").agg(F.array_compact(F.array(*rules)).alias("violations")).withColumn("passed", F.size("violations") == 0)


@query("evl07_choices", "SELECT event_type, 100.0 * avg(CASE WHEN regexp_extract(props, '([0-9]+)', 1) IN ('1', '2', '3') THEN 1 ELSE 0 END) AS percent FROM events GROUP BY 1")
def choices(t: Tables) -> DataFrame:
    right = F.regexp_extract("props", "([0-9]+)", 1).isin("1", "2", "3").cast("int")
    return t.events.groupBy("event_type").agg((100.0 * F.avg(right)).alias("percent"))


def share_within(part: Column, whole: Column) -> Column:
    """The share of ``part`` that is in ``whole``; 1 where there is nothing to look for."""
    return F.when(F.size(part) == 0, 1.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def _runs(t: Tables) -> DataFrame:
    """(id, gold, conditions, found, cited, forbidden, produced, judged, faithful): what each case asks for and what its run gave."""
    keep = lambda c: F.collect_set(F.when(c, F.col("l_partkey")))
    line = F.col("l_linenumber")
    held = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(keep(line % 2 == 1).alias("gold"), keep(F.col("l_tax") > 0.06).alias("conditions"), keep(line <= 3).alias("found"), keep(F.col("l_returnflag") == "R").alias("cited"), keep(F.col("l_tax") > 0.07).alias("forbidden"), keep(F.col("l_discount") > 0.05).alias("produced"))
    claims = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("ref"), (F.col("l_linestatus") == "F").alias("supported")).join(held.select("id", "found"), "id")
    judged = claims.groupBy("id").agg(F.count("*").alias("judged"), F.count_if(F.col("supported") & F.array_contains("found", F.col("ref"))).alias("faithful"))
    return held.join(judged, "id")


_RUNS = "r AS (SELECT l_orderkey AS id, " + ", ".join(f"coalesce(list_distinct(list(l_partkey) FILTER ({c})), []) AS {n}" for n, c in (("gold", "l_linenumber % 2 = 1"), ("conditions", "l_tax > 0.06"), ("found", "l_linenumber <= 3"), ("cited", "l_returnflag = 'R'"), ("forbidden", "l_tax > 0.07"), ("produced", "l_discount > 0.05"))) + " FROM lineitem GROUP BY 1)"
_SHARE = "round(CASE WHEN len({0}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / len({0}) END, 6)"


@query("evl01_citations", f"WITH {_RUNS} SELECT id, {_SHARE.format('found', 'gold')} AS relevancy, {_SHARE.format('gold', 'found')} AS recall, {_SHARE.format('cited', 'gold')} AS citation_precision, round(CASE WHEN len(forbidden) = 0 THEN 1.0 ELSE 1 - len(list_intersect(forbidden, produced)) / len(forbidden) END, 6) AS forbidden_recall FROM r")
def citations(t: Tables) -> DataFrame:
    """Relevancy, recall, precision of the citations, and the share of forbidden claims that were not made."""
    kept = F.when(F.size("forbidden") == 0, 1.0).otherwise(1 - F.size(F.array_intersect("forbidden", "produced")) / F.size("forbidden"))
    found = {"relevancy": share_within(F.col("found"), F.col("gold")), "recall": share_within(F.col("gold"), F.col("found")), "citation_precision": share_within(F.col("cited"), F.col("gold")), "forbidden_recall": kept}
    return _runs(t).select("id", *(F.round(c, 6).alias(n) for n, c in found.items()))


@query("evl02_grounding", f"WITH {_RUNS}, j AS (SELECT l_orderkey AS id, count(*) AS judged, count(*) FILTER (l_linestatus = 'F' AND list_contains(found, l_partkey)) AS faithful FROM lineitem JOIN r ON r.id = l_orderkey GROUP BY 1) SELECT id, {_SHARE.format('conditions', 'found')} AS path_recall, {_SHARE.format('cited', 'found')} AS citation_support, round(faithful / judged, 6) AS faithfulness FROM r JOIN j USING (id)")
def grounding(t: Tables) -> DataFrame:
    """Recall of the conditions, support of the citations by what was found, and the share of claims that hold and cite only that."""
    return _runs(t).select("id", F.round(share_within(F.col("conditions"), F.col("found")), 6).alias("path_recall"), F.round(share_within(F.col("cited"), F.col("found")), 6).alias("citation_support"), F.round(F.when(F.col("judged") == 0, 1.0).otherwise(F.col("faithful") / F.col("judged")), 6).alias("faithfulness"))


def regressions(samples: DataFrame, baseline: DataFrame, sigma: float = 2.0) -> DataFrame:
    """(kind, metric, counted, mean, samples, floor, regression) of ``samples`` (kind, metric, counted, x) against ``baseline``
    (kind, metric, base, spread): a mean below base - sigma * spread is a regression; without a baseline there is none."""
    cells = samples.groupBy("kind", "metric", "counted").agg(F.avg("x").alias("mean"), F.count("*").alias("samples")).join(baseline, ["kind", "metric"], "left")
    floor = F.col("base") - sigma * F.col("spread")
    return cells.select("kind", "metric", "counted", "mean", "samples", floor.alias("floor"), F.coalesce(F.col("mean") < floor - 1e-9, F.lit(False)).alias("regression"))


@query("evl05_regression", """WITH s AS (SELECT l_returnflag AS kind, u.metric, l_linestatus = 'F' AS counted, year(l_shipdate) < 1995 AS old, CASE u.metric WHEN 'price' THEN l_extendedprice / l_quantity / (CASE WHEN year(l_shipdate) >= 1995 AND l_returnflag = 'N' THEN 40 ELSE 1 END) ELSE l_quantity END AS x FROM lineitem, (VALUES ('price'), ('quantity')) AS u(metric)),
    b AS (SELECT kind, metric, avg(x) AS base, stddev_pop(x) AS spread FROM s WHERE old GROUP BY 1, 2) SELECT kind, metric, counted, round(avg(x), 6) AS mean, count(*) AS samples, round(max(base - 2 * spread), 6) AS floor, coalesce(avg(x) < max(base - 2 * spread) - 1e-9, false) AS regression FROM s LEFT JOIN b USING (kind, metric) WHERE NOT old GROUP BY 1, 2, 3""")
def regression(t: Tables) -> DataFrame:
    """The samples before 1995 are the baseline of those since; cells that don't count towards the gate stay apart."""
    old = F.year("l_shipdate") < 1995
    price = F.col("l_extendedprice") / F.col("l_quantity") / F.when(~old & (F.col("l_returnflag") == "N"), 40).otherwise(1)
    long = t.lineitem.select(F.col("l_returnflag").alias("kind"), (F.col("l_linestatus") == "F").alias("counted"), old.alias("old"), price.alias("price"), F.col("l_quantity").alias("quantity")).select("kind", "counted", "old", F.expr("stack(2, 'price', price, 'quantity', quantity) AS (metric, x)"))
    baseline = long.where("old").groupBy("kind", "metric").agg(F.avg("x").alias("base"), F.stddev_pop("x").alias("spread"))
    found = regressions(long.where("NOT old"), baseline)
    return found.withColumn("mean", F.round("mean", 6)).withColumn("floor", F.round("floor", 6))


@query("evl06_generated_cases", """SELECT 'evc:' || p_brand || ':card:' || p_partkey AS id, 'Wat is de energiekost van ' || p_name || '?' AS question, 'factoid' AS kind, 'shadow' AS status, CASE WHEN p_size % 2 = 0 THEN ['card:' || p_partkey, 'cost:' || p_size] ELSE ['card:' || p_partkey] END AS gold, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) THEN 'erratum:50' END AS superseded FROM part WHERE p_size > 25
    UNION ALL SELECT DISTINCT 'evc:all:concept:' || p_type, 'Hoe werkt ' || p_type || '?', 'inference', 'shadow', ['concept:' || p_type], NULL FROM part WHERE p_size > 25""")
def generated_cases(t: Tables) -> DataFrame:
    """Cases for what a new set brings, one question for a card and one for a concept; those that an erratum touches have expired."""
    new = t.part.where("p_size > 25")
    hit = t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("superseded", F.lit("erratum:50"))
    ref, cost = F.concat(F.lit("card:"), F.col("p_partkey").cast("string")), F.concat(F.lit("cost:"), F.col("p_size").cast("string"))
    cards = new.join(hit, "p_partkey", "left").select(F.concat(F.lit("evc:"), "p_brand", F.lit(":"), ref).alias("id"), F.concat(F.lit("Wat is de energiekost van "), "p_name", F.lit("?")).alias("question"), F.lit("factoid").alias("kind"), F.lit("shadow").alias("status"), F.when(F.col("p_size") % 2 == 0, F.array(ref, cost)).otherwise(F.array(ref)).alias("gold"), "superseded")
    concepts = new.select("p_type").distinct().select(F.concat(F.lit("evc:all:concept:"), "p_type").alias("id"), F.concat(F.lit("Hoe werkt "), "p_type", F.lit("?")).alias("question"), F.lit("inference").alias("kind"), F.lit("shadow").alias("status"), F.array(F.concat(F.lit("concept:"), "p_type")).alias("gold"), F.lit(None).cast("string").alias("superseded"))
    return cards.unionByName(concepts)
