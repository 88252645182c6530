"""Grouped measures: counts, popularity, co-occurrence, cost and trust roll-ups, votes, percentiles by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import _PARTS_SQL, printed_id, printed_ids
from .. import scratch
from ..registry import Tables, query
from .joins import _TARIFF, latest_before, tariff
from .ranges import ranked
from .windows import first_by


def ratio(a, b, empty: float = 0.0) -> Column:
    """a / b, or ``empty`` where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(empty)).otherwise(a / b)


def noisy_or(df: DataFrame, by: str, cluster: Column, strength: Column, name: str = "trust") -> DataFrame:
    """1 - prod(1 - strongest of each cluster): independent clusters support ``by`` together. Rows without a cluster stand alone."""
    strongest = df.groupBy(by, cluster.alias("_cluster")).agg(F.max(strength).alias("_s"))
    return strongest.groupBy(by).agg((1 - F.product(1 - F.col("_s"))).alias(name))


def whole_mean(value: Column) -> Column:
    """The mean of ``value`` (twelve decimal places count) with its fraction cut off. The sum is exact: of doubles it would depend on the order of rows, and a mean of 50 might become 49."""
    return F.call_function("div", F.sum(value.cast("decimal(38,12)")), F.count(value)).cast("int")


@query("agg01_group_count", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def group_count(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("agg02_sum_and_conditional", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1, 2")
def sum_and_conditional(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("agg03_usage_by_user", "SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS who, count(*) AS calls, count(*) FILTER (event_type = 'purchase') AS ok, CAST(trunc(avg(value)) AS INTEGER) AS avg_value FROM events GROUP BY 1")
def usage_by_user(t: Tables) -> DataFrame:
    """Counts and the whole part of the mean value of each user, one group for all without a user.

    The SQL adds doubles up as the file holds them, so a mean beside a whole number falls to either side by the rounding of its sum. Only for groups whose
    mean is that near (no order of n doubles moves their mean further than 2^-52 of the sum of their sizes), the rows are added up in that order.
    """
    who = F.when(F.col("user_id") % 10 != 0, F.col("user_id"))
    events = t.events.select(who.alias("who"), "event_type", "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    per = events.groupBy("who").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "purchase").alias("ok"), F.avg("value").alias("mean"), F.sum(F.abs("value")).alias("size"))
    per = scratch.materialize(per, "usage")
    near = per.where(F.abs(F.col("mean") - F.rint("mean")) <= F.col("size") * 2.0**-50).select(F.col("who").alias("near"))
    added = F.sum("value").over(Window.partitionBy("who").orderBy("file", "row"))
    rows = events.where("value IS NOT NULL").join(near, F.col("who").eqNullSafe(F.col("near")), "left_semi").select("who", "file", "row", added.alias("total"))
    exact = rows.groupBy(F.col("who").alias("near")).agg((F.max_by("total", F.struct("file", "row")) / F.count("*")).alias("in_order"))
    found = per.join(exact, F.col("who").eqNullSafe(F.col("near")), "left")
    return found.select("who", "calls", "ok", F.coalesce("in_order", "mean").cast("int").alias("avg_value"))


@query("agg04_latest", "SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def latest(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"))


@query("agg05_global_default", "SELECT count(*) AS n, coalesce(sum(value), 0) AS total FROM events WHERE event_type = 'nothing like it'")
def global_default(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'nothing like it'").agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


@query("agg06_filtered_window", "SELECT event_type, count(*) FILTER (ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS week FROM events GROUP BY 1")
def filtered_window(t: Tables) -> DataFrame:
    rows = t.events.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("as_of"))))
    return rows.groupBy("event_type").agg(F.count_if(F.expr("ts > as_of - INTERVAL 7 DAYS")).alias("week"))


@query("agg07_distinct_counts", r"SELECT (SELECT count(DISTINCT p_brand) FROM part) AS brands, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS pairs, (SELECT count(DISTINCT w) FROM (SELECT unnest(string_split_regex(lower(p_name), '\s+')) AS w FROM part)) AS words")
def distinct_counts(t: Tables) -> DataFrame:
    a = t.part.agg(F.countDistinct("p_brand").alias("brands"))
    b = t.lineitem.agg(F.countDistinct("l_partkey", "l_suppkey").alias("pairs"))
    c = t.part.select(F.explode(F.split(F.lower("p_name"), r"\s+")).alias("w")).agg(F.countDistinct("w").alias("words"))
    return a.crossJoin(b).crossJoin(c)


@query("agg08_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct(t: Tables) -> DataFrame:
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query("agg09_two_levels", "SELECT l_partkey, count(*) AS decks, avg(q) AS avg_copies FROM (SELECT l_partkey, l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def two_levels(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return per.groupBy("l_partkey").agg(F.count("*").alias("decks"), F.avg("q").alias("avg_copies"))


@query(
    "agg10_popularity",
    """WITH pool AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 500), n AS (SELECT count(*) AS n FROM pool),
    per AS (SELECT l_partkey, l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM pool) GROUP BY 1, 2)
    SELECT l_partkey, count(*) AS decks, round_even(100.0 * count(*) / max(n.n), 1) AS share, round_even(avg(q), 2) AS avg_copies, max(n.n) < 30 AS thin FROM per, n GROUP BY 1""",
)
def popularity(t: Tables) -> DataFrame:
    """Share of the newest 500 orders that hold an item, with the average number in those that do."""
    pool = t.orders.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(500).select(F.col("o_orderkey").alias("l_orderkey"))
    size = pool.agg(F.count("*").alias("n"))
    per = t.lineitem.join(F.broadcast(pool), "l_orderkey", "left_semi").groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("q"))
    counted = per.groupBy("l_partkey").agg(F.count("*").alias("decks"), F.avg("q").alias("a")).crossJoin(F.broadcast(size))
    return counted.select("l_partkey", "decks", F.bround(100.0 * F.col("decks") / F.col("n"), 1).alias("share"), F.bround("a", 2).alias("avg_copies"), (F.col("n") < 30).alias("thin"))


def co_occurrence(baskets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, co, support, lift) of ``pairs`` (a, b) over ``baskets`` (basket, item). Only the items that pairs name are joined."""
    b = baskets.select("basket", "item").distinct()
    total = b.select("basket").distinct().agg(F.count("*").alias("total"))
    counts = b.groupBy("item").agg(F.count("*").alias("n"))
    left = b.join(pairs, F.col("item") == F.col("a")).select("basket", "a", "b")
    co = left.join(b.withColumnRenamed("item", "b"), ["basket", "b"]).groupBy("a", "b").agg(F.count("*").alias("co"))
    full = pairs.join(co, ["a", "b"], "left").crossJoin(F.broadcast(total))
    for side in ("a", "b"):
        full = full.join(counts.select(F.col("item").alias(side), F.col("n").alias(f"n{side}")), side, "left")
    c = F.coalesce("co", F.lit(0))
    support = ratio(c, F.col("total"))
    lift = ratio(c * F.col("total").cast("double"), F.coalesce("na", F.lit(0)) * F.coalesce("nb", F.lit(0)))
    return full.select("a", "b", c.alias("co"), support.alias("support"), lift.alias("lift"))


@query(
    "agg11_co_occurrence",
    """WITH b AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem), p AS (SELECT DISTINCT l_partkey AS a, l_partkey + 1 AS b FROM lineitem), t AS (SELECT count(DISTINCT basket) AS total FROM b),
    n AS (SELECT item, count(*) AS n FROM b GROUP BY 1), c AS (SELECT p.a, p.b, count(*) AS co FROM p JOIN b x ON x.item = p.a JOIN b y ON y.item = p.b AND y.basket = x.basket GROUP BY 1, 2)
    SELECT p.a, p.b, coalesce(co, 0) AS co, coalesce(co, 0) / total AS support, CASE WHEN coalesce(na.n, 0) * coalesce(nb.n, 0) = 0 THEN 0 ELSE coalesce(co, 0) * total::DOUBLE / (na.n * nb.n) END AS lift
    FROM p CROSS JOIN t LEFT JOIN c USING (a, b) LEFT JOIN n na ON na.item = p.a LEFT JOIN n nb ON nb.item = p.b""",
)
def pair_lift(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_partkey").alias("a"), (F.col("l_partkey") + 1).alias("b")).distinct()
    return co_occurrence(t.lineitem.select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item")), pairs)


def all_co_occurrence(baskets: DataFrame, rows: int = 0) -> DataFrame:
    """(a, b, co, support, lift) of every two items a < b that ``baskets`` (basket, item), of about ``rows`` rows, have together; of all others co is 0."""
    b = scratch.spread(baskets.select("basket", "item"), rows, "basket").distinct()
    total = b.select("basket").distinct().agg(F.count("*").alias("total"))
    counts = b.groupBy("item").agg(F.count("*").alias("n"))
    pairs = b.withColumnRenamed("item", "a").join(b.withColumnRenamed("item", "b"), "basket").where("a < b").select("a", "b")
    full = scratch.spread(pairs, 3 * rows, "a", "b").groupBy("a", "b").agg(F.count("*").alias("co")).crossJoin(F.broadcast(total))
    for side in ("a", "b"):
        held = counts.select(F.col("item").alias(side), F.col("n").alias(f"n{side}"))
        full = scratch.spread(full, 3 * rows, side).join(scratch.spread(held, 3 * rows, side), side)
    lift = ratio(F.col("co") * F.col("total").cast("double"), F.col("na") * F.col("nb"))
    return full.select("a", "b", "co", ratio(F.col("co"), F.col("total")).alias("support"), lift.alias("lift"))


@query("agg11_co_occurrence_all")
def all_pair_lift(t: Tables) -> DataFrame:
    return all_co_occurrence(t.lineitem.select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item")), t.lineitem.count())


_COST = f"WITH {_TARIFF}, e AS (SELECT *, CAST(round(value, 0) AS BIGINT) AS units, (SELECT price FROM tariff p WHERE p.event_type = x.event_type AND effective_from <= x.ts ORDER BY effective_from DESC, id DESC LIMIT 1) AS price FROM events x)"


@query(
    "agg12_cost_rollup",
    _COST + """ SELECT CASE grouping(event_type) + 2 * grouping(user_id) WHEN 3 THEN 'total' WHEN 2 THEN 'type' ELSE 'user' END AS level, event_type, user_id, count(*) AS calls, sum(units) AS units, count(*) FILTER (price IS NULL) AS unpriced,
    CAST(coalesce(sum(units * price), 0) AS DOUBLE) / 1000 AS cost FROM e GROUP BY GROUPING SETS ((), (event_type), (user_id))""",
)
def cost_rollup(t: Tables) -> DataFrame:
    """Calls, units, unpriced calls and cost in total, by type and by user from one pass over the priced events."""
    units = F.round("value", 0).cast("long")
    priced = latest_before(t.events.select("event_type", "event_id", "ts", "user_id", units.alias("units")), tariff(t), "event_type", "ts", "effective_from", "id", ["price"])
    priced.createOrReplaceTempView("priced_events")
    return t.spark.sql(
        """SELECT CASE grouping_id(event_type, user_id) WHEN 3 THEN 'total' WHEN 1 THEN 'type' ELSE 'user' END AS level, event_type, user_id, count(*) AS calls, sum(units) AS units,
        count_if(price IS NULL) AS unpriced, CAST(coalesce(sum(units * price), 0) AS DOUBLE) / 1000 AS cost FROM priced_events GROUP BY GROUPING SETS ((), (event_type), (user_id))"""
    )


@query("agg13_several_windows", "WITH e AS (SELECT *, (SELECT max(ts) FROM events) AS m FROM events) SELECT event_type, count(*) FILTER (ts >= date_trunc('day', m)) AS today, count(*) FILTER (ts > m - INTERVAL 7 DAY) AS d7, count(*) FILTER (ts > m - INTERVAL 30 DAY) AS d30 FROM e GROUP BY 1")
def several_windows(t: Tables) -> DataFrame:
    rows = t.events.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("m"))))
    return rows.groupBy("event_type").agg(F.expr("count_if(ts >= date_trunc('day', m))").alias("today"), F.expr("count_if(ts > m - INTERVAL 7 DAYS)").alias("d7"), F.expr("count_if(ts > m - INTERVAL 30 DAYS)").alias("d30"))


@query("agg14_precision_rollup", "SELECT user_id % 7 AS source, count(*) AS candidates, count(*) FILTER (event_type = 'purchase') AS verified, count(*) FILTER (event_type = 'click') AS rejected, CASE WHEN count(*) FILTER (event_type IN ('purchase', 'click')) = 0 THEN 0 ELSE count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type IN ('purchase', 'click')) END AS precision FROM events GROUP BY 1")
def precision_rollup(t: Tables) -> DataFrame:
    per = t.events.groupBy((F.col("user_id") % 7).alias("source")).agg(F.count("*").alias("candidates"), F.count_if(F.col("event_type") == "purchase").alias("verified"), F.count_if(F.col("event_type") == "click").alias("rejected"))
    return per.select("*", ratio(F.col("verified"), F.col("verified") + F.col("rejected")).alias("precision"))


@query("agg15_audit", "SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS sound, count(*) FILTER (toxic = 1) AS incorrect, count(*) FILTER (quality = 0 AND toxic = 0) AS unsupported, count(*) FILTER (quality = 1 AND toxic = 0) / count(*) AS precision FROM labels")
def audit(t: Tables) -> DataFrame:
    sound = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0))
    return t.labels.agg(F.count("*").alias("n"), sound.alias("sound"), F.count_if(F.col("toxic") == 1).alias("incorrect"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("unsupported"), ratio(sound, F.count("*")).alias("precision"))


@query("agg16_mean_costs", "SELECT event_type, avg(value) AS mean_value, sum(value) AS total_value, avg(length(props)) AS mean_props FROM events GROUP BY 1")
def mean_costs(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.avg("value").alias("mean_value"), F.sum("value").alias("total_value"), F.avg(F.length("props")).alias("mean_props"))


@query(
    "agg17_majority_and_gaps",
    """WITH v AS (SELECT p_brand, p_size AS total, count(*) AS votes FROM part GROUP BY 1, 2), w AS (SELECT p_brand, total FROM v QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY votes DESC, total DESC) = 1),
    have AS (SELECT DISTINCT p_brand, p_size FROM part) SELECT w.p_brand, total, (SELECT count(*) FROM range(1, total + 1) r(n) WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.p_brand = w.p_brand AND h.p_size = r.n)) AS missing FROM w""",
)
def majority_and_gaps(t: Tables) -> DataFrame:
    """The size most rows of a brand vote for (ties: the larger), and how many numbers up to it no row has."""
    votes = t.part.groupBy("p_brand", F.col("p_size").alias("total")).agg(F.count("*").alias("votes"))
    winner = votes.groupBy("p_brand").agg(F.max(F.struct("votes", "total")).alias("w")).select("p_brand", F.col("w.total").alias("total"))
    have = t.part.select("p_brand", F.col("p_size").alias("n")).distinct()
    gaps = winner.where("total >= 1").select("p_brand", F.explode(F.sequence(F.lit(1), "total")).alias("n")).join(have, ["p_brand", "n"], "left_anti").groupBy("p_brand").agg(F.count("*").alias("missing"))
    return winner.join(gaps, "p_brand", "left").select("p_brand", "total", F.coalesce("missing", F.lit(0)).alias("missing"))


@query("agg18_facets", r"SELECT 'brand' AS facet, p_brand AS value FROM part UNION SELECT 'size', CAST(p_size AS VARCHAR) FROM part UNION SELECT 'word', unnest(string_split_regex(lower(p_name), '\s+')) FROM part")
def facets(t: Tables) -> DataFrame:
    """Distinct values of each attribute from one scan: a row gives all its facet values at once."""
    pairs = F.concat(F.array(F.struct(F.lit("brand").alias("facet"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("facet"), F.col("p_size").cast("string").alias("value"))), F.transform(F.split(F.lower("p_name"), r"\s+"), lambda w: F.struct(F.lit("word").alias("facet"), w.alias("value"))))
    return t.part.select(F.inline(pairs)).distinct()


@query("agg19_first_label", "SELECT o_custkey, min_by(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS label FROM orders GROUP BY 1")
def first_label(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("label"))


@query("agg21_noisy_or", "SELECT l_partkey, 1 - product(1 - s) AS trust FROM (SELECT l_partkey, l_suppkey, max(l_discount) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def noisy_or_trust(t: Tables) -> DataFrame:
    return noisy_or(t.lineitem, "l_partkey", F.col("l_suppkey"), F.col("l_discount"))


@query("agg22_claim_trust", "SELECT l_partkey, round_even(1 - product(1 - w), 2) AS trust FROM (SELECT l_partkey, lower(l_returnflag) AS f, max(CASE l_returnflag WHEN 'A' THEN 0.6 WHEN 'R' THEN 0.3 ELSE 0.1 END) AS w FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def claim_trust(t: Tables) -> DataFrame:
    weight = F.when(F.col("l_returnflag") == "A", 0.6).when(F.col("l_returnflag") == "R", 0.3).otherwise(0.1)
    return noisy_or(t.lineitem, "l_partkey", F.lower("l_returnflag"), weight, "t").select("l_partkey", F.bround("t", 2).alias("trust"))


@query("agg23_independent_sources", "SELECT l_orderkey, count(DISTINCT coalesce(nullif(CAST(l_suppkey AS VARCHAR), '1'), 'own:' || l_linenumber)) AS sources FROM lineitem GROUP BY 1")
def independent_sources(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.countDistinct(F.coalesce(F.nullif(F.col("l_suppkey").cast("string"), F.lit("1")), F.concat(F.lit("own:"), "l_linenumber"))).alias("sources"))


@query("agg24_baseline", "SELECT l_returnflag, 'quantity' AS metric, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sigma FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'price', avg(l_extendedprice), stddev_pop(l_extendedprice) FROM lineitem GROUP BY 1")
def baseline(t: Tables) -> DataFrame:
    long = t.lineitem.select("l_returnflag", F.expr("stack(2, 'quantity', l_quantity, 'price', l_extendedprice) AS (metric, x)"))
    return long.groupBy("l_returnflag", "metric").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sigma"))


@query("agg25_regression_gate", "WITH b AS (SELECT l_returnflag, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE year(l_shipdate) < 1996 GROUP BY 1), c AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem WHERE year(l_shipdate) >= 1996 GROUP BY 1) SELECT l_returnflag, c.m < b.m - 2 * b.s - 1e-9 AS regressed FROM c JOIN b USING (l_returnflag)")
def regression_gate(t: Tables) -> DataFrame:
    old = F.year("l_shipdate") < 1996
    per = t.lineitem.groupBy("l_returnflag").agg(*(f(F.when(c, F.col("l_quantity"))).alias(n) for n, f, c in (("m", F.avg, old), ("s", F.stddev_pop, old), ("now", F.avg, ~old))))
    return per.where("m IS NOT NULL AND now IS NOT NULL").select("l_returnflag", (F.col("now") < F.col("m") - 2 * F.col("s") - 1e-9).alias("regressed"))


@query("agg26_index_percentiles", "WITH l AS (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100), s AS (SELECT list_sort(list(value)) AS v FROM l) SELECT v[CAST(floor(len(v) / 2.0) AS INTEGER) + 1] AS median, v[CAST(floor(len(v) * 0.9) AS INTEGER) + 1] AS p90, CAST(len(v) AS BIGINT) AS n FROM s")
def index_percentiles(t: Tables) -> DataFrame:
    """Percentiles of the last 100 rows by index: sorted[floor(n q)], without interpolation."""
    last = t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).agg(F.array_sort(F.collect_list("value")).alias("v"))
    at = lambda q: F.get("v", F.floor(F.size("v") * q).cast("int"))
    return last.select(at(0.5).alias("median"), at(0.9).alias("p90"), F.size("v").cast("long").alias("n"))


@query("agg27_drift", r"SELECT p_brand, count(*) AS n, count(*) FILTER (len(string_split_regex(p_name, '\s+')) <= 2) AS bare FROM part GROUP BY 1")
def drift(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.size(F.split("p_name", r"\s+")) <= 2).alias("bare"))


@query("agg28_reconcile", "WITH a AS (SELECT o_orderkey AS id, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS id, count(*) AS m FROM lineitem WHERE l_quantity > 25 GROUP BY 1) SELECT coalesce(a.id, b.id) AS id, coalesce(n, 0) AS in_orders, coalesce(m, 0) AS in_lines FROM a FULL JOIN b ON a.id = b.id")
def reconcile(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_orderkey").alias("id")).agg(F.count("*").alias("n"))
    b = t.lineitem.where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("m"))
    return a.join(b, "id", "full").select("id", F.coalesce("n", F.lit(0)).alias("in_orders"), F.coalesce("m", F.lit(0)).alias("in_lines"))


@query("agg30_sweep", "SELECT quality, avg(n_chars) AS mean_chars, count(*) AS n, list_sort(list(DISTINCT lang)) AS langs, count(DISTINCT lang) = 1 AS consistent FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def sweep(t: Tables) -> DataFrame:
    return t.labels.join(t.documents, "doc_id").groupBy("quality").agg(F.avg("n_chars").alias("mean_chars"), F.count("*").alias("n"), F.array_sort(F.collect_set("lang")).alias("langs"), (F.countDistinct("lang") == 1).alias("consistent"))


@query("agg31_last_run", "SELECT event_type, max(ts) AS last, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def last_run(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.max("ts").alias("last"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("agg32_term_matches", r"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) SELECT doc_id, n, row_number() OVER (ORDER BY n DESC, doc_id) AS place FROM (SELECT doc_id, count(*) AS n FROM w JOIN t USING (term) GROUP BY doc_id)")
def term_matches(t: Tables) -> DataFrame:
    """How many of the terms that the benchmark names each text has, most first; the terms are joined, not tried one by one."""
    words = lambda df, pattern: F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern))))
    terms = t.benchmark.select(words(t.benchmark, "([a-z]{6,})").alias("term")).distinct()
    counted = t.documents.select("doc_id", words(t.documents, "([a-z]+)").alias("term")).join(terms, "term", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
    return ranked(counted, "place", F.desc("n"), F.asc("doc_id"))


@query("agg33_aliases", "SELECT lower(p_brand) AS brand, list_sort(list(DISTINCT lower(p_type))) AS aliases FROM part GROUP BY 1")
def aliases(t: Tables) -> DataFrame:
    return t.part.groupBy(F.lower("p_brand").alias("brand")).agg(F.array_sort(F.collect_set(F.lower("p_type"))).alias("aliases"))


@query(
    "agg34_stability",
    """WITH p AS (SELECT vec_id, label AS a, (label + vec_id % 2) % 5 AS b FROM embeddings), na AS (SELECT a, count(*) AS n FROM p GROUP BY 1), nb AS (SELECT b, count(*) AS n FROM p GROUP BY 1),
    j AS (SELECT a, max(co / (na.n + nb.n - co)) AS best, any_value(na.n) AS n FROM (SELECT a, b, count(*) AS co FROM p GROUP BY 1, 2) JOIN na USING (a) JOIN nb USING (b) GROUP BY a) SELECT sum(best * n) / sum(n) AS stability FROM j""",
)
def stability(t: Tables) -> DataFrame:
    """Size-weighted best Jaccard similarity of the communities of two partitions."""
    p = t.embeddings.select(F.col("label").alias("a"), ((F.col("label") + F.col("vec_id") % 2) % 5).alias("b"))
    sizes = {c: p.groupBy(c).agg(F.count("*").alias(f"n{c}")) for c in "ab"}
    pairs = p.groupBy("a", "b").agg(F.count("*").alias("co")).join(sizes["a"], "a").join(sizes["b"], "b")
    best = pairs.groupBy("a").agg(F.max(F.col("co") / (F.col("na") + F.col("nb") - F.col("co"))).alias("best"), F.first("na").alias("n"))
    return best.agg((F.sum(F.col("best") * F.col("n")) / F.sum("n")).alias("stability"))


@query("agg35_yield", "SELECT count(*) * (count(*) - 1) // 2 AS all_pairs, (SELECT count(*) FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey) AS blocked FROM part")
def hypothesis_yield(t: Tables) -> DataFrame:
    n = F.col("n")
    per = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return per.agg(F.expr("sum(n) * (sum(n) - 1) div 2").alias("all_pairs"), F.sum((n * (n - 1) / 2).cast("long")).alias("blocked"))


@query("agg36_string_list", "SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS flags FROM lineitem GROUP BY 1")
def string_list(t: Tables) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(held, lambda s: s["l_returnflag"]), ",").alias("flags"))


@query("agg37_dossier", "SELECT l_suppkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts, list(l_orderkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber)[1:5] AS newest FROM lineitem GROUP BY 1")
def dossier(t: Tables) -> DataFrame:
    """Counts and the newest five of each source; the five are taken by a window, so no source is gathered whole."""
    by = Window.partitionBy("l_suppkey").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), "l_linenumber")
    top = t.lineitem.withColumn("r", F.row_number().over(by)).where("r <= 5").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("r", "l_orderkey"))).alias("x"))
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"))
    return counts.join(top, "l_suppkey").select("l_suppkey", "n_lines", "n_parts", F.col("x.l_orderkey").alias("newest"))


_USAGE = _COST.replace("e AS (SELECT *,", "e AS (SELECT x.*, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS kind,")


@query("agg12_usage", _USAGE + """, g AS (SELECT CASE grouping(event_type, kind, user_id) WHEN 7 THEN 'total' WHEN 3 THEN 'model' WHEN 1 THEN 'kind' ELSE 'user' END AS level, event_type, kind, user_id, count(*) AS calls, sum(units) AS units, count(*) FILTER (price IS NULL) AS unpriced, CAST(coalesce(sum(units * price), 0) * 100 AS BIGINT) AS c FROM e GROUP BY GROUPING SETS ((), (event_type), (event_type, kind), (user_id))),
    f AS (SELECT * EXCLUDE (c), (c // 10 + CASE WHEN c % 10 > 5 OR (c % 10 = 5 AND (c // 10) % 2 = 1) THEN 1 ELSE 0 END) / 10000 AS usd FROM g)
    SELECT * FROM f WHERE level <> 'user' UNION ALL (SELECT * FROM f WHERE level = 'user' ORDER BY usd DESC, user_id LIMIT 15)""")
def usage(t: Tables) -> DataFrame:
    """Calls, units, unpriced calls and cost (four places, half to even) in total, by model, by model and kind, and of the 15 dearest users."""
    units, kind = F.round("value", 0).cast("long"), F.get_json_object("props", "$.k").cast("int") % 3
    priced = latest_before(t.events.select("event_type", "event_id", "ts", "user_id", kind.alias("kind"), units.alias("units")), tariff(t), "event_type", "ts", "effective_from", "id", ["price"])
    sets = priced.groupingSets([[], [F.col("event_type")], [F.col("event_type"), F.col("kind")], [F.col("user_id")]], F.col("event_type"), F.col("kind"), F.col("user_id"))
    level = F.grouping_id("event_type", "kind", "user_id")
    g = sets.agg(F.when(level == 7, "total").when(level == 3, "model").when(level == 1, "kind").otherwise("user").alias("level"), F.count("*").alias("calls"), F.sum("units").alias("units"), F.count_if(F.col("price").isNull()).alias("unpriced"), F.bround(F.coalesce(F.sum(F.col("units") * F.col("price")), F.lit(0)) * F.lit("0.001").cast("decimal(4,3)"), 4).cast("double").alias("usd"))
    top = g.where("level = 'user'").orderBy(F.desc("usd"), "user_id").limit(15)
    return g.where("level <> 'user'").unionByName(top).select("level", "event_type", "kind", "user_id", "calls", "units", "unpriced", "usd")


@query("agg10_co_played", """WITH pool AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 500), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM pool))
    SELECT x.l_partkey, y.l_partkey AS other, count(*) AS decks FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.l_partkey <> y.l_partkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY x.l_partkey ORDER BY count(*) DESC, y.l_partkey) <= 5""")
def co_played(t: Tables) -> DataFrame:
    """The five items that the newest 500 orders hold most often together with each item."""
    pool = t.orders.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(500).select(F.col("o_orderkey").alias("l_orderkey"))
    b = t.lineitem.join(F.broadcast(pool), "l_orderkey", "left_semi").select("l_orderkey", "l_partkey").distinct()
    pairs = b.join(b.withColumnRenamed("l_partkey", "other"), "l_orderkey").where("l_partkey <> other").groupBy("l_partkey", "other").agg(F.count("*").alias("decks"))
    return first_by(pairs, ["l_partkey"], F.desc("decks"), "other", n=5)


@query("agg14_accept_rates", "SELECT user_id, count(*) AS candidates, round(CASE WHEN count(*) FILTER (event_type IN ('purchase', 'click')) = 0 THEN 0 ELSE count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type IN ('purchase', 'click')) END, 9) AS precision, round(count(*) FILTER (event_type = 'purchase') / count(*), 9) AS accepted FROM events GROUP BY 1")
def accept_rates(t: Tables) -> DataFrame:
    """Precision among what was judged, and the share of all candidates that were accepted."""
    verified, rejected = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "click")
    return t.events.groupBy("user_id").agg(F.count("*").alias("candidates"), F.round(ratio(verified, verified + rejected), 9).alias("precision"), F.round(ratio(verified, F.count("*")), 9).alias("accepted"))


@query("agg26_phases", "WITH l AS (SELECT event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) SELECT event_type, count(*) AS n, CAST(trunc(avg(value)) AS INTEGER) AS mean FROM l GROUP BY 1")
def phase_means(t: Tables) -> DataFrame:
    """The mean of each phase over the last fifty rows, its fraction cut off."""
    last = t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return last.groupBy("event_type").agg(F.count("*").alias("n"), whole_mean(F.col("value")).alias("mean"))


@query("agg17_coverage", f"""WITH {_PARTS_SQL}, v AS (SELECT set_code, total, count(*) AS n FROM ids WHERE NOT special AND total IS NOT NULL GROUP BY 1, 2), w AS (SELECT set_code, total AS base FROM v QUALIFY row_number() OVER (PARTITION BY set_code ORDER BY n DESC, total DESC) = 1),
    j AS (SELECT ids.*, base FROM ids LEFT JOIN w USING (set_code)) SELECT set_code, base, count(DISTINCT number) FILTER (NOT special AND suffix = '' AND total = base AND number BETWEEN 1 AND base) AS present, coalesce(base, 0) - count(DISTINCT number) FILTER (NOT special AND suffix = '' AND total = base AND number BETWEEN 1 AND base) AS missing,
      count(*) FILTER (special OR suffix <> '' OR (total IS NOT NULL AND total IS DISTINCT FROM base) OR coalesce(number > base, false)) AS variants, count(*) FILTER (total IS NOT NULL AND total IS DISTINCT FROM base) AS deviations FROM j GROUP BY 1, 2""")
def coverage(t: Tables) -> DataFrame:
    """Sets by the total most of their ids vote for (ties: the larger): numbers present and missing, variants, ids with another total."""
    ids = printed_ids(t).select(printed_id(F.col("code")).alias("p")).where("p IS NOT NULL").select(F.col("p.set").alias("set_code"), "p.number", "p.suffix", "p.total", "p.special")
    votes = ids.where("NOT special AND total IS NOT NULL").groupBy("set_code", "total").agg(F.count("*").alias("n"))
    base = votes.groupBy("set_code").agg(F.max(F.struct("n", "total")).alias("w")).select("set_code", F.col("w.total").alias("base"))
    plain = F.expr("NOT special AND suffix = '' AND total = base AND number BETWEEN 1 AND base")
    other = F.expr("total IS NOT NULL AND NOT (total <=> base)")
    rows = ids.join(base, "set_code", "left").groupBy("set_code", "base")
    found = rows.agg(F.countDistinct(F.when(plain, F.col("number"))).alias("present"), F.count_if(F.expr("special OR suffix <> '' OR coalesce(number > base, false)") | other).alias("variants"), F.count_if(other).alias("deviations"))
    return found.select("set_code", "base", "present", (F.coalesce("base", F.lit(0)) - F.col("present")).alias("missing"), "variants", "deviations")


@query("agg35_lift", """WITH h AS (SELECT DISTINCT least(a.p_partkey, b.p_partkey) AS a, greatest(a.p_partkey, b.p_partkey) AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey), g AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey),
    n AS (SELECT count(*) AS n FROM part), c AS (SELECT (SELECT n * (n - 1) // 2 FROM n) AS blind, (SELECT count(*) FROM h) AS hypotheses, (SELECT count(*) FROM h JOIN g USING (a, b)) AS hits, (SELECT count(*) FROM g) AS gold)
    SELECT blind, hypotheses, round(blind / greatest(1, hypotheses), 6) AS reduction, hits, round(CASE WHEN hypotheses = 0 THEN 0 ELSE hits / hypotheses END, 9) AS precision, round(CASE WHEN blind = 0 THEN 0 ELSE gold / blind END, 9) AS base_rate, round(CASE WHEN gold > 0 AND hypotheses > 0 THEN (hits / hypotheses) / (gold / blind) END, 6) AS lift FROM c""")
def hypothesis_lift(t: Tables) -> DataFrame:
    """How far hypotheses (items alike in name and type) cut down all pairs, and how much oftener than any pair they hold (items ordered together)."""
    p = t.part.where("p_partkey IS NOT NULL AND p_name IS NOT NULL AND p_type IS NOT NULL").select(F.col("p_partkey").alias("l_partkey"), F.struct("p_name", "p_type").alias("kind")).distinct()
    # Hypotheses are counted by the sizes of their groups, hits among the pairs of orders: no pair of a group is listed.
    sizes = p.groupBy("kind").agg(F.expr("count(*) * (count(*) - 1) div 2").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hypotheses"))
    b = t.lineitem.select("l_orderkey", "l_partkey").distinct().join(p, "l_partkey", "left")
    both = b.select("l_orderkey", F.col("l_partkey").alias("a"), F.col("kind").alias("x")).join(b.select("l_orderkey", F.col("l_partkey").alias("b"), F.col("kind").alias("y")), "l_orderkey").where("a < b")
    gold = both.groupBy("a", "b").agg(F.max(F.coalesce(F.col("x") == F.col("y"), F.lit(False))).alias("hit"))
    c = gold.agg(F.count_if("hit").alias("hits"), F.count("*").alias("gold")).crossJoin(sizes).crossJoin(t.part.agg(F.expr("count(*) * (count(*) - 1) div 2").alias("blind")))
    precision, rate = ratio(F.col("hits"), F.col("hypotheses")), ratio(F.col("gold"), F.col("blind"))
    return c.select("blind", "hypotheses", F.round(F.col("blind") / F.greatest(F.lit(1), F.col("hypotheses")), 6).alias("reduction"), "hits", F.round(precision, 9).alias("precision"), F.round(rate, 9).alias("base_rate"), F.round(F.when((rate > 0) & (F.col("hypotheses") > 0), precision / rate), 6).alias("lift"))
