"""Merges of news into a table: one full outer join whose rows carry what happens to them, written with a log of decisions.

Every merge gives a plan: the rows of old and new by key, ``action`` (insert, update, keep, delete, orphan, held, blocked) and the
values after it. ``carry_out`` writes the rows that stay and appends the decisions to a log. Null keys meet null keys; a key
that repeats is refused when the job runs, unless an order says which of its rows counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..registry import Tables, query

#: Actions whose rows leave the table, and those that a log of decisions tells of.
LEAVING, TOLD = ("delete", "orphan", "none"), ("held", "blocked", "delete", "orphan")


def once(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``df`` with one row for each key: a repeated key is an error of the job, or with ``order`` its least row stays."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(F.lit(True).alias("_there"), *others)
    if order:
        grouped = df.groupBy(*keys).agg(F.min(F.struct(F.struct(*order).alias("o"), row.alias("r")))["r"].alias("_row"))
    else:
        grouped = df.groupBy(*keys).agg(F.first(row).alias("_r"), F.count("*").alias("_n"))
        grouped = grouped.withColumn("_row", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.to_json(F.struct(*keys))))).otherwise(F.col("_r")))
    return grouped.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in others)) if others else grouped.where("_row._there").select(*keys)


def matched(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old struct, new struct): both sides by key, null where a side has no row. Both must have a key once."""
    sides = [df.select(*(F.col(k).alias(f"_{s}{j}") for j, k in enumerate(keys)), F.struct(F.lit(True).alias("_there"), *(c for c in df.columns if c not in keys)).alias(s)) for s, df in (("old", old), ("new", new))]
    on = reduce(lambda a, b: a & b, [F.col(f"_old{j}").eqNullSafe(F.col(f"_new{j}")) for j in range(len(keys))])
    return sides[0].join(sides[1], on, "full").select(*(F.when(F.col("old").isNull(), F.col(f"_new{j}")).otherwise(F.col(f"_old{j}")).alias(k) for j, k in enumerate(keys)), "old", "new")


def _planned(rows: DataFrame, keys: list[str], action: Column, values: dict[str, Column], *more: str) -> DataFrame:
    return rows.select(*keys, *(c.alias(v) for v, c in values.items()), action.alias("action"), *more)


def _columns(old: DataFrame, new: DataFrame, keys: list[str]) -> dict[str, tuple[Column, Column]]:
    """Each value column of both sides, null on the side that lacks it."""
    kinds = {f.name: f.dataType for df in (new, old) for f in df.schema}
    names = [c for c in [*old.columns, *(c for c in new.columns if c not in old.columns)] if c not in keys]
    side = lambda df, s, v: F.col(f"{s}.{v}") if v in df.columns else F.lit(None).cast(kinds[v])
    return {v: (side(old, "old", v), side(new, "new", v)) for v in names}


def column_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, or merge column by column: a new value wins where it isn't null. All columns of both sides stay."""
    pairs = _columns(old, new, keys)
    changed = reduce(lambda a, b: a | b, [n.isNotNull() & ~n.eqNullSafe(o) for o, n in pairs.values()], F.lit(False))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNotNull() & changed, "update").otherwise("keep")
    return _planned(matched(once(old, keys), once(new, keys), keys), keys, action, {v: F.coalesce(n, o) for v, (o, n) in pairs.items()})


def reconcile(old: DataFrame, new: DataFrame, source: str, keys: list[str], mutable: list[str], active: DataFrame) -> DataFrame:
    """The rows of each extracted source become those of the news: known ones keep what was first noted and take over ``mutable``
    columns, new ones are inserted, those that are gone are deleted. A source of ``active`` that gave nothing this time keeps its
    rows; rows of other sources are orphans. Of a key that repeats in the news the row of the least ``mutable`` columns counts.
    """
    by = [source, *keys]
    fresh = once(new, by, mutable)
    given = lambda df, name: df.select(F.col(source).alias(f"_{name}")).where(f"_{name} IS NOT NULL").distinct().withColumn(f"is_{name}", F.lit(True))
    rows = matched(once(old, by), fresh, by)
    for name, df in (("active", active), ("given", new)):
        told = scratch.maybe_broadcast(scratch.materialize(given(df, name), name))
        rows = rows.join(told, F.col(source) == F.col(f"_{name}"), "left").drop(f"_{name}")
    pairs = _columns(old, fresh, by)
    changed = reduce(lambda a, b: a | b, [~pairs[v][0].eqNullSafe(pairs[v][1]) for v in mutable], F.lit(False))
    action = F.when(F.col("is_active").isNull(), "orphan").when(F.col("old").isNull(), "insert").when(F.col("new").isNotNull(), F.when(changed, "update").otherwise("keep")).when(F.col("is_given"), "delete").otherwise("keep")
    values = {v: F.when(F.col("old").isNull() | (F.col("new").isNotNull() & F.lit(v in mutable)), n).otherwise(o) for v, (o, n) in pairs.items()}
    return _planned(rows, by, action, values)


def monotone(old: DataFrame, new: DataFrame, pair: list[str], kind: str, status: str, strength: dict[str, int], tombstones: DataFrame, open_statuses: list[str]) -> DataFrame:
    """Proposals by pair and kind: a live tombstone (pair, kind) blocks one, a stronger standing status holds (the proposal is only
    told of), else the proposal inserts its row or sets its status. ``switched_from`` is another kind of the same pair that stands
    with one of ``open_statuses``, else one that has a tombstone; the least such kind."""
    keys = [*pair, kind]
    rank = lambda c: reduce(lambda e, s: e.when(c == s[0], s[1]), [*strength.items()][1:], F.when(c == [*strength][0], [*strength.values()][0]))
    dead = tombstones.select(*keys).distinct()
    rows = matched(once(old, keys), once(new, keys), keys)
    blocked = dead.select(*(F.col(k).alias(f"_d{j}") for j, k in enumerate(keys)), F.lit(True).alias("dead"))
    rows = rows.join(blocked, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_d{j}")) for j, k in enumerate(keys)]), "left").drop(*(f"_d{j}" for j in range(len(keys))))
    others = [old.where(F.col(status).isin(open_statuses)).select(*keys), dead]
    for name, other in zip(("standing", "buried"), others):
        proposed = new.select(*(F.col(k).alias(f"_p{j}") for j, k in enumerate(keys)))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_p{j}")) for j, k in enumerate(pair)])
        found = other.join(proposed, same & (F.col(kind) != F.col(f"_p{len(pair)}"))).groupBy(*(f"_p{j}" for j in range(len(keys)))).agg(F.min(kind).alias(name))
        rows = rows.join(found, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_p{j}")) for j, k in enumerate(keys)]), "left").drop(*(f"_p{j}" for j in range(len(keys))))
    pairs = _columns(old, new, keys)
    was, now = F.col(f"old.{status}"), F.col(f"new.{status}")
    action = (
        F.when(F.col("new").isNull(), "keep")
        .when(F.col("dead"), F.when(F.col("old").isNull(), "none").otherwise("blocked"))
        .when(F.col("old").isNull(), "insert")
        .when(rank(now) < rank(was), "held")
        .when(now.eqNullSafe(was), "keep")
        .otherwise("update")
    )
    takes = action.isin("insert", "update")
    values = {v: F.when(takes, F.coalesce(n, o)).otherwise(o) for v, (o, n) in pairs.items()}
    rows = rows.withColumn("switched_from", F.when(F.col("new").isNotNull(), F.coalesce("standing", "buried"))).withColumn("proposed", now)
    return _planned(rows, keys, action, values, "switched_from", "proposed")


def carry_out(plan: DataFrame, table, log=None, run: str = "") -> DataFrame:
    """The plan, written once: rows that stay become the table; decisions go to the log, and proposals that were blocked too."""
    plan = scratch.materialize(plan, "merge")
    extra = ["action", "switched_from", "proposed"]
    table.replace(plan.where(~F.col("action").isin(*LEAVING)).drop(*extra))
    if log is not None:
        log.append(plan.where(F.col("action").isin(*TOLD, "none")).withColumn("run", F.lit(run)))
    return plan


# ---- the merges on given tables, written and read back ----


def _tables(t: Tables, *names: str):
    from .sinks import new_table

    return [new_table(t, n) for n in names]


_MERGED_OLD = "SELECT p_partkey AS k, p_size AS size, p_brand AS brand, p_type AS kind FROM part WHERE p_retailprice < 1500"
_MERGED_NEW = "SELECT l_partkey AS k, CAST(max(l_linenumber) AS INT) AS size, CASE WHEN max(l_returnflag) = 'R' THEN 'Returned' END AS brand, max(l_shipdate) AS seen FROM lineitem WHERE l_quantity > 40 GROUP BY l_partkey"


@query(
    "snk01_merge_actions",
    f"""WITH o AS ({_MERGED_OLD}), n AS ({_MERGED_NEW})
    SELECT coalesce(o.k, n.k) AS k, coalesce(n.size, o.size) AS size, coalesce(n.brand, o.brand) AS brand, o.kind, n.seen,
      CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NOT NULL AND (n.size IS DISTINCT FROM o.size OR n.seen IS NOT NULL OR (n.brand IS NOT NULL AND n.brand IS DISTINCT FROM o.brand)) THEN 'update' ELSE 'keep' END AS action
    FROM o FULL JOIN n ON o.k = n.k""",
)
def merge_actions(t: Tables) -> DataFrame:
    """Catalogue rows merged with what the latest rows of lines say of them: columns that only one side has stay."""
    old = t.part.where("p_retailprice < 1500").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    lines = t.lineitem.where("l_quantity > 40").groupBy(F.col("l_partkey").alias("k"))
    new = lines.agg(F.max("l_linenumber").cast("int").alias("size"), F.when(F.max("l_returnflag") == "R", "Returned").alias("brand"), F.max("l_shipdate").alias("seen"))
    (table,) = _tables(t, "merged")
    table.replace(old)
    plan = carry_out(column_merge(table.read(), new, ["k"]), table)
    return table.read().join(plan.select("k", "action"), "k")


_RECONCILED = """WITH c AS (SELECT min(ts) + INTERVAL 15 DAY AS half FROM events),
o AS (SELECT event_type, user_id, max(value) AS top, min(ts) AS detected FROM events, c WHERE ts < half GROUP BY ALL),
n AS (SELECT event_type, user_id, max(value) AS top, min(ts) AS detected FROM events, c WHERE ts >= half AND event_type NOT IN ('view', 'error') AND value > 50 GROUP BY ALL),
p AS (SELECT coalesce(o.event_type, n.event_type) AS event_type, coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN n.user_id IS NOT NULL THEN n.top ELSE o.top END AS top, coalesce(o.detected, n.detected) AS detected,
  CASE WHEN coalesce(o.event_type, n.event_type) = 'error' THEN 'orphan' WHEN o.user_id IS NULL THEN 'insert' WHEN n.user_id IS NOT NULL THEN CASE WHEN o.top <> n.top THEN 'update' ELSE 'keep' END
    WHEN o.event_type IN (SELECT event_type FROM n) THEN 'delete' ELSE 'keep' END AS action
  FROM o FULL JOIN n ON o.event_type = n.event_type AND o.user_id = n.user_id)"""


def _reconciled(t: Tables):
    cut = t.events.agg((F.min("ts") + F.expr("INTERVAL 15 DAYS")).alias("half"))
    events = t.events.crossJoin(F.broadcast(cut))  # one row
    seen = lambda rows: rows.groupBy("event_type", "user_id").agg(F.max("value").alias("top"), F.min("ts").alias("detected"))
    new = seen(events.where("ts >= half AND event_type NOT IN ('view', 'error') AND value > 50"))
    table, log = _tables(t, "reconciled", "decisions")
    table.replace(seen(events.where("ts < half")))
    active = t.events.where("event_type <> 'error'").select("event_type").distinct()
    carry_out(reconcile(table.read(), new, "event_type", ["user_id"], ["top"], active), table, log, "second half")
    return table, log


@query("snk06_reconciled", f"{_RECONCILED} SELECT event_type, user_id, top, detected FROM p WHERE action NOT IN ('delete', 'orphan')")
def reconciled(t: Tables) -> DataFrame:
    """Each kind of event is a source: one that fails keeps its rows, one that is no source any more loses them."""
    return _reconciled(t)[0].read()


@query("snk06_decisions", f"{_RECONCILED} SELECT event_type, user_id, action, 'second half' AS run FROM p WHERE action IN ('delete', 'orphan')")
def reconcile_decisions(t: Tables) -> DataFrame:
    return _reconciled(t)[1].read().select("event_type", "user_id", "action", "run")


#: Statuses of a relation by strength, and those that stand open.
STRENGTH, OPEN = {"rejected": 1, "candidate": 1, "promoted": 2, "verified": 3}, ["candidate", "rejected"]
_PROMOTED = """WITH s AS (SELECT l_partkey % 500 AS a, l_suppkey AS b, l_returnflag AS kind, l_shipdate, l_quantity, l_discount FROM lineitem),
o AS (SELECT a, b, kind, CASE WHEN max(l_quantity) > 45 THEN 'verified' WHEN max(l_quantity) > 30 THEN 'promoted' ELSE 'candidate' END AS status FROM s WHERE l_shipdate < DATE '1998-01-01' GROUP BY ALL),
n AS (SELECT a, b, kind, CASE WHEN max(l_quantity) > 40 THEN 'promoted' WHEN max(l_quantity) > 20 THEN 'candidate' ELSE 'rejected' END AS status FROM s WHERE l_shipdate >= DATE '1998-01-01' GROUP BY ALL),
d AS (SELECT DISTINCT a, b, kind FROM s WHERE l_discount >= 0.1),
r(status, strength) AS (VALUES ('rejected', 1), ('candidate', 1), ('promoted', 2), ('verified', 3)),
p AS (SELECT coalesce(o.a, n.a) AS a, coalesce(o.b, n.b) AS b, coalesce(o.kind, n.kind) AS kind, o.status AS was, n.status AS proposed,
  CASE WHEN n.a IS NULL THEN 'keep' WHEN d.a IS NOT NULL THEN CASE WHEN o.a IS NULL THEN 'none' ELSE 'blocked' END WHEN o.a IS NULL THEN 'insert'
    WHEN y.strength < x.strength THEN 'held' WHEN o.status = n.status THEN 'keep' ELSE 'update' END AS action
  FROM o FULL JOIN n ON o.a = n.a AND o.b = n.b AND o.kind = n.kind LEFT JOIN d ON d.a = coalesce(o.a, n.a) AND d.b = coalesce(o.b, n.b) AND d.kind = coalesce(o.kind, n.kind)
  LEFT JOIN r x ON x.status = o.status LEFT JOIN r y ON y.status = n.status)"""


def _promoted(t: Tables):
    lines = t.lineitem.select((F.col("l_partkey") % 500).alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("kind"), "l_shipdate", "l_quantity", "l_discount")
    most, day = F.max("l_quantity"), F.lit("1998-01-01").cast("date")
    keys = ["a", "b", "kind"]
    old = lines.where(F.col("l_shipdate") < day).groupBy(*keys).agg(F.when(most > 45, "verified").when(most > 30, "promoted").otherwise("candidate").alias("status"))
    new = lines.where(F.col("l_shipdate") >= day).groupBy(*keys).agg(F.when(most > 40, "promoted").when(most > 20, "candidate").otherwise("rejected").alias("status"))
    table, log = _tables(t, "promoted", "decisions")
    table.replace(old)
    plan = monotone(table.read(), new, ["a", "b"], "kind", "status", STRENGTH, lines.where("l_discount >= 0.1"), OPEN)
    return table, log, carry_out(plan, table, log, "second")


@query("snk11_promoted", f"{_PROMOTED} SELECT a, b, kind, CASE WHEN action IN ('insert', 'update') THEN proposed ELSE was END AS status FROM p WHERE action <> 'none'")
def promoted(t: Tables) -> DataFrame:
    """No standing status gets weaker by a proposal, and no proposal passes a tombstone."""
    return _promoted(t)[0].read()


@query(
    "snk11_decisions",
    f"""{_PROMOTED} SELECT a, b, kind, was AS status, proposed, action, 'second' AS run, coalesce(
      (SELECT min(x.kind) FROM o x WHERE x.a = p.a AND x.b = p.b AND x.kind <> p.kind AND x.status IN ('candidate', 'rejected')),
      (SELECT min(x.kind) FROM d x WHERE x.a = p.a AND x.b = p.b AND x.kind <> p.kind)) AS switched_from
    FROM p WHERE action IN ('held', 'blocked', 'none')""",
)
def promotion_decisions(t: Tables) -> DataFrame:
    """What the log tells: proposals that a stronger status or a tombstone held back, with the other kind of the same pair."""
    return _promoted(t)[1].read()


def repointed(pairs: DataFrame, a: str, b: str, mapping: DataFrame) -> DataFrame:
    """``pairs`` (a, b) after keys were merged by ``mapping`` (old, new): ends ordered again, without pairs of one key and repeats."""
    told = scratch.maybe_broadcast(once(mapping, ["old"]))
    end = lambda c: F.coalesce(F.col(f"_{c}.new"), F.col(c))
    for c in (a, b):
        pairs = pairs.join(told.alias(f"_{c}"), F.col(c) == F.col(f"_{c}.old"), "left").withColumn(f"{c}_", end(c)).drop("old", "new")
    pairs = pairs.where(F.col(f"{a}_") != F.col(f"{b}_"))
    return pairs.select(F.least(f"{a}_", f"{b}_").alias(a), F.greatest(f"{a}_", f"{b}_").alias(b)).distinct()


@query(
    "snk08_written_repoint",
    """WITH m AS (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS new FROM part),
    p AS (SELECT DISTINCT least(x.l_partkey, y.l_partkey) AS a, greatest(x.l_partkey, y.l_partkey) AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber + 1 = y.l_linenumber)
    SELECT DISTINCT least(s.new, t.new) AS a, greatest(s.new, t.new) AS b FROM p JOIN m s ON s.old = a JOIN m t ON t.old = b WHERE s.new <> t.new""",
)
def written_repoint(t: Tables) -> DataFrame:
    """Items of one name and brand become the least of them; the pairs of neighbouring lines that refer to them are written anew."""
    same = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("new"))
    mapping = t.part.join(same, ["p_name", "p_brand"]).where("p_partkey <> new").select(F.col("p_partkey").alias("old"), "new")
    line = lambda s, shift: t.lineitem.select("l_orderkey", (F.col("l_linenumber") + shift).alias("l_linenumber"), F.col("l_partkey").alias(s))
    both = line("x", 1).join(line("y", 0), ["l_orderkey", "l_linenumber"])
    (table,) = _tables(t, "pairs")
    table.replace(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    table.replace(repointed(table.read(), "a", "b", mapping))
    return table.read()
