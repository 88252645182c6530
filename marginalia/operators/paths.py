"""Graph algorithms in rounds over written tables: cheapest paths, cycles, triple validation, reified relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..registry import Tables, query
from .graph import _EDGES, _NODES, edges, nodes
from .ranges import previous

#: The least that trust times confidence of a step counts as.
LEAST = 1e-3


def step_cost(trust: Column, confidence: Column) -> Column:
    """What a step costs: the weaker its ground, the more. Null grounds count as none."""
    part = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.cast("double"), F.lit(0.0))))
    return 1.0 / F.greatest(F.lit(LEAST), part(trust) * part(confidence))


def cheapest_paths(ties: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """(start, ref, cost, path array): from each of ``starts`` (start) the ``k`` cheapest paths without repeated nodes, to whatever
    end, over ``ties`` (src, dst, cost > 0), ordered by cost, then end, then path. Costs are rounded to nine places.

    Label setting: all of a path's beginnings are cheaper than the path, so a start never needs more than its k cheapest
    labels, and what falls behind them is dropped with all that would follow from it. Each round extends the labels
    that were new and stayed; there are at most k rounds, each written. A hub offers each label one row for each
    neighbour; of these, tasks keep k for each start before they are shuffled.
    """
    ties = scratch.materialize(ties.where("src <> dst").groupBy("src", "dst").agg(F.min("cost").alias("cost")), "ties")
    order = Window.partitionBy("start").orderBy("cost", "ref", F.array_join("path", ">"))
    kept, hop = None, 0
    fresh = starts.where("start IS NOT NULL").distinct().select("start", F.col("start").alias("ref"), F.lit(0.0).alias("cost"), F.array("start").alias("path"))
    while True:
        on = fresh.withColumnRenamed("cost", "spent").join(ties, F.col("ref") == F.col("src"))
        more = on.where(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("ref"), F.round(F.col("spent") + F.col("cost"), 9).alias("cost"), F.array_append("path", F.col("dst")).alias("path"), F.lit(hop).alias("hop"))
        both = more if kept is None else kept.unionByName(more)
        before, kept = kept, scratch.materialize(both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r"), "labels")
        scratch.discard(before)
        fresh, hop = kept.where(F.col("hop") == hop).select("start", "ref", "cost", "path"), hop + 1
        if fresh.isEmpty():
            return kept.select("start", "ref", "cost", "path")


_FOLLOWS = """ties AS (SELECT src, dst, min(1 / greatest(0.001, least(1, greatest(0, trust)) * least(1, greatest(0, confidence)))) AS cost FROM (
    SELECT lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_id AS dst, value / 100 AS trust, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence FROM events
    UNION ALL SELECT lag(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id), event_id, value / 100, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 FROM events) WHERE src IS NOT NULL GROUP BY 1, 2)"""


def follow_ties(t: Tables) -> DataFrame:
    """Each event is tied to the next one of its user and to the next one of its kind."""
    rows = t.events.select("event_id", "user_id", "event_type", "ts", (F.col("value") / 100).alias("trust"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"))
    parts = [previous(rows, [key], ["ts", "event_id"], "src", F.col("event_id")).where("src IS NOT NULL").select("src", F.col("event_id").alias("dst"), step_cost(F.col("trust"), F.col("confidence")).alias("cost")) for key in ("user_id", "event_type")]
    return parts[0].unionByName(parts[1])


@query(
    "grf12_cheapest_paths",
    f"""WITH RECURSIVE {_FOLLOWS}, p AS (SELECT start, start AS ref, CAST(0 AS DOUBLE) AS cost, [start] AS path FROM (SELECT min_by(event_id, (ts, event_id)) AS start FROM events GROUP BY user_id)
      UNION ALL SELECT start, dst, round(p.cost + t.cost, 9), list_append(path, dst) FROM p JOIN ties t ON p.ref = t.src WHERE len(path) <= 6 AND NOT list_contains(path, dst))
    SELECT start, ref, cost, array_to_string(path, '>') AS path FROM p WHERE len(path) > 1 QUALIFY row_number() OVER (PARTITION BY start ORDER BY cost, ref, array_to_string(path, '>')) <= 6""",
)
def best_paths(t: Tables) -> DataFrame:
    """Six best founded chains of events after the first event of each user."""
    starts = t.events.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("start")).select("start")
    return cheapest_paths(follow_ties(t), starts, 6).select("start", "ref", "cost", F.array_join("path", ">").alias("path"))


# ---- cycles ----


def peeled(e: DataFrame) -> DataFrame:
    """The edges (src, dst) that are left when nodes without edges into them, or without edges out of them, are taken away again and
    again: those of cycles and of ways between cycles. As many rounds as the longest way into or out of a cycle."""
    left = scratch.materialize(e.select("src", "dst").distinct(), "core")
    n = left.count()
    while n:
        out = left.join(left.select(F.col("dst").alias("_d")).distinct(), F.col("src") == F.col("_d"), "left_semi")
        out = out.join(left.select(F.col("src").alias("_s")).distinct(), F.col("dst") == F.col("_s"), "left_semi")
        before, left = left, scratch.materialize(out, "core")
        scratch.discard(before)
        m = left.count()
        if m == n:
            break
        n = m
    return left


def chain_ends(links: DataFrame, many: int) -> DataFrame:
    """(ref, end): where the way that starts at each of ``links`` (ref, end: the next node) leaves them; null on a ring. Each round doubles the steps
    taken, so ``many`` links need as many rounds as ``many`` has bits; what is inside then goes round."""
    rounds = max(1, many).bit_length()
    for _ in range(rounds):
        on = links.select(F.col("ref").alias("_at"), F.col("end").alias("_to"))
        before, links = links, scratch.materialize(links.join(on, F.col("end") == F.col("_at"), "left").select("ref", F.coalesce("_to", "end").alias("end")), "ends")
        scratch.discard(before)
    inside = links.select(F.col("ref").alias("_at")).distinct()
    return links.join(inside, F.col("end") == F.col("_at"), "left").select("ref", F.when(F.col("_at").isNull(), F.col("end")).alias("end"))


def contracted(e: DataFrame) -> DataFrame:
    """(src, dst, u, v) of the edges: nodes with one edge into them and one out of them are passed through, so an edge stands for the edge (u, v) between the
    ends of its chain, and lies on a cycle if that one does. Both are null on a ring of such nodes alone."""
    e = scratch.materialize(e.select("src", "dst").distinct(), "plain")
    into = e.groupBy(F.col("dst").alias("ref")).agg(F.count("*").alias("n_in"), F.min("src").alias("up"))
    out = e.groupBy(F.col("src").alias("ref")).agg(F.count("*").alias("n_out"), F.min("dst").alias("down"))
    passed = scratch.materialize(into.where("n_in = 1").join(out.where("n_out = 1"), "ref").select("ref", "up", "down"), "passed")
    many = passed.count()
    ends = {x: scratch.materialize(chain_ends(scratch.materialize(passed.select("ref", F.col(x).alias("end")), x), many), x) for x in ("up", "down")}
    side = lambda x, n: ends[x].select(F.col("ref").alias(f"_{n}"), F.col("end").alias(f"{n}_end"), F.lit(True).alias(f"{n}_in"))
    rows = e.join(side("up", "s"), F.col("src") == F.col("_s"), "left").join(side("down", "d"), F.col("dst") == F.col("_d"), "left")
    end = lambda n, own: F.when(F.col(f"{n}_in"), F.col(f"{n}_end")).otherwise(F.col(own))
    return rows.select("src", "dst", end("s", "src").alias("u"), end("d", "dst").alias("v"))


def cyclic_edges(e: DataFrame) -> DataFrame:
    """The edges (src, dst) that lie on a cycle, self-edges included. Chains become one edge each first, so that long ones cost no rounds."""
    loops = e.where("src = dst").select("src", "dst").distinct()
    chains = scratch.materialize(contracted(e.where("src <> dst")), "chains")
    inner = core_cycles(chains.where("u IS NOT NULL").select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct())
    on = chains.join(inner.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_semi")
    return loops.unionByName(on.select("src", "dst")).unionByName(chains.where("u IS NULL").select("src", "dst"))


def core_cycles(e: DataFrame) -> DataFrame:
    """The edges (src, dst) that lie on a cycle, self-edges included, by peeling and colouring.

    Peeling leaves the core. There every node takes on the least node that reaches it; from each node that has kept itself,
    its component is what leads back to it among the nodes of its colour. Components go, the rest is peeled and coloured again.
    """
    loops = e.where("src = dst").select("src", "dst").distinct()
    found, core = loops, peeled(e.where("src <> dst"))
    while not core.isEmpty():
        colours = scratch.materialize(core.select(F.col("src").alias("ref")).union(core.select("dst")).distinct().withColumn("colour", F.col("ref")), "colours")
        while True:
            told = core.join(colours, F.col("src") == F.col("ref")).groupBy(F.col("dst").alias("_d")).agg(F.min("colour").alias("_c"))
            moved = colours.join(told, F.col("ref") == F.col("_d"), "left").select("ref", F.least("colour", "_c").alias("colour"), (F.col("_c") < F.col("colour")).alias("moved"))
            before, colours = colours, scratch.materialize(moved, "colours")
            scratch.discard(before)
            done = colours.where("moved").isEmpty()
            path, colours = colours.scratch_path, colours.select("ref", "colour")
            colours.scratch_path = path
            if done:
                break
        side = lambda end: colours.select(F.col("ref").alias(f"_{end}"), F.col("colour").alias(f"{end}_colour"))
        same = scratch.materialize(core.join(side("src"), F.col("src") == F.col("_src")).join(side("dst"), F.col("dst") == F.col("_dst")).where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")), "same")
        member = front = scratch.materialize(colours.where("ref = colour").select("ref"), "members")
        while not front.isEmpty():
            back = same.join(front, F.col("dst") == F.col("ref")).select(F.col("src").alias("ref")).distinct()
            front = scratch.materialize(back.join(member, "ref", "left_anti"), "front")
            member = member.unionByName(front)
        member = scratch.materialize(member, "members")
        inside = same.join(member, F.col("src") == F.col("ref"), "left_semi").join(member, F.col("dst") == F.col("ref"), "left_semi")
        found = found.unionByName(inside.select("src", "dst"))
        rest = core.join(member, F.col("src") == F.col("ref"), "left_anti").join(member, F.col("dst") == F.col("ref"), "left_anti")
        core = peeled(rest)
    return found


# ---- triples ----


def violations(triples: DataFrame, known: DataFrame, shapes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(src, dst, type, reasons): each distinct triple with what is wrong with it, sorted; no reasons where it stands.

    ``known`` (ref, label) are the nodes, ``ancestors`` (label, ancestor) says of what a label is a kind (itself is added), and
    ``shapes`` (type, domain, range, most, acyclic, bare) is the catalogue, a bounded list with a row for each type: the ends' kinds (null:
    any), how many triples a node may send out, whether they may close a cycle, and whether the triple may stand without a node of its own.
    Of more triples than ``most`` the first ones by their ends stand.
    """
    rows = triples.select("src", "dst", "type").distinct()
    shapes, kinds = F.broadcast(shapes), ancestors.select("label", "ancestor").union(known.select("label", F.col("label").alias("ancestor"))).distinct()
    kinds = scratch.maybe_broadcast(scratch.materialize(kinds, "kinds"))
    labels = known.groupBy("ref").agg(F.first("label").alias("label"))
    rows = rows.join(shapes.withColumn("listed", F.lit(True)), "type", "left")
    for end, kind in (("src", "domain"), ("dst", "range")):
        told = labels.select(F.col("ref").alias(f"_{end}"), F.col("label").alias(f"{end}_label"))
        fit = kinds.select(F.col("label").alias(f"_{end}_l"), F.col("ancestor").alias(f"_{end}_a"), F.lit(True).alias(f"{end}_fits"))
        rows = rows.join(told, F.col(end) == F.col(f"_{end}"), "left").join(fit, (F.col(f"{end}_label") == F.col(f"_{end}_l")) & (F.col(kind) == F.col(f"_{end}_a")), "left")
    limited = triples.join(shapes.where("most IS NOT NULL").select("type", "most"), "type").select("src", "dst", "type", "most").distinct()
    # The first ones of a node are found map-side: no task sees all triples of a hub.
    bound = shapes.agg(F.max("most")).first()[0] or 0
    first = limited.withColumn("_n", F.row_number().over(Window.partitionBy("type", "src").orderBy("dst"))).where(F.col("_n") <= bound).where("_n <= most")
    over = limited.join(first, ["src", "dst", "type"], "left_anti").select("src", "dst", "type", F.lit(True).alias("over"))
    acyclic = triples.join(shapes.where("acyclic").select("type"), "type", "left_semi")
    # One walk for all acyclic types: a node of a type is a node of its own.
    marked = acyclic.select(*(F.to_json(F.struct("type", F.col(end).alias("ref"))).alias(end) for end in ("src", "dst")))
    back = cyclic_edges(marked).select(F.get_json_object("src", "$.ref").alias("src"), F.get_json_object("dst", "$.ref").alias("dst"), F.get_json_object("src", "$.type").alias("type"), F.lit(True).alias("cycle"))
    rows = rows.join(over, ["src", "dst", "type"], "left").join(back, ["src", "dst", "type"], "left")
    reasons = [
        ("unknown_relation", F.col("listed").isNull()), ("unknown_subject", F.col("src_label").isNull()), ("unknown_object", F.col("dst_label").isNull()),
        ("must_reify", ~F.col("bare")), ("domain", F.col("src_label").isNotNull() & F.col("domain").isNotNull() & F.col("src_fits").isNull()),
        ("range", F.col("dst_label").isNotNull() & F.col("range").isNotNull() & F.col("dst_fits").isNull()), ("cardinality", F.col("over")), ("cycle", F.col("cycle")),
    ]
    return rows.select("src", "dst", "type", F.array_sort(F.array_compact(F.array(*(F.when(c, name) for name, c in reasons)))).alias("reasons"))


#: The catalogue of the triples below.
SHAPES = [("LIVES_IN", "person", "place", 1, False, True), ("BASED_IN", "supplier", "nation", None, False, True), ("PART_OF", "place", "place", 1, True, True), ("SHIPS_TO", "supplier", "customer", 3, False, True), ("REPLACES", None, None, None, True, True), ("GOVERNS", "place", None, None, False, False)]
KINDS = [("customer", "person"), ("nation", "place"), ("region", "place"), ("customer", "party"), ("supplier", "party")]

_SHIPPED = "SELECT DISTINCT 's' || l_suppkey AS src, 'c' || o_custkey AS dst, 'SHIPS_TO' AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 49"
#: Customers of a nation replace each other in the order of their balance; in nations of an odd number of customers the last one replaces the first.
_REPLACES = """r AS (SELECT 'c' || c_custkey AS ref, c_nationkey AS g, c_mktsegment AS m, lead('c' || c_custkey) OVER w AS nxt, first_value('c' || c_custkey) OVER w AS head, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n
  FROM customer WHERE c_acctbal > 7000 WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey))"""


def proposed_triples(t: Tables) -> DataFrame:
    """Triples of the graph, shipments, replacements with cycles, and some that no catalogue knows."""
    lines = t.lineitem.where("l_quantity > 49").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"), F.lit("SHIPS_TO").alias("type"))
    group = Window.partitionBy("c_nationkey", "c_mktsegment")
    row = group.orderBy("c_acctbal", "c_custkey")
    ref = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    ring = t.customer.where("c_acctbal > 7000").select(ref.alias("src"), F.lead(ref).over(row).alias("next"), F.first(ref).over(row).alias("head"), F.count("*").over(group).alias("n"))
    replaces = ring.select("src", F.when(F.col("next").isNotNull(), F.col("next")).when(F.col("n") % 2 == 1, F.col("head")).alias("dst"), F.lit("REPLACES").alias("type")).where("dst IS NOT NULL")
    odd = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("x"), "n_regionkey").alias("dst"), F.explode(F.array(F.lit("GOVERNS"), F.lit("KNOWS"), F.lit("LIVES_IN"))).alias("type"))
    return edges(t).unionByName(shipped).unionByName(replaces).unionByName(odd)


@query(
    "ont02_reasons",
    f"""WITH RECURSIVE {_NODES}, {_EDGES}, {_REPLACES}, t AS (SELECT src, dst, type FROM edges UNION {_SHIPPED}
        UNION SELECT ref, coalesce(nxt, CASE WHEN n % 2 = 1 THEN head END), 'REPLACES' FROM r WHERE nxt IS NOT NULL OR n % 2 = 1
        UNION SELECT 'n' || n_nationkey, 'x' || n_regionkey, unnest(['GOVERNS', 'KNOWS', 'LIVES_IN']) FROM nation),
      shapes(type, domain, range, most, acyclic, bare) AS (VALUES {', '.join('(' + ', '.join('NULL' if x is None else repr(x) if isinstance(x, str) else str(x) for x in s) + ')' for s in SHAPES)}),
      kinds(label, ancestor) AS (VALUES {', '.join(map(str, KINDS))}), k AS (SELECT * FROM kinds UNION SELECT DISTINCT label, label FROM nodes),
      reach AS (SELECT src, dst FROM t WHERE type = 'REPLACES' UNION SELECT x.src, y.dst FROM reach x JOIN t y ON x.dst = y.src AND y.type = 'REPLACES'),
      f AS (SELECT t.*, s.type IS NULL AS unlisted, a.label AS al, b.label AS bl, s.domain, s.range, s.most, s.bare, row_number() OVER (PARTITION BY t.type, t.src ORDER BY t.dst) AS n,
        t.type = 'REPLACES' AND EXISTS (SELECT 1 FROM reach WHERE reach.src = t.dst AND reach.dst = t.src) OR (t.type = 'REPLACES' AND t.src = t.dst) AS cyc
        FROM t LEFT JOIN shapes s ON s.type = t.type LEFT JOIN nodes a ON a.ref = t.src LEFT JOIN nodes b ON b.ref = t.dst)
    SELECT src, dst, type, array_to_string(list_sort(list_filter([CASE WHEN unlisted THEN 'unknown_relation' END, CASE WHEN al IS NULL THEN 'unknown_subject' END, CASE WHEN bl IS NULL THEN 'unknown_object' END, CASE WHEN NOT bare THEN 'must_reify' END,
      CASE WHEN al IS NOT NULL AND domain IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.label = al AND k.ancestor = domain) THEN 'domain' END,
      CASE WHEN bl IS NOT NULL AND range IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.label = bl AND k.ancestor = range) THEN 'range' END,
      CASE WHEN n > most THEN 'cardinality' END, CASE WHEN cyc THEN 'cycle' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM f""",
)
def triple_reasons(t: Tables) -> DataFrame:
    spark = t.spark
    shapes = spark.createDataFrame(SHAPES, "type string, domain string, range string, most int, acyclic boolean, bare boolean")
    found = violations(proposed_triples(t), nodes(t), shapes, spark.createDataFrame(KINDS, "label string, ancestor string"))
    return found.select("src", "dst", "type", F.array_join("reasons", ",").alias("reasons"))


# ---- reified relations ----

#: Statuses that put a relation into the cache, and the one that keeps it out of the graph.
ANCHORED, REJECTED = ("promoted", "verified"), "rejected"
AXES = ("window", "status", "cost")


def reified_rows(relations: DataFrame, conditions: DataFrame) -> DataFrame:
    """(ref, element, part, target, value): what reified relations put into a graph.

    ``relations`` (ref, kind, status, agent, patient, governed_by) give a node, two role edges and an edge to the section that governs
    them; ``conditions`` (ref, axis, role, value) a node each; relations that are anchored also a flat cache row: for each axis the
    value of its only condition, else none, the tier, and whether only the reified form tells all (several
    conditions on an axis, or one on the patient). Rejected relations give nothing. Conditions are counted map-side, so
    a relation may have any number of them.
    """
    live = relations.where(F.col("status") != REJECTED)
    element = lambda name, part, target, value: F.struct(F.lit(name).alias("element"), part.cast("string").alias("part"), target.cast("string").alias("target"), value.cast("string").alias("value"))
    none, kind = F.lit(None), F.trim("kind")
    own = [element("node", F.upper(kind), none, F.col("status")), element("role", F.lit("agent"), F.col("agent"), none), element("role", F.lit("patient"), F.col("patient"), none)]
    rows = live.select("ref", F.inline(F.array(*own))).unionByName(live.where("trim(governed_by) <> ''").select("ref", F.inline(F.array(element("governed_by", none, F.col("governed_by"), none)))))
    held = conditions.join(live.select("ref"), "ref", "left_semi").select("ref", F.lower(F.trim("axis")).alias("axis"), "role", "value")
    rows = rows.unionByName(held.select("ref", F.inline(F.array(element("condition", F.col("axis"), F.col("role"), F.col("value"))))))
    counts = [f(x) for x in AXES for f in (lambda x: F.count_if(F.col("axis") == x).alias(f"n_{x}"), lambda x: F.max(F.when(F.col("axis") == x, F.col("value"))).alias(f"v_{x}"))]
    flat = held.groupBy("ref").agg(*counts, F.max(F.coalesce(F.col("role") == "patient", F.lit(False))).alias("on_patient"))
    anchored = live.where(F.col("status").isin(*ANCHORED)).join(flat, "ref", "left")
    several = F.greatest(*(F.coalesce(F.col(f"n_{x}"), F.lit(0)) for x in AXES)) > 1
    only = several | F.coalesce("on_patient", F.lit(False))
    single = F.concat_ws(";", F.lower(kind), *(F.concat(F.lit(f"{x}="), F.when(F.col(f"n_{x}") == 1, F.col(f"v_{x}"))) for x in AXES), F.lit("tier=1"), F.when(only, "reified"))
    return rows.unionByName(anchored.select("ref", F.inline(F.array(element("cache", F.col("agent"), F.col("patient"), single)))))


@query(
    "grf14_reified_rows",
    """WITH i AS (SELECT o_orderkey AS ref, ' ' || o_orderpriority AS kind, CASE o_orderstatus WHEN 'F' THEN 'promoted' WHEN 'P' THEN 'rejected' ELSE 'candidate' END AS status, 'c' || o_custkey AS agent,
        's' || (SELECT min(l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS patient, CASE WHEN o_totalprice > 250000 THEN 'section' ELSE '' END AS governed_by FROM orders), l AS (SELECT * FROM i WHERE status <> 'rejected'),
      c AS (SELECT l_orderkey AS ref, 'window' AS axis, 'agent' AS role, l_returnflag AS value FROM lineitem WHERE l_quantity > 30 UNION ALL SELECT l_orderkey, 'status', CASE WHEN l_tax > 0.07 THEN 'patient' ELSE 'agent' END, l_linestatus FROM lineitem WHERE l_quantity > 45
        UNION ALL SELECT l_orderkey, 'cost', NULL, CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_discount > 0.09), h AS (SELECT c.* FROM c JOIN l USING (ref)),
      f AS (SELECT ref, count(*) FILTER (axis = 'window') AS nw, max(value) FILTER (axis = 'window') AS vw, count(*) FILTER (axis = 'status') AS ns, max(value) FILTER (axis = 'status') AS vs, count(*) FILTER (axis = 'cost') AS nc, max(value) FILTER (axis = 'cost') AS vc, bool_or(coalesce(role = 'patient', false)) AS p FROM h GROUP BY ref)
    SELECT ref, 'node' AS element, upper(trim(kind)) AS part, NULL AS target, status AS value FROM l UNION ALL SELECT ref, 'role', 'agent', agent, NULL FROM l UNION ALL SELECT ref, 'role', 'patient', patient, NULL FROM l
    UNION ALL SELECT ref, 'governed_by', NULL, governed_by, NULL FROM l WHERE governed_by <> '' UNION ALL SELECT ref, 'condition', axis, role, value FROM h
    UNION ALL SELECT ref, 'cache', agent, patient, concat_ws(';', lower(trim(kind)), CASE WHEN nw = 1 THEN 'window=' || vw END, CASE WHEN ns = 1 THEN 'status=' || vs END, CASE WHEN nc = 1 THEN 'cost=' || vc END, 'tier=1', CASE WHEN nw > 1 OR ns > 1 OR nc > 1 OR p THEN 'reified' END)
      FROM l LEFT JOIN f USING (ref) WHERE status = 'promoted'""",
)
def reified_orders(t: Tables) -> DataFrame:
    """Orders as relations of a customer and its first supplier, lines as their conditions."""
    n = t.lineitem.count()
    lines = scratch.spread(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus"), n, "l_orderkey")
    supplier = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.concat(F.lit("s"), F.min("l_suppkey")).alias("patient"))
    status = F.when(F.col("o_orderstatus") == "F", "promoted").when(F.col("o_orderstatus") == "P", "rejected").otherwise("candidate")
    relations = scratch.spread(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"), n, "o_orderkey").join(supplier, "o_orderkey", "left").select(F.col("o_orderkey").alias("ref"), F.concat(F.lit(" "), "o_orderpriority").alias("kind"), status.alias("status"), F.concat(F.lit("c"), "o_custkey").alias("agent"), "patient", F.when(F.col("o_totalprice") > 250_000, "section").otherwise("").alias("governed_by"))
    # One pass over the lines gives their conditions, so that they stay dealt by order.
    line = lambda where, axis, role, value: F.when(F.expr(where), F.struct(F.lit(axis).alias("axis"), role.cast("string").alias("role"), value.cast("string").alias("value")))
    told = F.array(line("l_quantity > 30", "window", F.lit("agent"), F.col("l_returnflag")), line("l_quantity > 45", "status", F.when(F.col("l_tax") > 0.07, "patient").otherwise("agent"), F.col("l_linestatus")), line("l_discount > 0.09", "cost", F.lit(None), F.col("l_linenumber")))
    conditions = lines.select(F.col("l_orderkey").alias("ref"), F.inline(F.filter(told, lambda c: c.isNotNull())))
    return reified_rows(relations, conditions)
