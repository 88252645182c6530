import random
import re
from datetime import datetime, timedelta
from itertools import combinations

import duckdb

from pyspark.sql import functions as F

from marginalia import catalogue, scratch
from marginalia.functions import texts
from marginalia.functions.scalars import squeezed
from marginalia.operators.aggregates import all_co_occurrence, co_occurrence, noisy_or, whole_mean
from marginalia.operators.changes import flips, grounded, upserted
from marginalia.operators.entities import consolidated
from marginalia.operators.filters import page
from marginalia.operators.graph import shortest_paths
from marginalia.operators.joins import latest_before
from marginalia.operators.linking import mentions
from marginalia.operators.ranges import previous, ranked, running
from marginalia.operators.retrieval import CAUSAL, fuse
from marginalia.operators.sections import HEADER, parsed_sections
from marginalia.operators.sinks import ParquetTable
from marginalia.streaming import streams

from compare import expected, rows_of


def test_fusion_sums_places_and_breaks_ties_by_first_list(spark):
    lists = spark.createDataFrame([(1, 0, 1, 0.0), (1, 1, 2, 0.0), (2, 0, 2, 0.0)], "list_id int, pos int, item long, bonus double")
    assert {r.item: r.score for r in fuse(lists, 0).collect()} == {2: 1.5, 1: 1.0}
    assert fuse(lists.where("false")).count() == 0


def test_co_occurrence_counts_each_basket_once(spark):
    baskets = spark.createDataFrame([(1, "A"), (1, "B"), (1, "A"), (2, "A"), (2, "B"), (3, "C")], "basket long, item string")
    pairs = spark.createDataFrame([("A", "B"), ("A", "X"), ("A", "C")], "a string, b string")
    got = {(r.a, r.b): (r.co, round(r.support, 6), round(r["lift"], 6)) for r in co_occurrence(baskets, pairs).collect()}
    assert got == {("A", "B"): (2, 0.666667, 1.5), ("A", "X"): (0, 0.0, 0.0), ("A", "C"): (0, 0.0, 0.0)}


def test_noisy_or_counts_a_cluster_once(spark):
    rows = spark.createDataFrame([("x", "c", 0.5), ("x", "c", 0.4), ("x", "d", 0.5)], "k string, c string, s double")
    assert noisy_or(rows, "k", F.col("c"), F.col("s")).first().trust == 0.75


def test_latest_before_takes_the_last_price_and_none_before_the_first(spark):
    at = lambda d: datetime(2024, 1, d)
    events = spark.createDataFrame([("m", 1, at(1)), ("m", 2, at(5)), ("n", 3, at(5))], "model string, id long, ts timestamp_ntz")
    prices = spark.createDataFrame([("m", at(2), 1.0, 1), ("m", at(5), 2.0, 2), ("m", at(5), 3.0, 3)], "model string, since timestamp_ntz, price double, n long")
    got = {r.id: r.price for r in latest_before(events, prices, "model", "ts", "since", "n", ["price"]).collect()}
    assert got == {1: None, 2: 3.0, 3: None}


def test_upsert_keeps_old_values_where_new_ones_are_null(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, y long")
    new = spark.createDataFrame([(2, None, 9), (3, "c", None)], "k long, x string, y long")
    assert sorted(map(tuple, upserted(old, new, "k", ["x", "y"]).collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", None)]


def test_consolidation_reaches_chains(spark):
    pairs = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21)], "a long, b long")
    assert {r.node: r.root for r in consolidated(pairs).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20}


def test_consolidation_ends_only_when_no_label_changes(spark):
    pairs = [(0, 70), *((k, k + 1) for k in range(1, 70))]  # one step a round for labels that only spread along pairs
    assert {r.node: r.root for r in consolidated(spark.createDataFrame(pairs, "a long, b long")).collect()} == dict.fromkeys(range(71), 0)


def test_consolidation_takes_all_pairs(spark, sf_dir):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect():
        a, b = sorted((find(r[0]), find(r[1] + 1_000_000)))
        top[b] = a
    assert {r.node: r.root for r in catalogue.queries()["ent05_consolidation_all"](spark, sf_dir).collect()} == {x: find(x) for x in top}


def test_flips_hold_whole_texts_of_a_source(spark):
    head = "x" * 30
    rows = [(1, "s", head + "a"), (2, "s", head + "b"), (3, "s", head + "a"), (4, "s", head + "a"), (5, "t", head + "b"), (6, "t", None), (7, "t", "c"), (8, "t", None), (9, None, "c"), (10, None, "d"), (11, None, "c")]
    rows += [(k, "hot", f"{k % 5}" if k % 2 else f"new {k}") for k in range(100, 300)]
    seen, last, want = {}, {}, {}
    for i, s, x in rows:
        want[i] = x in seen.setdefault(s, set()) and last[s] != x
        seen[s].add(x)
        last[s] = x
    assert {r.doc_id: r.flip for r in flips(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)).collect()} == want


def test_quotes_are_grounded_as_a_whole(spark):
    opening = "the quick brown fox jumps over the lazy dog and runs on to the far end"
    quotes = spark.createDataFrame([(1, opening + " of it"), (2, "Two  Words"), (3, "nowhere to be found at all"), (4, " "), (5, "it\u2019s a so\u2014called fact of life")], "item_id long, text string")
    docs = spark.createDataFrame([(1, opening), (2, "x" + opening.upper() + "\nof  items, two words"), (3, "It's a so-called fact of lifetimes"), (4, None), (5, "two wordsmiths")], "doc_id long, text string")
    assert {r.item_id: r.texts for r in grounded(quotes, docs).collect()} == {1: 1, 2: 2, 3: 0, 4: 0, 5: 1}


def test_consistency_is_worked_out_for_every_customer(spark, sf_dir):
    got = {r.custkey: r.consistency for r in catalogue.queries()["evl02_consistency_all"](spark, sf_dir).collect()}
    flags = {}
    for r in spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).collect():
        flags.setdefault(r.o_custkey, {}).setdefault(r.o_orderkey, set()).add(r.l_returnflag)
    want = {c: [len(x & y) / len(x | y) for x, y in combinations(o.values(), 2)] for c, o in flags.items() if len(o) > 1}
    assert got.keys() == want.keys() and all(abs(got[c] - sum(v) / len(v)) < 1e-6 for c, v in want.items())


def test_all_pairs_of_items_are_measured(spark):
    baskets = spark.createDataFrame([(1, 2), (1, 9), (1, 2), (2, 2), (2, 9), (3, 4), (3, 9)], "basket long, item long")
    got = {(r.a, r.b): (r.co, round(r.support, 6), round(r["lift"], 6)) for r in all_co_occurrence(baskets).collect()}
    assert got == {(2, 9): (2, 0.666667, 1.0), (4, 9): (1, 0.333333, 1.0)}


def test_shortest_paths_stop_at_the_bound(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "d", "t"), ("a", "c", "t")], "src string, dst string, type string")
    assert {r.ref: (r.hops, r.path) for r in shortest_paths(edges, "a", 2).collect()} == {"a": (0, "a"), "b": (1, "a>b"), "c": (1, "a>c"), "d": (2, "a>c>d")}


def test_ranked_numbers_all_rows_without_gaps(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    rows = spark.range(0, 1_000_000).select(((F.col("id") * 7919) % 1_000_000).alias("x"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    assert ranked(rows, "r", F.asc("x")).agg(F.count("*"), F.count_if(F.col("r") != F.col("x") + 1)).first() == (1_000_000, 0)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_sums_and_carried_values_over_ranges(spark):
    rows = [("hot" if k % 3 else None if k % 2 else "x", (k * 37) % 301, k % 5) for k in range(301)]
    df, want, sums, last = spark.createDataFrame(rows, "k string, at long, v long").repartition(3), {}, {}, {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + v
        want[at] = (sums[k], last.get((k, "any")), last.get((k, "odd")))
        last[k, "any"] = at
        if v % 2:
            last[k, "odd"] = v
    got = running(df, ["k"], ["at"], "s", F.col("v"))
    got = previous(previous(got, ["k"], ["at"], "p", F.col("at")), ["k"], ["at"], "o", F.col("v"), F.col("v") % 2 == 1)
    assert {r["at"]: (r.s, r.p, r.o) for r in got.collect()} == want


def test_page_clamps_its_number(spark):
    assert [r.id for r in page(spark.range(10), -3, 4, "id").collect()] == [0, 1, 2, 3]


def test_text_helpers(spark):
    cases = [
        (squeezed(F.lit("a\n\tb  c ")), "a b c"),
        (texts.snippet(F.lit("abcdef ghijkl mnopqr"), 10), "abcdef…"),
        (texts.snippet(F.lit("ab cdefghijkl"), 10), "ab cdefghi…"),
        (texts.snippet(F.lit(" abcdefghijkl "), 5), "abcde…"),
        (texts.base_name(F.lit("Name (Alt Art) ")), "Name"),
        (texts.readable_icons(F.lit("pay :rb_energy_3:  :rb_any_rune: x_y")), "pay (3) [any rune] x_y"),
        (texts.plain_text(F.lit("a&AMP;lt;b<br>c&nbsp;d<script>x</script>")), "a<b c d"),
        (texts.magnitude(F.lit("Tank 2"))[0], "Tank"),
        (texts.magnitude(F.lit("Tank 2"))[1], 2),
        (texts.magnitude(F.lit("2"))[1], None),
        (texts.contains_word(F.lit("a tank-top"), F.lit("Tank")), True),
        (texts.contains_word(F.lit("tanks"), F.lit("tank")), False),
        (texts.contains_word(F.lit("x"), F.lit(" ")), False),
        (texts.section_code(F.lit("601.2d")), "601.2.d"),
        (texts.strong_url(F.lit("HTTP://WWW.Host.org/A/?q=1#f")), "host.org/a?q=1"),
        (texts.url_slug(F.lit("https://www.host.org/rules/core.rules.pdf")), "host-org-core-rules"),
        (texts.statement(F.lit(" So it  IS?! ")), "so it is"),
        (texts.relation_kind(F.lit("\"governed_by\".")), "governed by"),
        (texts.relation_kind(F.lit("x" * 41)), None),
        (texts.hex_colour(F.lit(" #AbC ")), "#abc"),
        (texts.hex_colour(F.lit("#abcd")), None),
    ]
    row = spark.range(1).select(*(c.alias(f"c{k}") for k, (c, _) in enumerate(cases))).first()
    assert list(row) == [want for _, want in cases]
    ids = [tuple(r.p) if r.p else None for r in spark.createDataFrame([("OGN-001-024",), ("sfd-239*-221",), ("unl-t04",), ("ven-sp3-006",), ("ogn-1a-24",), ("nonsense",)], "c string").select(texts.printed_id(F.col("c")).alias("p")).collect()]
    assert ids == [("OGN", 1, "", 24, False), ("SFD", 239, "star", 221, False), ("UNL", 4, "t", None, True), ("VEN", 3, "sp", 6, True), ("OGN", 1, "a", 24, False), None]


def brute_sections(text, most):
    clean = lambda x: re.sub(r"[ \t\n\x0b\f\r]+", " ", x).strip(" ")

    def parts(code, body, page):
        if len(body) <= most:
            return [(code, page, body)]
        out, held = [], ""
        for sentence in re.split(r"(?<=\.)[ \t\n\x0b\f\r]+", body):
            if len(held) + len(sentence) > most and held:
                out.append((code, page, held.strip(" ")))
                held = ""
            held += sentence + " "
        return out + [(code, page, held.strip(" "))]

    found = list(re.finditer(HEADER, text, re.M))
    if not found:
        return parts("", clean(text), 1) if clean(text) else []
    intro = clean(text[: found[0].start()])
    out = parts("intro", intro, 1) if len(intro) > 40 else []
    for m, end in zip(found, [*(x.start() for x in found[1:]), len(text)]):
        code = re.sub(r"^(.*?)\.?([a-z])$", lambda c: c[1].rstrip(".") + "." + c[2], m[1])
        if body := clean(text[m.end() : end]):
            out += parts(code, body, 1 + text[: m.start()].count("\f"))
    return out


def test_sections_are_parsed_as_by_hand(spark):
    long = " ".join(f"Sentence number {k} goes on for a while." for k in range(30))
    rows = [(1, "A title that is long enough to be an introduction of its own.\n101. First\n102.3b Second\f\n  103 Third. " + long), (2, "No header here\nat all"), (3, "short\n7. x\n8.\n9.1.c. y"), (4, ""), (5, None), (6, "1. \n2. two\f\f\n\n3. three")]
    got = {}
    for r in sorted(parsed_sections(spark.createDataFrame(rows, "id long, text string").where("text is not null"), "id", "text", 300).collect(), key=lambda r: (r.id, r.pos, r.part)):
        got.setdefault(r.id, []).append((r.code, r.page, r.body))
    assert got == {i: w for i, t in rows if t is not None and (w := brute_sections(t, 300))}


def test_mentions_take_the_longest_span_and_tolerate_misspellings(spark):
    surfaces = spark.createDataFrame([("death knell", "card:1"), ("death", "card:2"), ("knell of doom", "card:3"), ("tank", "card:4"), ("tank", "card:5"), ("guardian", "card:6")], "form string, ref string")
    texts = spark.createDataFrame([(1, "Does Death-Knell beat (death) knell?"), (2, "a TANK, guardiann"), (3, ""), (4, "?! ..")], "id long, text string")
    got = sorted((r.id, r["at"], r.len, r.ref, round(r.likeness, 3)) for r in mentions(texts, ["id"], "text", surfaces).collect())
    assert got[:2] == [(1, 1, 1, "card:1", 1.0), (1, 3, 2, "card:1", 1.0)]
    assert got[2:4] == [(2, 1, 1, "card:4", 1.0), (2, 1, 1, "card:5", 1.0)] and got[4][:4] == (2, 2, 1, "card:6") and 0.55 <= got[4][4] < 1 and len(got) == 5


def test_parquet_tables_keep_what_was_whole(spark, tmp_path):
    table = ParquetTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    table.replace(spark.range(5))
    table.append(spark.range(5, 7))
    (tmp_path / "t" / "v-9").mkdir()  # a version whose writer died
    table.delete(F.col("id") == 3)
    assert not table.replace_unless_empty(spark.range(0)) and sorted(r.id for r in table.read().collect()) == [0, 1, 2, 4, 5, 6]
    table.upsert(spark.createDataFrame([(6,), (8,)], "id long"), ["id"])
    assert table.read().count() == 7


def test_streams_agree_with_frames(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), events.schema, "3650 days")
    job = streams.tumbling_counts(stream, "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    static = streams.tumbling_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, static.collect()))


def test_state_follows_event_time_over_triggers_and_late_rows(spark, tmp_path):
    r = random.Random(7)
    at = lambda minute, micros=0: datetime(2024, 1, 1) + timedelta(minutes=minute, microseconds=micros)
    hot = [(1, k, at(k // 50, k % 3), r.choice("ab") if k % 90 else f"v{k}") for k in range(6000)]  # two hours, many rows in one millisecond
    rows = hot + [(None, 7000 + k, at(k), [None, "", "x"][k % 3]) for k in range(30)] + [(2, 8000, at(5), "only")]
    late = [(3, 9000, at(1), "dropped")]
    parts = [[x for x in rows if x[2] < at(70) and x[1] % 4], [x for x in rows if x[2] >= at(70) or not x[1] % 4], late, [(4, 9999, at(10**5), "end")]]
    schema = "source long, id long, ts timestamp, value string"
    with_store(spark)
    for k, part in enumerate(parts):
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "80 minutes")
        job = streams.content_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        job.awaitTermination(200)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = streams.content_changes_of(spark.createDataFrame(rows, schema))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and {x.outcome for x in got.collect()} == {"baseline", "unchanged", "flip_flop", "changed"}


def with_store(spark):
    for k, v in streams.STORE.items():
        spark.conf.set(k, v)


def test_queries_without_sql_run(spark, sf_dir):
    for name in set(catalogue.queries()) - set(catalogue.oracles()):
        assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_both_ways_of_the_as_of_join_agree(spark, monkeypatch):
    r = random.Random(9)
    at = lambda: datetime(2024, 1, 1) + timedelta(seconds=r.randrange(5000), microseconds=r.randrange(3))
    rows = [(r.choice(["m", "n", None, "unpriced"]), k, at()) for k in range(400)] + [("m", 900, None)]
    prices = [(r.choice(["m", "n", None]), at(), float(k), k) for k in range(60)] + [("m", datetime(2024, 1, 1, 0, 30), 1.0, 100 + k) for k in range(9)] + [("n", None, 5.0, 200)]
    events, listed = spark.createDataFrame(rows, "model string, id long, ts timestamp_ntz"), spark.createDataFrame(prices, "model string, since timestamp_ntz, price double, n long")

    def want(model, ts):
        fit = [(s, n, p) for m, s, p, n in prices if m == model and s is not None and ts is not None and s <= ts]
        return max(fit)[2] if fit else None

    expected_prices = {k: want(m, ts) for m, k, ts in rows}
    near = latest_before(events, listed.where("since IS NOT NULL"), "model", "ts", "since", "n", ["price"])
    assert {x.id: x.price for x in near.collect()} == expected_prices
    monkeypatch.setattr(scratch, "within", lambda *_: False)
    far = latest_before(events.where("ts IS NOT NULL"), listed.where("since IS NOT NULL"), "model", "ts", "since", "n", ["price"])
    assert {x.id: x.price for x in far.collect()} == {k: v for k, v in expected_prices.items() if k != 900}
    assert latest_before(events, listed.where("false"), "model", "ts", "since", "n", ["price"]).where("price IS NOT NULL").isEmpty()


def test_whole_means_do_not_depend_on_the_order_of_rows(spark):
    exact = [4.96, 13.63, 29.56, 29.14, 2.71]  # the sum in this order falls below
    rows = [(1, v) for v in exact] + [(2, v) for v in reversed(exact)] + [(3, -1.5), (3, -2.4), (4, None), (5, 0.7), (5, None)]
    got = {r.k: r.m for r in spark.createDataFrame(rows, "k int, v double").coalesce(1).groupBy("k").agg(whole_mean(F.col("v")).alias("m")).collect()}
    assert got == {1: 16, 2: 16, 3: -1, 4: None, 5: 0}


def test_usage_means_beside_a_whole_number_follow_the_files(spark, tmp_path):
    below, whole = [4.96, 13.63, 29.56, 29.14, 2.71], [4.96, 13.63, 29.56, 2.71, 29.14]  # one and the same five: added up in the first order they fall below 80, in the second they don't
    held = [row for k, (v, w) in enumerate(zip(below, whole)) for row in ((1, v), (2, w), (10 * k, v))]
    held += [(3, -1.5), (3, -2.4), (4, None), (5, 0.7), (5, None), (6, -3.0), (7, 16.5), (None, None)]
    for part in (0, 1):
        rows = [(k, u, v, "purchase" if k % 2 else "view") for k, (u, v) in enumerate(held) if (k >= 7) == part]
        spark.createDataFrame(rows, "event_id long, user_id long, value double, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet" / f"part={part}"))
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*/*.parquet'")
    got = catalogue.queries()["agg03_usage_by_user"](spark, str(tmp_path))
    assert {r.who: r.avg_value for r in got.collect()} == {None: 15, 1: 15, 2: 16, 3: -1, 4: None, 5: 0, 6: -3, 7: 16}
    assert rows_of(got) == expected(con, catalogue.oracles()["agg03_usage_by_user"])


def test_means_at_the_bound_are_added_up_as_the_files_hold_them(spark, tmp_path):
    lines = {1: (0.0, 0.1, 0.06, 0.08), 2: (0.0, 0.06, 0.08, 0.1)}
    for part in (0, 1):
        rows = [(k, d, 1.0, "A") for k, held in lines.items() for d in held[2 * part : 2 * part + 2]]
        spark.createDataFrame(rows, "l_orderkey long, l_discount double, l_quantity double, l_returnflag string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet" / f"part={part}"))
    orders = [(k, 3, datetime(2024, 1, 1), "1-URGENT", "F") for k in lines]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        got = {r.o_orderkey: "corroboration" in r.reasons for r in catalogue.queries()["cdc09_triggers"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {1: True, 2: False}


def test_cues_end_at_letters_that_are_not_of_ascii(spark):
    rows = [("los losesñosie", True), ("ñloses", True), ("losest", False), ("x_loses", False), ("LOSE", True), ("loſe", True), ("Key", False), ("wat\u2028maakt", False), ("wat maakt", True)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").select(F.col("t").rlike(texts.any_case(CAUSAL))).collect()]
    assert got == [w for _, w in rows]
    spaces = [("a\x0bb", False), ("a\tb", True), ("a.\u2028b", True), ("a.\nb", False)]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in spaces], "t string").select(F.col("t").rlike(texts.any_case(r"A\sB|a\..b"))).collect()] == [w for _, w in spaces]
