"""Merges, appends and frames that are replaced together, written and read back."""

import os

import pytest

from marginalia.operators import merges, sinks
from marginalia.operators.sinks import FrameSet, ParquetTable


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_upsert_keeps_columns_that_the_news_lacks(spark, tmp_path):
    table = ParquetTable(spark, str(tmp_path / "t"))
    table.upsert(spark.createDataFrame([(1, "a", 7), (None, "n", 8)], "k long, x string, y long"), ["k"])
    table.upsert(spark.createDataFrame([(1, "b", 0.5), (None, None, 1.5), (2, "c", 2.5)], "k long, x string, z double"), ["k"])
    assert rows(table.read(), "k", "x", "y", "z") == sorted([(1, "b", 7, 0.5), (None, "n", 8, 1.5), (2, "c", None, 2.5)], key=repr)


@pytest.mark.parametrize("first", [True, False])
def test_upsert_refuses_repeated_keys_and_leaves_the_table(spark, tmp_path, first):
    table = ParquetTable(spark, str(tmp_path / "t"))
    if not first:
        table.upsert(spark.createDataFrame([(1, "a")], "k long, x string"), ["k"])
    with pytest.raises(Exception, match="repeated key"):
        table.upsert(spark.createDataFrame([(1, "b"), (1, "c")], "k long, x string"), ["k"])
    assert (table.read() is None) if first else rows(table.read(), "k", "x") == [(1, "a")]


def test_append_writes_its_own_rows_only(spark, tmp_path):
    table = ParquetTable(spark, str(tmp_path / "t"))
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path) for f in names if f.startswith("part-")}
    table.append(spark.range(1000).selectExpr("id", "id * 2 AS x"))
    before = files()
    table.append(spark.range(1000, 1003).selectExpr("id * 2 AS x", "id"))
    after = files()
    assert before.items() <= after.items() and sum(os.stat(f).st_size for f in after.keys() - before.keys()) < sum(os.stat(f).st_size for f in before)
    assert table.read().count() == 1003 and table.read().where("x = id * 2").count() == 1003
    with pytest.raises(ValueError, match="takes no rows"):
        table.append(spark.range(1))


def test_a_writer_that_dies_leaves_the_old_pair(spark, tmp_path):
    graph = FrameSet(spark, str(tmp_path / "g"))
    nodes = lambda *r: spark.createDataFrame([(x, x) for x in r], "ref string, label string")
    edges = lambda *r: spark.createDataFrame([(a, b, "t") for a, b in r], "src string, dst string, type string")
    sinks.rebuild_graph(graph, nodes("a", "b"), edges(("a", "b"), ("a", "x")))
    broken = edges(("a", "c")).selectExpr("src", "dst", "raise_error('dies') AS type")
    with pytest.raises(Exception, match="dies"):
        sinks.rebuild_graph(graph, nodes("a", "c"), broken)
    assert rows(graph.read("nodes"), "ref") == [("a",), ("b",)] and rows(graph.read("edges"), "src", "dst") == [("a", "b")]
    sinks.rebuild_graph(graph, nodes("a", "c"), edges(("a", "c")))
    assert rows(graph.read("nodes"), "ref") == [("a",), ("c",)] and rows(graph.read("edges"), "src", "dst") == [("a", "c")]


def test_reconcile_keeps_inserts_deletes_and_spares_failed_sources(spark, tmp_path):
    old = spark.createDataFrame([("s", "a", 1, 10), ("s", "b", 1, 11), ("s", "c", 1, 12), ("failed", "a", 1, 13), ("gone", "a", 1, 14), (None, "a", 1, 15)], "source string, k string, m long, seen long")
    new = spark.createDataFrame([("s", "a", 2, 20), ("s", "b", 1, 21), ("s", "d", 5, 22), ("s", "d", 4, 23)], "source string, k string, m long, seen long")
    active = spark.createDataFrame([("s",), ("failed",), ("s",)], "source string")
    table, log = ParquetTable(spark, str(tmp_path / "t")), ParquetTable(spark, str(tmp_path / "l"))
    table.replace(old)
    plan = merges.carry_out(merges.reconcile(table.read(), new, "source", ["k"], ["m"], active), table, log, "r1")
    assert rows(plan, "source", "k", "action") == sorted([("s", "a", "update"), ("s", "b", "keep"), ("s", "c", "delete"), ("s", "d", "insert"), ("failed", "a", "keep"), ("gone", "a", "orphan"), (None, "a", "orphan")], key=repr)
    assert rows(table.read(), "source", "k", "m", "seen") == sorted([("s", "a", 2, 10), ("s", "b", 1, 11), ("s", "d", 4, 23), ("failed", "a", 1, 13)], key=repr)
    assert rows(log.read(), "k", "action", "run") == [("a", "orphan", "r1"), ("a", "orphan", "r1"), ("c", "delete", "r1")]


def test_monotone_never_demotes_and_tombstones_block(spark, tmp_path):
    kinds = "a string, b string, kind string, status string"
    old = spark.createDataFrame([("x", "y", "k1", "promoted"), ("x", "y", "k2", "candidate"), ("x", "z", "k1", "candidate"), ("p", "q", "k1", "candidate"), ("p", "q", "k9", "verified")], kinds)
    new = spark.createDataFrame([("x", "y", "k1", "candidate"), ("x", "y", "k2", "rejected"), ("x", "z", "k1", "promoted"), ("p", "q", "k1", "promoted"), ("n", "n", "k1", "candidate"), ("n", "m", "k1", "candidate"), ("n", "m", "k3", "candidate")], kinds)
    dead = spark.createDataFrame([("p", "q", "k1"), ("n", "m", "k1")], "a string, b string, kind string")
    table, log = ParquetTable(spark, str(tmp_path / "t")), ParquetTable(spark, str(tmp_path / "l"))
    table.replace(old)
    plan = merges.monotone(table.read(), new, ["a", "b"], "kind", "status", merges.STRENGTH, dead, merges.OPEN)
    plan = merges.carry_out(plan, table, log)
    got = {(r.a, r.b, r.kind): (r.action, r.switched_from) for r in plan.collect()}
    assert got == {
        ("x", "y", "k1"): ("held", "k2"), ("x", "y", "k2"): ("update", None), ("x", "z", "k1"): ("update", None), ("p", "q", "k1"): ("blocked", None),
        ("p", "q", "k9"): ("keep", None), ("n", "n", "k1"): ("insert", None), ("n", "m", "k1"): ("none", None), ("n", "m", "k3"): ("insert", "k1"),
    }
    assert rows(table.read(), "a", "b", "kind", "status") == [("n", "m", "k3", "candidate"), ("n", "n", "k1", "candidate"), ("p", "q", "k1", "candidate"), ("p", "q", "k9", "verified"), ("x", "y", "k1", "promoted"), ("x", "y", "k2", "rejected"), ("x", "z", "k1", "promoted")]
    assert rows(log.read(), "a", "b", "action", "proposed") == [("n", "m", "none", "candidate"), ("p", "q", "blocked", "promoted"), ("x", "y", "held", "candidate")]
