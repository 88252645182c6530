"""Cheapest paths, cycles, triples and reified relations against brute force on small graphs."""

import random

import pytest

from marginalia.operators import paths


def brute_paths(ties, start, k):
    best, open_ = [], [(0.0, [start])]
    while open_:
        cost, path = open_.pop()
        for (a, b), c in ties.items():
            if a == path[-1] and b not in path:
                longer = (round(cost + c, 9), [*path, b])
                best.append(longer)
                open_.append(longer)
    return sorted(((c, p[-1], ">".join(p)) for c, p in best))[:k]


@pytest.mark.parametrize("k", [1, 7])
def test_cheapest_paths_equal_all_paths(spark, k):
    r = random.Random(k)
    ties = {(a, b): r.choice([1.0, 1.5, 2.0, 1000.0]) for a in "abcdef" for b in "abcdef" if a != b and r.random() < 0.4}
    rows = [(a, b, c) for (a, b), c in ties.items()] + [(a, b, c + 1) for (a, b), c in ties.items()] + [("a", "a", 0.1)]
    got = paths.cheapest_paths(spark.createDataFrame(rows, "src string, dst string, cost double"), spark.createDataFrame([("a",), ("f",), ("a",), ("nowhere",), (None,)], "start string"), k).collect()
    for start in ("a", "f", "nowhere"):
        assert sorted((x.cost, x.ref, ">".join(x.path)) for x in got if x.start == start) == brute_paths(ties, start, k)


def test_step_costs(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.0, 1.0), (2.0, -1.0), (None, 1.0), (1.0, 1.0)], "t double, c double")
    assert [x[0] for x in df.select(paths.step_cost(df.t, df.c)).collect()] == [4.0, 1000.0, 1000.0, 1000.0, 1.0]


@pytest.mark.parametrize("seed, share", [(1, 0.08), (2, 0.14), (3, 0.3)])
def test_cyclic_edges_are_those_that_lead_back(spark, seed, share):
    r = random.Random(seed)
    e = {(a, b) for a in range(14) for b in range(14) if r.random() < share}
    reach = set(e)
    while more := {(a, d) for a, b in reach for c, d in e if b == c} - reach:
        reach |= more
    got = paths.cyclic_edges(spark.createDataFrame([*e, *list(e)[:3]], "src long, dst long")).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == {(a, b) for a, b in e if (b, a) in reach or a == b}


def test_triples_tell_all_their_reasons(spark):
    known = spark.createDataFrame([("u", "user"), ("v", "user"), ("w", "robot"), ("p", "place")], "ref string, label string")
    shapes = spark.createDataFrame([("in", "person", "place", 1, False, True), ("under", None, None, None, True, True), ("acts", None, None, None, False, False)], "type string, domain string, range string, most int, acyclic boolean, bare boolean")
    rows = [("u", "p", "in"), ("u", "v", "in"), ("w", "p", "in"), ("u", "v", "under"), ("v", "u", "under"), ("u", "p", "under"), ("w", "w", "under"), ("u", "x", "acts"), ("y", "p", "new"), ("u", "p", "in")]
    found = paths.violations(spark.createDataFrame(rows, "src string, dst string, type string"), known, shapes, spark.createDataFrame([("user", "person")], "label string, ancestor string")).collect()
    assert {(r.src, r.dst, r.type): list(r.reasons) for r in found} == {
        ("u", "p", "in"): [], ("u", "v", "in"): ["cardinality", "range"], ("w", "p", "in"): ["domain"], ("u", "v", "under"): ["cycle"], ("v", "u", "under"): ["cycle"],
        ("u", "p", "under"): [], ("w", "w", "under"): ["cycle"], ("u", "x", "acts"): ["must_reify", "unknown_object"], ("y", "p", "new"): ["unknown_relation", "unknown_subject"],
    }


def test_reified_rows_flatten_only_single_conditions(spark):
    relations = spark.createDataFrame([(1, " Counters", "verified", "a", "b", "s1"), (2, "counters", "candidate", "a", "c", " "), (3, "counters", "rejected", "a", "d", "s2"), (4, "boosts", "promoted", "a", "e", None), (5, "boosts", "promoted", "a", "f", None)], "ref long, kind string, status string, agent string, patient string, governed_by string")
    conditions = spark.createDataFrame([(1, "Window", "agent", "w1"), (1, "cost", "agent", "-1"), (3, "window", "agent", "w"), (4, "window", "agent", "w1"), (4, "window", "agent", "w2"), (5, "status", "patient", "tired"), (9, "cost", "agent", "1")], "ref long, axis string, role string, value string")
    rows = paths.reified_rows(relations, conditions).collect()
    assert {(r.ref, r.target, r.value) for r in rows if r.element == "cache"} == {(1, "b", "counters;window=w1;cost=-1;tier=1"), (4, "e", "boosts;tier=1;reified"), (5, "f", "boosts;status=tired;tier=1;reified")}
    assert {(r.ref, r.part, r.value) for r in rows if r.element == "node"} == {(1, "COUNTERS", "verified"), (2, "COUNTERS", "candidate"), (4, "BOOSTS", "promoted"), (5, "BOOSTS", "promoted")}
    assert sum(r.element == "role" for r in rows) == 8 and sum(r.element == "condition" for r in rows) == 5 and [r.target for r in rows if r.element == "governed_by"] == ["s1"]


def test_long_chains_and_rings_cost_few_rounds(spark, monkeypatch):
    chain = [(f"c{k}", f"c{k + 1}") for k in range(200)]
    ring = [(f"r{k}", f"r{(k + 1) % 151}") for k in range(151)]
    joined = [(f"j{k}", f"j{k + 1}") for k in range(60)] + [("j60", "j0"), ("j20", "x"), ("x", "j40"), ("x", "y"), ("y", "y"), ("c200", "r0"), ("j5", "c0")]
    written = []
    kept = paths.scratch.materialize
    monkeypatch.setattr(paths.scratch, "materialize", lambda df, label: written.append(label) or kept(df, label))
    got = {tuple(r) for r in paths.cyclic_edges(spark.createDataFrame(chain + ring + joined, "src string, dst string")).collect()}
    assert got == set(ring) | {(s, d) for s, d in joined if s[0] in "jx" and d[0] in "jx"} | {("y", "y")}
    assert len(written) < 70
