"""The Merkle manifest against a plain tree, with odd keys and groups."""

import hashlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The top of a list of nodes, and the (before, after) steps of each of them."""
    steps, ids, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, at in enumerate(ids):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            steps[k].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        ids = [at // 8 for at in ids]
        level = [h(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], steps


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, ways = [], []
    for g in order:
        members = sorted(((r[0] is not None, r[0] or 0, leaf_of(r)), r) for r in groups[g])
        top, steps = climb([m[0][2] for m in members])
        tops.append(top)
        ways.append([(m[1][0], m[0][2], top, s) for m, s in zip(members, steps)])
    if not tops:
        return []
    root, above = climb(tops)
    return [(i, leaf, top, root, [*s, *up]) for way, up in zip(ways, above) for i, leaf, top, s in way]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, grp long, place int"


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(5, "s", "de", 1, "x")],
        [(k, "s", None, 1, "x") for k in range(9)],
        [(k * 7919 - 300_000, None if k % 5 else "é", ["de", "en", None, "fr"][min(3, k % 7)], k, "" if k % 11 == 0 else f"T{k}ÄZ") for k in range(700)],
        [(k, "s", f"l{k}", 1, None) for k in range(70)],
        [(None, "s", "de", None, f"t{k % 3}") for k in range(12)] + [(3, "s", "de", 1, "same")] * 40 + [(k, "s", "de", 1, "t" * k) for k in range(100)] + [(3, "s", "en", 1, str(k)) for k in range(30)],
        [(x, "s", "de", 1, "t") for x in (-(2**63), -1, 0, 63, 64, 2**63 - 1, 2**40, 2**18, 2**18 + 1)],
    ],
    ids=["empty", "one", "nine", "many", "groups", "repeated", "far"],
)
def test_manifest_equals_a_plain_tree(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)
    found = merkle.manifest(df, also={"n": F.col("n_chars") + 1}).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.pre, s.post) for s in r.steps]) for r in found), key=key)
    assert got == sorted(brute(rows), key=key)
    assert sorted(r.n for r in found if r.n is not None) == sorted(r[3] + 1 for r in rows if r[3] is not None)


def test_fold_gives_the_root_and_shows_changes(spark, sf_dir):
    rows = merkle.op12_merkle_manifest(spark, sf_dir).collect()
    assert {r.verified for r in rows} == {True, False} and all(r.verified == (r.folded_root == r.root) for r in rows)
