"""Bundles, backfill, layers, channels and mentions against brute force or by hand."""

import random

from pyspark.sql import functions as F

from marginalia.operators import bundles


def grams(text):
    clean = " ".join((text or "").lower().split())
    return {clean[k : k + 3] for k in range(len(clean) - 2)}


def alike(a, b):
    a, b = grams(a), grams(b)
    return round(len(a & b) / len(a | b), 9) if a and b else 0.0


def brute(items, texts, budget):
    """items (item, tier, score) of one query."""
    out, used, cut = [], 0, False
    for tier in sorted({t for _, t, _ in items}):
        left, taken = [x for x in items if x[1] == tier], []
        while left:
            best = min(left, key=lambda x: (-round(0.7 * x[2] - 0.3 * max((alike(texts[x[0]], texts[y]) for y in taken), default=0.0), 9), x[0]))
            left.remove(best)
            taken.append(best[0])
            cost = (len(texts[best[0]] or "") + 3) // 4
            if not cut and (used + cost <= budget or not out):
                out.append((len(out) + 1, best[0], tier))
                used += cost
            cut = cut or used > budget or out[-1][1] != best[0]
    return out


def test_bundles_equal_brute_force(spark):
    r = random.Random(5)
    words = ["alpha ", "beta\n", "gamma  ", "délta ", "EPSILON "]
    texts = {k: "".join(r.choice(words) for _ in range(r.randrange(1, 60))) for k in range(40)} | {40: None, 41: "", 42: "ab", 43: "x" * 9000, 44: "alpha " * 30, 45: "alpha " * 30}
    found = {q: [(k, r.randrange(1, 4), round(r.random(), 2)) for k in r.sample(sorted(texts), 12)] for q in range(12)} | {90: [(43, 1, 1.0), (0, 1, 0.9)], 91: [(44, 2, 0.5), (45, 2, 0.5), (41, 1, 0.0), (40, 1, 0.0)]}
    rows = spark.createDataFrame([(q, *x) for q, items in found.items() for x in items], "query_id long, item long, tier int, score double")
    got = bundles.bundles(rows, spark.createDataFrame([*texts.items()], "item long, text string"), 150).collect()
    for q, items in found.items():
        assert sorted((x.number, x.item, x.tier) for x in got if x.query_id == q) == brute(items, texts, 150), q
    assert {x.used for x in got if x.query_id == 90} == {2250}


def test_backfill_takes_the_nearest_ancestor_and_the_source_of_the_context(spark):
    chunks = spark.createDataFrame([("a", "811", 5), ("b", "811", 1), ("c", "811", 0), ("b", "466.2.c", 3), ("b", "7", 9), ("c", "7", 2), ("c", "7", 1), ("a", None, 0)] + [("c", f"90{k}", k) for k in range(8)], "source string, code string, chunk_index long")
    tiers = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "source string, tier int")
    context = spark.createDataFrame(
        [(1, 0, "see § 811.1 and §466.2c, §12", "a", "3"), (1, 1, "§811 §7", None, None), (2, 0, "§466.2.c", "b", "466.2.c"), (3, 0, " ".join(f"§90{k}" for k in (7, 6, 5, 4, 3, 2, 1, 0)), None, None), (4, 0, None, None, None), (5, 0, "§7.3.a §7", "b", None)],
        "query_id long, place long, text string, source string, code string",
    )
    got = sorted(map(tuple, bundles.backfilled(context, chunks, tiers).collect()))
    assert got == [(1, 1, "811", "a", 5), (1, 2, "466.2.c", "b", 3), (1, 3, "7", "c", 1)] + [(3, k + 1, f"90{7 - k}", "c", 7 - k) for k in range(6)] + [(5, 1, "7", "b", 9)]


def test_mentions_drop_contained_names(spark):
    rows = [(1, "Jinx"), (1, "jinx, Loose Cannon"), (1, "JINX"), (2, "Vi"), (2, "Viktor"), (2, "Lux"), (3, " "), (3, None), (None, "Ahri"), (4, "ana"), (4, "banana")]
    got = {r.k: r.mentions for r in bundles.distinct_mentions(spark.createDataFrame(rows, "k long, name string"), "k", "name").collect()}
    assert got == {1: 1, 2: 2, None: 1, 4: 1}


def test_channels_keep_their_caps_and_order(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "query_id long, pos long, item long")
    got = bundles.merged_channels([(frame((1, 2, 10), (1, 1, 11), (1, 3, 12)), 2), (frame((1, 1, 11), (1, 2, 13), (1, 3, 14), (2, 1, 9)), 2), (frame((1, 1, 20), (1, 2, 21)), 8)], 4).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 11, 1), (1, 2, 10, 1), (1, 3, 13, 2), (1, 4, 20, 3), (2, 1, 9, 2)]


def test_escalation_rules(spark):
    df = spark.createDataFrame([("ruling", 2, False, "auto", False), ("ruling", 1, False, "auto", False), ("ruling", 1, True, "auto", False), ("list", 5, False, "auto", False), ("list", 0, False, "force", False), ("ruling", 9, True, "force", True), ("ruling", 9, True, "off", False)], "k string, n int, e boolean, m string, i boolean")
    assert [r[0] for r in df.select(bundles.escalates(df.k, df.n, df.e, df.m, df.i)).collect()] == [True, False, True, False, True, False, False]


def test_trigrams_of_long_texts_are_whole(spark):
    text = "ab c" * 40_000 + "zzz"
    assert set(spark.createDataFrame([(text,)], "t string").select(bundles.text_trigrams(F.col("t")).alias("g")).first().g) == grams(text)
