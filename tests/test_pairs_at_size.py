"""Joins of rows that many others resemble: they must not list what the result doesn't need."""

import random

import duckdb

from pyspark.sql import functions as F

from marginalia import catalogue
from marginalia.operators import bundles, joins, pairs

from compare import expected, rows_of


def test_first_pairs_come_from_blocks_of_smaller_ids(spark):
    r = random.Random(5)
    for ids, n in ((300, 200), (40, 1000), (0, 5)):
        words = {k: set(r.sample("abcdefgh", 3)) for k in range(-20, ids - 20)}
        rows = [(k, w) for k, held in words.items() for w in held] + [(None, "a")]
        fit = sorted((a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= 2 and (a % 2 == 0 and b % 3 == 0 or a % 3 == 0 and b % 2 == 0))
        got = joins.first_told(spark.createDataFrame(rows, "p_partkey long, word string"), n).collect()
        assert sorted((x.a, x.b) for x in got) == fit[:n]


def test_sections_of_a_code_that_all_sources_have(spark):
    # 3,000 queries and 30,000 chunks of one code: no join of 90 million rows.
    context = spark.range(3000).select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("place"), F.lit("see §1.1").alias("text"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.lit("9").alias("code"))
    chunks = spark.range(30_000).select(F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.lit("1.1").alias("code"), (F.col("id") + 1).cast("int").alias("chunk_index"))
    made = bundles.backfilled(context, chunks, spark.createDataFrame([("s3", 1), ("s4", 2)], "source string, tier int"))
    got = {(r.query_id % 7, r.source, r.chunk_index) for r in made.collect()}
    assert got == {(0, "s0", 1), (1, "s1", 2), (2, "s2", 3), (3, "s3", 4), (4, "s4", 5), (5, "s3", 4), (6, "s3", 4)}


def test_lift_counts_hypotheses_without_listing_them(spark, tmp_path):
    # 100,000 items of one name and type: five thousand million pairs.
    spark.range(100_000).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_name"), F.lit("t").alias("p_type")).unionByName(spark.createDataFrame([(200_000, "y", "t")], "p_partkey long, p_name string, p_type string")).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, 3), (1, 5), (1, 5), (2, 5), (2, 3), (3, 3), (3, 200_000), (4, 1), (4, 999_999)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalogue.queries()["agg35_lift"](spark, str(tmp_path)).first()
    assert (got.hypotheses, got.hits, got.blind) == (100_000 * 99_999 // 2, 1, 100_001 * 100_000 // 2)
    assert abs(got.base_rate - 3 / got.blind) < 1e-8


def test_names_are_compared_once_for_all_rows(spark, tmp_path):
    spark.createDataFrame([(1, "Large Ring", "A"), (2, "large ring", "A"), (3, "large rings", "A"), (4, "large ring", "B"), (5, "large bolt", "A"), (6, None, "A"), (7, "large ring", None)], "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    df = catalogue.queries()["ent03_resolution"](spark, str(tmp_path))
    got = {(r.a, r.b): r.verdict for r in df.collect()}
    assert got[1, 2] == "auto" and {(1, 3), (2, 3)} <= set(got) and all(a in (1, 2, 3, 5) and b in (1, 2, 3, 5) for a, b in got)
    assert "array_intersect" not in df._jdf.queryExecution().optimizedPlan().toString()


_ITEMS = [(1, "Large Ring", "A", 3), (2, "ring large", "A", 3), (3, "large bolt", "A", 3), (4, "hot bolt", "B", 3), (5, None, "A", 3), (6, "large ring", "A", 4), (7, "large ring", None, 3), (8, "Large ring", "A", None), (None, "large ring", "A", 3), (3, "large nut", "A", 3), (9, "Large", "A", 3)]


def _database(folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    return con


def _part(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_every_pair_of_a_block_is_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "CELL_KEYS", 7)  # several cells a block
    folder = _part(spark, tmp_path, _ITEMS + [(k, "blue ring", "C", 9) for k in range(1000, 1060)] + [(1005, "blue", "C", 9)])
    got = catalogue.queries()["join15_blocked_pairs"](spark, folder)
    assert rows_of(got) == expected(_database(folder), catalogue.oracles()["join15_blocked_pairs"])
    assert got.columns == ["a", "b"] and got.where("a >= 1000").count() == 60 * 59 // 2 + 59


def test_blocked_pairs_are_told_by_classes(spark, tmp_path):
    # 100,000 rows of one block: five thousand million pairs, not one of which is listed.
    folder = _part(spark, tmp_path, _ITEMS + [(k, "blue ring", "C", 9) for k in range(1000, 101_000)])
    assert rows_of(catalogue.queries()["join15_block_classes"](spark, folder)) == expected(_database(folder), catalogue.oracles()["join15_block_classes"])
    got = catalogue.queries()["join15_block_classes"](spark, folder).collect()
    assert len(got) == len(_ITEMS) + 100_000 and {(r["class"], r.links) for r in got if (r.p_partkey or 0) >= 1000} == {(1000, 99_999)}
    small = [(r.p_partkey, r["class"], r.links) for r in got if (r.p_partkey or 0) < 1000]
    blocks = [(k, n and n[:4], z) for k, n, _, z in _ITEMS]
    pairs = [(a, b) for a, x, s in blocks for b, y, z in blocks if None not in (a, b, x, y, s, z) and a < b and (x, s) == (y, z)]
    assert sum(n for *_, n in small) == 2 * len(pairs)
    assert all({c for k, c, _ in small if k == a} & {c for k, c, _ in small if k == b} for a, b in pairs)


def test_shared_words_of_every_pair_are_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "CELL_KEYS", 7)  # several cells a class
    rows = [(k, ("blue ring", "ring hot", None, "ring Ring", " hot")[k % 5], "C", 9) for k in range(1000, 1060)]
    folder = _part(spark, tmp_path, _ITEMS + rows + [(1005, "blue", "C", 9)])
    got = catalogue.queries()["set04_shared_tokens"](spark, folder)
    assert rows_of(got) == expected(_database(folder), catalogue.oracles()["set04_shared_tokens"])
    assert got.columns == ["a", "b", "shared"] and got.where("a >= 1000").count() == 60 * 59 // 2 + 59
    assert [tuple(r.shared) for r in got.where("a = 1 AND b IN (2, 5)").orderBy("b").collect()] == [("large", "ring"), ()]


def test_shared_tokens_are_told_by_classes(spark, tmp_path):
    # 100,000 items of one brand, size and name beside one of another name.
    folder = _part(spark, tmp_path, _ITEMS + [(k, "blue ring", "C", 9) for k in range(1000, 101_000)] + [(500, "ring hot", "C", 9)])
    got = catalogue.queries()["set04_class_tokens"](spark, folder).collect()
    member = {(r.b, tuple(r.shared) if r.shared else None): r.a for r in got if r.kind == "member"}
    pairs = {(r.a, r.b, tuple(r.shared) if r.shared is not None else None) for r in got if r.kind == "pair"}
    assert len(member) == len(_ITEMS) + 100_001 and (500, 1000, ("ring",)) in pairs and len([r for r in got if r.kind == "pair"]) < 20
    # Every pair of the items, worked out one by one, is found by the classes.
    words = lambda n: tuple(sorted(set(n.lower().split()))) if n else None
    for a, x, brand, size in _ITEMS:
        for b, y, other, z in _ITEMS:
            if None in (a, b, brand, size, other, z) or not a < b or (brand, size) != (other, z):
                continue
            ca, cb = member[a, words(x)], member[b, words(y)]
            common = tuple(sorted(set(words(x)) & set(words(y)))) if x and y else None
            assert words(x) == words(y) == common if ca == cb and words(x) == words(y) else (min(ca, cb), max(ca, cb), common) in pairs
    assert rows_of(catalogue.queries()["set04_class_tokens"](spark, folder)) == expected(_database(folder), catalogue.oracles()["set04_class_tokens"])
