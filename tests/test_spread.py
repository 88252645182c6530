"""Shuffles whose tasks must not grow with the input."""

import pytest
from pyspark.sql import functions as F

from marginalia import catalogue, scratch
from marginalia.operators import linking, reports
from marginalia.sources.readers import read_json_pages

from compare import database, expected, rows_of

#: Queries that deal their rows by ``spread``, all with SQL.
SPREAD = ["agg37_dossiers", "agg37_timeline", "grf11_adjacency", "grf14_reified_rows", "join18_rules"]


def test_tasks_follow_the_rows(spark):
    small, large = (scratch.spread(spark.range(10), n, "id") for n in (scratch.SPREAD_ROWS, 50 * scratch.SPREAD_ROWS))
    assert large.rdd.getNumPartitions() == 50 and "Repartition" not in small._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", SPREAD)
def test_spread_queries_match_sql(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(scratch, "SPREAD_ROWS", 500)  # sf0.001 has six thousand lines
    df = catalogue.queries()[name](spark, sf_dir)
    assert rows_of(df) == expected(database(sf_dir), catalogue.oracles()[name])


def test_dossiers_and_timelines_of_slices(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2990, "s").alias("source"), F.lit("k").alias("kind"), (F.col("id") % 1500).alias("ref"), F.when(F.col("id") % 7 > 0, F.col("id") % 100).alias("at"))
    got = [(r.source, r.n, r["items"], r.place, r.ref, r["at"]) for r in reports.dossier(rows, 3, 3000).orderBy("source", "place").collect()]
    best = {}
    for k in range(3000):
        key = ("s" if k < 2990 else None, k % 1500)
        c, at = best.get(key, (0, None))
        best[key] = c + 1, max((x for x in (at, k % 100 if k % 7 else None) if x is not None), default=None)
    for source in ("s", None):
        mine = sorted(((at is None, -(at or 0), ref, at) for (s, ref), (c, at) in best.items() if s == source))
        n = sum(c for (s, _), (c, _) in best.items() if s == source)
        assert [g for g in got if g[0] == source] == [(source, n, len(mine), k + 1, ref, at) for k, (_, _, ref, at) in enumerate(mine[:3])]
    line = [(r.place, r.ref, r["at"]) for r in reports.timeline(rows.withColumnRenamed("kind", "ledger").where("source = 's'").distinct(), 4, 3000).orderBy("place").collect()]
    told = sorted({(-(k % 100), k % 1500) for k in range(2990) if k % 7})[:4]
    assert line == [(k + 1, ref, -at) for k, (at, ref) in enumerate(told)]


def test_dangling_edges_are_told_by_their_missing_ends(spark, sf_dir, tmp_path):
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        kept = {"customer": "c_custkey % 3 > 0", "part": "p_partkey % 5 > 0", "orders": "o_orderkey % 4 > 0", "nation": "n_nationkey <> 3"}.get(name, "true")
        rows.where(kept).write.parquet(str(tmp_path / f"{name}.parquet"))
    df = catalogue.queries()["grf01_dangling"](spark, str(tmp_path))
    got = rows_of(df)
    assert len(got[1]) > 4 and got == expected(database(str(tmp_path)), catalogue.oracles()["grf01_dangling"])
    assert "has_src" not in df._jdf.queryExecution().analyzed().toString()


def test_channels_of_many_items_of_one_name(spark, tmp_path):
    # 200,000 items of one name: a brand meets the first of them only.
    rows = spark.range(200_000).select(F.col("id").alias("p_partkey"), F.lit("red ring").alias("p_name"), F.concat(F.lit("b"), F.col("id") % 3).alias("p_brand"), (F.col("id") % 50).cast("int").alias("p_size"), (F.col("id") % 977).cast("double").alias("p_retailprice"))
    few = spark.createDataFrame([(300_000, "blue ring ring", "b1", 3, 1.0), (300_001, None, "b1", 3, 1.0), (300_002, "odd", "b9", 40, 5.0)], "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double")
    rows.unionByName(few).write.parquet(str(tmp_path / "part.parquet"))
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    df = catalogue.queries()["rag05_channels"](spark, str(tmp_path))
    assert rows_of(df) == expected(con, catalogue.oracles()["rag05_channels"])


def test_json_pages_share_files(spark, sf_dir, tmp_path):
    spark.range(1000).selectExpr("struct(id AS a, cast(NULL AS string) AS b) AS r", "id div 100 AS p").groupBy("p").agg(F.collect_list("r").alias("rows")).select("rows").coalesce(1).write.json(str(tmp_path / "pages"))
    got = read_json_pages(spark, str(tmp_path / "pages"), "a long, b string", "rows").collect()
    assert sorted(r.a for r in got) == list(range(1000)) and {r.b for r in got} == {None}
    df = catalogue.queries()["src11_json_pages"](spark, sf_dir)
    assert len(df.inputFiles()) <= 8  # one a task, not one a page


def test_all_co_occurrence_spread(spark, sf_dir, monkeypatch):
    whole = rows_of(catalogue.queries()["agg11_co_occurrence_all"](spark, sf_dir))
    monkeypatch.setattr(scratch, "SPREAD_ROWS", 500)
    df = catalogue.queries()["agg11_co_occurrence_all"](spark, sf_dir)
    assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString() and rows_of(df) == whole


def test_words_meet_surfaces_in_bounded_tasks(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the blue rings and a blu ring near riverbank"), (2, "riverbanks of the blue")], "id long, text string")
    surfaces = spark.createDataFrame([("blue ring", 1), ("riverbank", 2), ("blue", 3)], "form string, ref long")
    whole = rows_of(linking.mentions(texts, ["id"], "text", surfaces))
    monkeypatch.setattr(linking, "WORDS", 1)
    assert rows_of(linking.mentions(texts, ["id"], "text", surfaces)) == whole and any("0.6" in r or "0.7" in r or "0.8" in r for r in whole[1])
