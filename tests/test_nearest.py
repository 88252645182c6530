"""The nearest rows of many queries: whole, with ties, copies and vectors that have no distance."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.operators import retrieval


def by_pairs(vectors, queries, k):
    """Every pair, row by row."""
    rows = vectors.where("embedding IS NOT NULL").crossJoin(queries)
    v, q = F.col("embedding").cast("array<double>"), F.col("q").cast("array<double>")
    norms = F.sqrt(retrieval.dot(v, v)) * F.sqrt(retrieval.dot(q, q))
    rows = rows.select("query_id", "vec_id", (F.round(F.when(norms != 0, 1 - retrieval.dot(v, q) / norms), 6) + 0.0).alias("d"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("place") <= k).select("query_id", "vec_id", "place")


def test_nearest_in_blocks_are_those_of_all_pairs(spark, monkeypatch):
    r = random.Random(6)
    monkeypatch.setattr(retrieval, "ASKED", 16)
    bases = [[r.choice([-1.0, 0.0, 0.5, r.gauss(0, 1)]) for _ in range(8)] for _ in range(60)]
    rows = [(k, [x + r.choice([0.0, 0.0, 1e-7]) for x in r.choice(bases)]) for k in range(600)]  # copies and near copies: ties when rounded
    rows += [(700, [0.0] * 8), (701, None), (702, [1.0, None] + [0.0] * 6), (703, [1.0] * 7), (704, [float("nan")] * 8), (705, [1e30] * 8), (706, [1e-30] * 8), (707, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for where, k in (("vec_id % 9 = 0", 5), ("vec_id >= 696", 4), ("vec_id < 0", 3)):
        asked = df.where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
        got = retrieval.nearest_to_each(df, asked, k)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_pairs(df, asked, k).collect()))
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()  # pairs are not compared row by row


def test_words_meet_the_forms_of_terms(spark, tmp_path):
    words = ["ring", "rings", "ringed", "ringing", "r", "red", "s", "ing", "sings", "bed", "beds", "bedding", "being", "beings", "Ä", "äs", "x"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    stems = {r.w: r.t[0] for r in df.select("w", retrieval.stemmed(F.col("w")).alias("t")).collect()}
    forms = df.select(F.explode(retrieval.stemmed(F.col("w"))).alias("term")).distinct().select("term", F.explode(retrieval.stem_forms(F.col("term"))).alias("w"))
    met = df.select(F.lower("w").alias("w")).join(forms, "w").collect()
    assert sorted((r.w, r.term) for r in met) == sorted((w.lower(), t) for w, t in stems.items())
    spark.createDataFrame([(1, "Ring bed"), (2, "xs xs")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(5, "Rings, beds; ringing"), (6, "x"), (7, None), (8, "bed")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = retrieval.text_scores(retrieval.Tables(spark, str(tmp_path)))
    assert {(r.query_id, r.doc_id): r.score for r in got.collect()} == {(2, 6): 1.0}
    taken_apart = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower().count("lambdafunction(regexp_replace")
    assert taken_apart(got) == taken_apart(retrieval.query_terms(retrieval.Tables(spark, str(tmp_path))))  # none for texts
