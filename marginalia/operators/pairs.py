"""All pairs of the rows of a block, listed by tiles of bounded size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch

#: Keys of a cell. A tile is the pairs of two cells; a task holds one tile at once.
CELL_KEYS = 256
#: Pairs that a task lists.
TASK_PAIRS = 20_000_000


def block_pairs(rows: DataFrame, key: str, by: list[str], kind: list[str], told: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """(a, b, *told): every two ``rows`` of equal ``by`` whose ``key`` differs, the smaller key first, with what ``told`` says of the ``kind`` (structs) of a and b.

    Rows without a key or with a null in ``by`` have no pair. The keys of a block and kind are dealt to cells of about ``CELL_KEYS``; two cells make a tile, for
    which ``told`` is worked out once. Tiles are dealt evenly to tasks, so neither a block nor a kind with very many rows is ever held whole.
    """
    block, of = [f"_{j}" for j in range(len(by))], F.struct(F.lit(0).alias("_"), *kind)
    rows = rows.dropna(subset=[key, *by]).select(*(F.col(c).alias(x) for c, x in zip(by, block)), of.alias("kind"), F.col(key).alias("key"))
    counts = scratch.materialize(rows.groupBy(*block, "kind").agg(F.count("*").alias("n")), "counts")
    dealt = rows.join(counts, [*block, "kind"]).withColumn("cell", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / CELL_KEYS)))
    cells = dealt.groupBy(*block, "kind", "cell").agg(F.collect_list("key").alias("keys"))
    cells = scratch.materialize(cells.select(*block, F.struct("kind", "cell").alias("place"), "keys"), "cells")
    side = lambda x: cells.select(*block, F.col("place").alias(f"place_{x}"), F.col("keys").alias(f"keys_{x}"))
    pairs = counts.groupBy(*block).agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / 2).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / TASK_PAIRS) + 1)
    tiles = side("x").join(side("y"), block).where("place_x <= place_y").repartition(tasks, *block, "place_x", "place_y")
    ways = {n: (f(F.col("place_x.kind"), F.col("place_y.kind")), f(F.col("place_y.kind"), F.col("place_x.kind"))) for n, f in told.items()}
    tiles = tiles.select((F.col("place_x") == F.col("place_y")).alias("own"), "keys_x", "keys_y", *(c.alias(f"{n}_{j}") for n, both in ways.items() for j, c in enumerate(both)))
    listed = tiles.withColumn("x", F.explode("keys_x")).drop("keys_x").withColumn("y", F.explode("keys_y")).where("x < y OR NOT own AND x > y")
    first = F.col("x") < F.col("y")
    return listed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *(F.when(first, F.col(f"{n}_0")).otherwise(F.col(f"{n}_1")).alias(n) for n in told))
