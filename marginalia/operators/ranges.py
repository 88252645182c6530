"""Places, running sums and carried values in an order, without bringing a key's rows to one task.

Rows are dealt by ranges of (keys, order) and written once, so a hot key spreads over many ranges. A window works inside
each range; what the ranges before it hold of the same key (a count, a sum, a last value) is added from a table with one
row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch


def dealt(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` in ranges of (keys, order), written, with the number of its range in ``_part``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.materialize(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _with_earlier(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to the ``totals`` of their key and range; null keys meet null keys."""
    told = totals.select(*(F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)), F.col("_part").alias("_p"), "_earlier")
    on = rows["_part"] == told["_p"]
    for j, k in enumerate(keys):
        on = on & rows[k].eqNullSafe(told[f"_k{j}"])
    return rows.join(scratch.maybe_broadcast(told), on)


def running(df: DataFrame, keys: list[str], order: list, name: str, value: Column | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of a key up to each row, or with its place from 1 where no value is given."""
    rows = dealt(df.withColumn("_value", F.lit(1).cast("long") if value is None else value), keys, order)
    inside = F.sum("_value").over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_part").agg(F.sum("_value").alias("_s")).withColumn("_earlier", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    return _with_earlier(rows.withColumn("_inside", inside), sums, keys).withColumn(name, F.col("_inside") + F.col("_earlier")).select(*df.columns, name)


def previous(df: DataFrame, keys: list[str], order: list, name: str, value: Column, given: Column | None = None, own: bool = False) -> DataFrame:
    """``df`` with the ``value`` of the row before each row of a key; with ``given``, of the last row for which it holds
    (the row itself counts if ``own``). Null where there is none."""
    rows = dealt(df.withColumn("_value", F.when(F.lit(True) if given is None else given, F.struct(value.alias("v")))), keys, order)
    by = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    last = F.last("_value", ignorenulls=True)
    ends = rows.where("_value IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*_reversed(order)))).where("_n = 1")
    ends = rows.select(*keys, "_part").distinct().alias("a").join(ends.select(*(F.col(k).alias(f"_e{j}") for j, k in enumerate(keys)), F.col("_part").alias("_ep"), F.col("_value").alias("_end")).alias("b"), _same(keys), "left")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_earlier", F.last("_end", ignorenulls=True).over(before))
    found = _with_earlier(rows.withColumn("_near", last.over(by)), ends, keys)
    return found.withColumn(name, F.coalesce("_near", "_earlier")["v"]).select(*df.columns, name)


def _same(keys: list[str]) -> Column:
    on = F.col("a._part") == F.col("_ep")
    for j, k in enumerate(keys):
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"_e{j}"))
    return on


def _reversed(order: list) -> list[Column]:
    """The ascending columns of ``order``, descending."""
    return [F.desc(c) if isinstance(c, str) else c.desc() for c in order]


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with the place of each row in a total order over all rows, from 1.

    The sort is by range and written once, with the range and the place in it; only the row counts of the ranges are
    added up afterwards.
    """
    rows = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.materialize(rows, "ordered").withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.join(scratch.maybe_broadcast(starts.drop("_n")), "_part").withColumn(name, F.col("_start") + within + 1).select(*df.columns, name)
