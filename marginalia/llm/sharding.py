"""Operator 4: sharding by k-d tree partitioning.

A node of the tree is split along its widest metadata dimension (its range as a share of the range over all rows) at the
weighted median of the rows' bytes, or at the quantile that gives each side as many leaves as it holds, until a leaf
holds about the target bytes. Medians are found by distributed histograms: a round counts the bytes in up to ``BINS``
equal intervals for all nodes at once and narrows each node to the interval that holds its median; only those counts
reach the driver. Rows of one coordinate are told apart by a hash of the text, of the id and last by their place, so
that equal texts stand next to each other and a large group of them is split only where balance asks for it.

Null texts have no bytes; each row counts one byte more. Null metadata sort first; of longer metadata the first six bytes
are the coordinate. Repeated rows stay separate rows, a text of any length is one row, an empty table gives an empty one,
and columns other than key, text, lang and source are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Intervals of a histogram round; the share of a leaf's bytes that a cut may be off; rows numbered in one task.
BINS, TOLERANCE, NUMBERED = 1024, 0.005, 20_000
_LEAST = -(2**63)


def text_order(column: Column) -> Column:
    """A whole number that sorts as the first six bytes of a string; null sorts first."""
    head = F.substring(F.encode(column.cast("string"), "utf-8"), 1, 6)
    return F.coalesce(F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10).cast("long"), F.lit(-1))


class Cut:
    """The search for the place that has ``wanted`` bytes of a node before it."""

    def __init__(self, columns: list[str], ranges: dict[str, tuple[int, int]], wanted: float, slack: float):
        self.columns, self.ranges, self.wanted, self.slack = columns, ranges, wanted, slack
        self.at, self.given, self.cut = 0, [], None
        self.low, self.high = ranges[columns[0]]

    @property
    def step(self) -> int:
        return -(-(self.high - self.low + 1) // BINS)

    def see(self, sums: dict[int, int]) -> None:
        """``sums``: bytes by interval, of the rows that are still open."""
        before = 0
        for k in sorted(sums):
            if before + sums[k] < self.wanted and k != max(sums):
                before += sums[k]
                continue
            start, end = self.low + k * self.step, min(self.high, self.low + (k + 1) * self.step - 1)
            if sums[k] <= self.slack:
                nearer = self.wanted - before > sums[k] / 2
                self.cut = [*self.given, end + 1 if nearer else start]
            elif start < end:
                self.low, self.high, self.wanted = start, end, self.wanted - before
            elif self.at + 1 < len(self.columns):
                self.at, self.wanted = self.at + 1, self.wanted - before
                self.given.append(start)
                self.low, self.high = self.ranges[self.columns[self.at]]
            else:
                self.cut = [*self.given, start + (self.wanted - before > sums[k] / 2)]
            return
        self.cut = [*self.given, self.low]


def _pick(names: list[str], which: str) -> Column:
    """The column that ``which`` numbers."""
    out = F.lit(None).cast("long")
    for k, n in enumerate(names):
        out = F.when(F.col(which) == k, F.col(n)).otherwise(out)
    return out


def tree(rows: DataFrame, dimensions: list[str], ties: list[str], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``rows`` with ``shard``: the leaf of each row. ``rows`` has ``size``; dimensions and ties are whole numbers."""
    spark, names = rows.sparkSession, [*dimensions, *ties]
    everything = [f(c).alias(f"{w}_{c}") for c in names for w, f in (("least", F.min), ("most", F.max))]
    whole = rows.agg(F.sum("size").alias("bytes"), *everything).first()
    if whole.bytes is None:
        return rows.withColumn("shard", F.lit(0))
    leaves = {1: shards or max(1, -(-whole.bytes // target_bytes))}
    slack = max(1.0, TOLERANCE * whole.bytes / leaves[1])
    span = {c: max(1, whole[f"most_{c}"] - whole[f"least_{c}"]) for c in dimensions}
    first: dict[int, int] = {1: 0}  # the number of a node's first leaf
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    while any(n > 1 for n in leaves.values()):
        stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *everything).collect()
        searches: dict[int, tuple[int, Cut]] = {}
        for s in stats:
            if leaves[s.node] == 1:
                continue
            widest = max(range(len(dimensions)), key=lambda k: ((s[f"most_{dimensions[k]}"] - s[f"least_{dimensions[k]}"]) / span[dimensions[k]], -k))
            ranges = {c: (s[f"least_{c}"], s[f"most_{c}"]) for c in names}
            searches[s.node] = widest, Cut([dimensions[widest], *ties], ranges, s.bytes * (leaves[s.node] // 2) / leaves[s.node], slack)
        while open_ := {n: x for n, x in searches.items() if x[1].cut is None}:
            told = [(n, w, c.at, c.low, c.high, c.step, *(c.given[k] if k < c.at else None for k in range(len(ties)))) for n, (w, c) in open_.items()]
            fields = "node long, widest int, at int, low long, high long, step long" + "".join(f", given{k} long" for k in range(len(ties)))
            joined = rows.join(F.broadcast(spark.createDataFrame(told, fields)), "node").withColumn("_first", _pick(dimensions, "widest"))
            keys = ["_first", *ties]
            inside = F.lit(True)
            for k in range(len(ties)):
                inside = inside & ((F.col("at") <= k) | (F.col(keys[k]) == F.col(f"given{k}")))
            joined = joined.withColumn("_x", _pick(keys, "at")).where(inside & F.col("_x").between(F.col("low"), F.col("high")))
            counted = joined.groupBy("node", F.expr("(_x - low) div step").alias("bin")).agg(F.sum("size").alias("bytes")).collect()
            for n, (_, c) in open_.items():
                c.see({r.bin: r.bytes for r in counted if r.node == n})
        cuts = [(n, w, *(c.cut[k] if k < len(c.cut) else _LEAST for k in range(1 + len(ties)))) for n, (w, c) in searches.items()]
        fields = "node long, widest int" + "".join(f", cut{k} long" for k in range(1 + len(ties)))
        joined = rows.join(F.broadcast(spark.createDataFrame(cuts, fields)), "node", "left").withColumn("_first", _pick(dimensions, "widest"))
        below = F.lit(False)
        for k, c in reversed(list(enumerate(["_first", *ties]))):
            below = (F.col(c) < F.col(f"cut{k}")) | ((F.col(c) == F.col(f"cut{k}")) & below)
        rows = joined.withColumn("node", F.when(F.col("cut0").isNull(), F.col("node")).otherwise(2 * F.col("node") + (~below).cast("long"))).select(*rows.columns)
        # A node without rows (its neighbour holds a row larger than a leaf) needs no further cut.
        leaves |= {n: 1 for n in leaves if n not in searches}
        for n in list(searches):
            left = leaves[n] // 2
            leaves |= {2 * n: left, 2 * n + 1: leaves[n] - left}
            first |= {2 * n: first[n], 2 * n + 1: first[n] + left}
            del leaves[n]
    numbers = spark.createDataFrame([(n, first[n]) for n in leaves], "node long, shard int")
    return rows.join(F.broadcast(numbers), "node").drop("node")


def slots(rows: DataFrame, order: list[str], n_rows: int) -> DataFrame:
    """``rows`` with ``slot``: their place in their shard, from 0 without gaps; numbered in parts that are then set one after the other."""
    parted = rows.withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n_rows // NUMBERED)))))
    local = parted.withColumn("_place", F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*order)) - 1)
    counts = parted.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    by = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = common.materialize(counts.select("shard", "_part", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("_start")), "starts")
    return local.join(common.maybe_broadcast(starts), ["shard", "_part"]).withColumn("slot", F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def shard_documents(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row of ``docs`` (key, text, lang, source)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        text_order(F.col("lang")).alias("lang"),
        text_order(F.col("source")).alias("source"),
        F.shiftrightunsigned(F.xxhash64(raw), 1).alias("print"),
        F.shiftrightunsigned(F.xxhash64(key), 1).alias("key_print"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = common.materialize(rows, "metadata")
    # Equal texts share the coordinates of the first of them, so that they stand at one place of the tree.
    # They are written first: a join with a written table can be split where one text has a third of the rows.
    told = common.materialize(rows.groupBy("print", "size").agg(F.min("lang").alias("lang"), F.min("source").alias("source")), "told")
    placed = common.materialize(rows.drop("lang", "source").join(told, ["print", "size"]), "placed")
    dealt = common.materialize(tree(placed, ["size", "lang", "source"], ["print", "key_print", "row"], shards, target_bytes), "dealt")
    return slots(dealt, ["print", "key_print", "row"], rows.count()).select(key, "size", "text_crc32", "shard", "slot")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
