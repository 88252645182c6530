"""Intermediate tables in the folder that the cluster shares, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a side that a join broadcasts at most, as counted from its values.
BROADCAST_BYTES = 12_000_000
#: Rows that ``spread`` gives a task.
SPREAD_ROWS = 500_000


def folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; on one machine without it, a temporary folder. A cluster has to name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='marginalia-')}"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut, and any executor can read it."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes what ``materialize`` wrote for ``frames``; nothing may read them, or frames derived from them, any more."""
    for df in frames:
        if path := getattr(df, "scratch_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def collect_garbage(spark: SparkSession) -> None:
    """Lets the driver drop finished plans, so that Spark's cleaner removes their shuffle files before a long job ends."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _width(column: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = _fixed(kind.elementType)
        if each is None:
            return F.coalesce(F.aggregate(column, F.lit(16), lambda n, x: n + _width(x, kind.elementType).cast("int")), F.lit(16))
        return F.coalesce(F.size(column), F.lit(0)) * each + 24
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def _fixed(kind: T.DataType) -> int | None:
    """The bytes of a kind of value that always takes as many, or None."""
    if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
        return None
    if isinstance(kind, T.StructType):
        parts = [_fixed(f.dataType) for f in kind.fields]
        return None if None in parts else 16 + sum(parts)
    return 8


def within(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the values of ``df`` take at most ``most`` bytes; looks at no more rows than could."""
    each = [_width(df[f"`{f.name}`"], f.dataType) for f in df.schema]
    rows = most // (8 * max(1, len(each))) + 1
    if df.limit(rows + 1).count() > rows:
        return False
    return (df.agg(F.sum(sum(each, F.lit(8)))).first()[0] or 0) <= most


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for a broadcast if its values stay within ``most`` bytes, else as it is (a shuffle join then)."""
    return F.broadcast(df) if within(df, most) else df


def spread(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` to so many tasks that each holds about ``SPREAD_ROWS``, however large the input is.

    Where the session's shuffle partitions suffice, ``df`` is left as it is. Joins and groups by these keys need no other shuffle if
    all their sides are spread for the same ``rows``.
    """
    n = -(-rows // SPREAD_ROWS)
    return df if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, *keys)
