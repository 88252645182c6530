"""Sinks that write Parquet tables: upsert, append, partition overwrite, guarded replacement, and nodes with edges.

A table is a folder of versions ``v-N``; the newest one that was written to its end counts. A writer makes the next
version and then leaves out the one before the last, so readers of the newest see it whole, and a writer that dies
leaves the table as it was. An append adds files to the newest version and rewrites nothing. Frames that belong together
(nodes and edges) are folders of one version, which counts once its last file, a marker, is there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..registry import Tables, query
from .graph import _EDGES, _NODES, edges, nodes
from .merges import column_merge, once


class ParquetTable:
    """A table of versions in ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._at, self._fs = spark._jvm.org.apache.hadoop.fs.Path, where.getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        where = self._at(self.path)
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        """The newest version, or None where nothing was written yet."""
        found = self._versions()
        return self.spark.read.parquet(f"{self.path}/v-{found[-1]}") if found else None

    def replace(self, df: DataFrame) -> None:
        """``df`` becomes the whole table; it may read the table itself."""
        found = self._versions()
        df.write.mode("overwrite").parquet(f"{self.path}/v-{found[-1] + 1 if found else 0}")
        for old in found[:-1]:
            self._fs.delete(self._at(f"{self.path}/v-{old}"), True)

    def replace_unless_empty(self, df: DataFrame) -> bool:
        """A full replacement, unless an extraction gave nothing: then the old rows stay."""
        fresh = scratch.materialize(df, "extracted")
        if fresh.isEmpty():
            return False
        self.replace(fresh)
        return True

    def append(self, df: DataFrame) -> None:
        """Adds the rows of ``df`` and writes nothing else. Its columns have to be those of the table."""
        found = self._versions()
        if not found:
            return self.replace(df)
        newest = f"{self.path}/v-{found[-1]}"
        names = self.spark.read.parquet(newest).columns
        if sorted(names) != sorted(df.columns):
            raise ValueError(f"a table of {names} takes no rows of {df.columns}")
        df.select(names).write.mode("append").parquet(newest)

    def upsert(self, df: DataFrame, keys: list[str]) -> None:
        """Rows of new keys are added; on known keys a value wins where it isn't null. Columns of both sides stay; a repeated key is an error."""
        old = self.read()
        self.replace(once(df, keys) if old is None else column_merge(old, df, keys).drop("action"))

    def update(self, where: Column, **values: Column) -> None:
        """Sets columns of the rows that ``where`` holds for."""
        hit, rows = F.coalesce(where, F.lit(False)), self.read()
        self.replace(rows.select(*(F.when(hit, values[c]).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in values else F.col(c) for c in rows.columns)))

    def delete(self, where: Column) -> None:
        """Rows that ``where`` holds for go; rows it is null for stay."""
        self.replace(self.read().where(~F.coalesce(where, F.lit(False))))


class FrameSet:
    """Frames that are replaced together: ``path/v-N/<name>``, a version being whole once ``v-N/_SUCCESS`` is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = ParquetTable(spark, path)
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame | None:
        """A frame of the newest whole version, or None where none was written."""
        found = self.table._versions()
        return self.spark.read.parquet(f"{self.path}/v-{found[-1]}/{name}") if found else None

    def replace(self, **frames: DataFrame) -> None:
        """All frames at once: readers see the old ones until the last file of the new ones is there. They may read the old ones."""
        found, fs, at = self.table._versions(), self.table._fs, self.table._at
        folder = f"{self.path}/v-{found[-1] + 1 if found else 0}"
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        fs.create(at(f"{folder}/_SUCCESS")).close()
        for old in found[:-1]:
            fs.delete(at(f"{self.path}/v-{old}"), True)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """The partitions of ``df`` replace those of the table in ``path``; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _fitting(all_edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes, each once."""
    known = all_nodes.select("ref")
    return all_edges.join(known.withColumnRenamed("ref", "src"), "src", "left_semi").join(known.withColumnRenamed("ref", "dst"), "dst", "left_semi").select(all_edges.columns).distinct()


def write_graph(graph: FrameSet, new_nodes: DataFrame, new_edges: DataFrame) -> None:
    """Nodes are merged by ref, edges by both ends and type; edges whose ends are no nodes aren't written."""
    old, fresh = graph.read("nodes"), once(new_nodes, ["ref"], [c for c in new_nodes.columns if c != "ref"])
    merged = scratch.materialize(fresh if old is None else column_merge(old, fresh, ["ref"]).drop("action"), "nodes")
    fit = _fitting(new_edges, merged)
    graph.replace(nodes=merged, edges=fit if old is None else graph.read("edges").unionByName(fit).distinct())


def rebuild_graph(graph: FrameSet, all_nodes: DataFrame, all_edges: DataFrame) -> None:
    """A projection from scratch: what isn't in it any more is gone, nodes and edges in one step; edges need both ends."""
    all_nodes = scratch.materialize(all_nodes, "nodes")
    graph.replace(nodes=all_nodes, edges=_fitting(all_edges, all_nodes))


def _path(t: Tables, name: str) -> str:
    return f"{scratch.folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def new_table(t: Tables, name: str) -> ParquetTable:
    """An empty table in the shared folder."""
    return ParquetTable(t.spark, _path(t, name))


@query("src01_scan", "SELECT * FROM nation")
def scan(t: Tables) -> DataFrame:
    return t.nation


@query("snk02_written_upsert", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 < 2 THEN p_size + 100 ELSE p_size END AS size, p_brand AS brand FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_size + 100, NULL FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 1")
def written_upsert(t: Tables) -> DataFrame:
    """Two thirds of a table are written, two thirds come as news: the table is read back."""
    p, table = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand")), new_table(t, "upsert")
    table.replace(p.where("k % 3 > 0"))
    table.upsert(p.where("k % 3 < 2").select("k", (F.col("size") + 100).alias("size"), F.when(F.col("k") % 2 == 0, F.col("brand")).alias("brand")), ["k"])
    return table.read()


@query("snk03_written_partitions", "SELECT doc_id, lang, 'old' AS origin FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id + 1000000, lang, 'new' FROM documents WHERE lang = 'fr' AND n_chars > 100")
def written_partitions(t: Tables) -> DataFrame:
    path = new_table(t, "partitions").path
    overwrite_partitions(t.documents.where("lang IS NOT NULL").select("doc_id", "lang", F.lit("old").alias("origin")), path, "lang")
    overwrite_partitions(t.documents.where("lang = 'fr' AND n_chars > 100").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "lang", F.lit("new").alias("origin")), path, "lang")
    return t.spark.read.parquet(path).select("doc_id", "lang", "origin")


@query("snk05_written_purge", "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND value > 50)")
def written_purge(t: Tables) -> DataFrame:
    table = new_table(t, "purge")
    table.replace(t.events.select("event_id", "event_type", "value"))
    table.delete((F.col("event_type") == "error") & (F.col("value") > 50))
    return table.read().select("event_id")


@query("snk04_written_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'held' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def written_update(t: Tables) -> DataFrame:
    table = new_table(t, "update")
    table.replace(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"))
    table.update((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200_000), o_orderpriority=F.lit("held"), o_totalprice=F.lit(0.0))
    return table.read().drop("o_orderstatus")


@query("snk07_guarded_replace", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def guarded_replace(t: Tables) -> DataFrame:
    """An empty extraction keeps the old rows, a full one takes their place."""
    table, rows = new_table(t, "guarded"), t.orders.select("o_orderkey", "o_orderstatus")
    table.replace(rows.where("o_orderstatus = 'O'"))
    table.replace_unless_empty(rows.where("o_orderstatus = 'F'"))
    table.replace_unless_empty(rows.where("o_orderstatus = 'no such status'"))
    return table.read()


@query("snk09_ledger", "SELECT event_id, user_id FROM events WHERE event_type = 'login' UNION ALL SELECT event_id, user_id FROM events WHERE event_type <> 'login' AND value > 80")
def ledger(t: Tables) -> DataFrame:
    table = new_table(t, "ledger")
    table.append(t.events.where("event_type = 'login'").select("event_id", "user_id"))
    table.append(t.events.where("event_type <> 'login' AND value > 80").select("event_id", "user_id"))
    return table.read()


@query("snk10_graph_sink", f"WITH {_NODES}, {_EDGES} SELECT e.src, e.dst, e.type FROM edges e JOIN nodes a ON a.ref = src AND a.label <> 'region' JOIN nodes b ON b.ref = dst AND b.label <> 'region'")
def graph_sink(t: Tables) -> DataFrame:
    """Edges are written twice and stand once; those to nodes that were not written are left out."""
    graph = FrameSet(t.spark, _path(t, "graph"))
    for _ in range(2):
        write_graph(graph, nodes(t).where("label <> 'region'"), edges(t))
    return graph.read("edges")


@query("grf05_rebuild", f"WITH {_NODES} SELECT * FROM nodes WHERE label <> 'customer'")
def rebuild(t: Tables) -> DataFrame:
    return _rebuilt(t).read("nodes")


def _rebuilt(t: Tables) -> FrameSet:
    graph = FrameSet(t.spark, _path(t, "graph"))
    rebuild_graph(graph, nodes(t), edges(t))
    rebuild_graph(graph, nodes(t).where("label <> 'customer'"), edges(t))
    return graph


@query("grf05_rebuilt_edges", f"WITH {_NODES}, {_EDGES} SELECT e.src, e.dst, e.type FROM edges e JOIN nodes a ON a.ref = src AND a.label <> 'customer' JOIN nodes b ON b.ref = dst AND b.label <> 'customer'")
def rebuilt_edges(t: Tables) -> DataFrame:
    """The edges of the version that the nodes of ``grf05_rebuild`` belong to."""
    return _rebuilt(t).read("edges")


@query("join20_edge_merge", f"WITH {_NODES}, {_EDGES}, p AS (SELECT src, dst, type FROM edges UNION ALL SELECT 's' || (l_suppkey - 2), 'n' || (l_suppkey % 30), 'SHIPS_TO' FROM lineitem) SELECT DISTINCT p.src, p.dst, p.type FROM p JOIN nodes a ON a.ref = src JOIN nodes b ON b.ref = dst")
def edge_merge(t: Tables) -> DataFrame:
    """Proposed edges whose two ends are known nodes, each once."""
    shipped = t.lineitem.select(F.concat(F.lit("s"), (F.col("l_suppkey") - 2).cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("l_suppkey") % 30).cast("string")).alias("dst"), F.lit("SHIPS_TO").alias("type")).distinct()
    proposed, known = edges(t).unionByName(shipped), nodes(t).select("ref")
    return proposed.join(known.withColumnRenamed("ref", "src"), "src", "left_semi").join(known.withColumnRenamed("ref", "dst"), "dst", "left_semi").select("src", "dst", "type").distinct()


@query("ont03_edge_shapes", f"WITH {_NODES}, {_EDGES}, allowed(type, a, b) AS (VALUES ('LIVES_IN', 'customer', 'nation'), ('PART_OF', 'nation', 'region'), ('BASED_IN', 'customer', 'nation')) SELECT e.type, a.label AS from_label, b.label AS to_label, count(*) AS n, x.type IS NOT NULL AS legal FROM edges e JOIN nodes a ON a.ref = src JOIN nodes b ON b.ref = dst LEFT JOIN allowed x ON x.type = e.type AND x.a = a.label AND x.b = b.label GROUP BY 1, 2, 3, 5")
def edge_shapes(t: Tables) -> DataFrame:
    """The shapes that edges have, with their number, held against the catalogue of legal ones."""
    allowed = t.spark.createDataFrame([("LIVES_IN", "customer", "nation"), ("PART_OF", "nation", "region"), ("BASED_IN", "customer", "nation")], "type string, from_label string, to_label string").withColumn("ok", F.lit(True))
    label = lambda end, name: nodes(t).select(F.col("ref").alias(end), F.col("label").alias(name))
    shapes = edges(t).join(label("src", "from_label"), "src").join(label("dst", "to_label"), "dst").groupBy("type", "from_label", "to_label").agg(F.count("*").alias("n"))
    return shapes.join(F.broadcast(allowed), ["type", "from_label", "to_label"], "left").select("type", "from_label", "to_label", "n", F.col("ok").isNotNull().alias("legal"))


@query("src11_json_pages", "SELECT event_id, user_id, event_type FROM events")
def json_pages(t: Tables) -> DataFrame:
    """A listing stored as JSON pages of a hundred rows, many to a file, read back with a schema."""
    from ..sources.readers import read_json_pages

    path = new_table(t, "pages").path
    rows = t.events.select(F.monotonically_increasing_id().alias("_at"), F.struct("event_id", "user_id", "event_type").alias("row"))
    rows.groupBy(F.expr("_at div 100")).agg(F.collect_list("row").alias("rows")).select("rows").write.json(path)
    return read_json_pages(t.spark, path, "event_id long, user_id long, event_type string", "rows")
