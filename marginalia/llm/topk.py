"""Operator 5: exact top-k search by MaxScore.

Each dimension is a query term, and a shard keeps the postings of each term: the values of all its vectors, with the
least and greatest. Above the least that a term can give, a vector gains at most the term's bound: its weight times the
span of the dimension. A query goes through a shard in growing runs of vectors and keeps the k-th best score so far as
its threshold. The terms of the smallest bounds that together can't lift a vector to the threshold are non-essential:
the others, the essential ones, are traversed for the whole run, and non-essential terms are probed only for vectors
whose score and remaining bounds still reach the threshold; ties stay in. As the threshold rises, fewer terms are
essential. Shards are merged at the end. Blocks of queries meet every shard.

Components become floor(scale * x) as whole numbers. Scores are exact for all finite components: sums below 2 ** 52 are
added in floating point, below 2 ** 62 in integers of 64 bits, beyond that in integers of any length. Ranks follow the exact
score, whatever its length; it is shown as a decimal of 38 digits (larger ones as the largest such); the query shows it as a long,
null beyond that.

Vectors that are null or hold null or non-finite components take no part, and neither do rows without a key. Vectors are
compared with those of their length; empty ones have score 0 among themselves. Equal scores go by smaller key. Only its
own row is left out of a query's candidates: rows that repeat a key are candidates and queries of their own. An empty
table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Vectors of a shard, queries of a block, vectors of the first runs of a shard, non-essential terms probed at once, queries that traverse a run together.
SHARD, BLOCK, RUNS, PROBED, TOGETHER = 16_384, 1_024, (256, 1_024), 8, 64
#: Of what the threshold asks above the base, the share that non-essential terms may make up: less leaves fewer rows to probe, and essential terms go by one product.
SPARE = (1, 20)
_WIDEST = 10**38 - 1


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v array<double>): the vectors that take part, as whole numbers."""
    x = F.col(vector)
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    fine = x.isNotNull() & F.forall(x, finite)
    return vectors.where(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: _floor(c.cast("double") * scale)).alias("v"))


def _floor(x):
    """floor() of a double that stays a double: whole numbers from 2 ** 52 on are their own floor."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


class Shard:
    """Postings of a shard: for each term the values of all vectors, with the least and greatest of each term."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.floats = rows[order], ids[order], np.ascontiguousarray(values[order].T)
        self.widest = float(np.abs(self.floats).max(initial=0))
        self._kinds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _as(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(postings, least, most) in floating point, integers of 64 bits, or integers of any length."""
        if kind not in self._kinds:
            terms = {"float": lambda: self.floats, "long": lambda: self.floats.astype(np.int64), "any": lambda: _integers(self.floats)}[kind]()
            self._kinds[kind] = terms, terms.min(axis=1), terms.max(axis=1)
        return self._kinds[kind]

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """The k best (ids, scores), without the row ``own``; ties by smaller id."""
        return self.search_all(query[None, :], [own], k)[0]

    def search_all(self, queries: np.ndarray, own: list[int] | np.ndarray, k: int) -> list[tuple[np.ndarray, list[int] | np.ndarray]]:
        """``search`` of several queries: those of a kind go through each run together, each with its own essential terms."""
        kinds: dict[str, list[_Search]] = {}
        searches = [_Search(self, query, row, k) for query, row in zip(queries, own)]
        for one in searches:
            kinds.setdefault(one.kind, []).append(one)
        edges = [0, *(x for x in np.cumsum(RUNS).tolist() if x < len(self.ids)), len(self.ids)]
        for kind, those in kinds.items():
            for at in range(0, len(those), TOGETHER):
                group = those[at : at + TOGETHER]
                for a, b in zip(edges, edges[1:]):
                    weights = np.stack([one.essential() for one in group])
                    used = np.flatnonzero((weights != 0).any(axis=0))
                    scores = weights[:, used] @ self._as(kind)[0][used, a:b] if len(used) else np.zeros((len(group), b - a), weights.dtype)
                    for one, score in zip(group, scores):
                        one.traverse(score, a, b)
        return [one.found() for one in searches]


class _Search:
    """One query on its way through the runs of a shard: its best rows so far, and its threshold."""

    def __init__(self, shard: Shard, query: np.ndarray, own: int, k: int):
        size = 4.0 * max(1, len(query)) * float(np.abs(query).max(initial=0)) * shard.widest
        self.kind = "float" if size < 2**52 else "long" if size < 2**62 else "any"
        self.terms, least, most = shard._as(self.kind)
        self.shard, self.own, self.k = shard, own, k
        self.q = q = query if self.kind == "float" else query.astype(np.int64) if self.kind == "long" else _integers(query)
        self.low = q * np.where(query >= 0, least, most)
        bounds = abs(q) * (most - least)
        self.order = np.argsort(bounds, kind="stable")
        self.reach, self.base = np.concatenate((np.zeros(1, bounds.dtype), np.cumsum(bounds[self.order]))), self.low.sum()
        self.best_at, self.best, self.threshold, self.spared = np.empty(0, np.int64), np.empty(0, q.dtype), None, 0

    def essential(self) -> np.ndarray:
        """The weights of the essential terms, 0 for the others: terms whose bounds add up to less than ``SPARE`` of what the threshold asks above the base."""
        self.spared = 0 if self.threshold is None else int(np.searchsorted(self.reach[1:] * SPARE[1], (self.threshold - self.base) * SPARE[0], side="left"))
        weights = self.q.copy()
        weights[self.order[: self.spared]] = 0
        return weights

    def traverse(self, score: np.ndarray, a: int, b: int) -> None:
        """Takes the run of rows a to b with what the essential terms give; non-essential terms are probed where they can still matter."""
        q, low, order, spared = self.q, self.low, self.order, self.spared
        score = score + (self.base - low[order[spared:]].sum())
        alive = self.shard.rows[a:b] != self.own
        if self.threshold is not None:
            alive &= score + self.reach[spared] >= self.threshold
        alive = np.flatnonzero(alive)
        score, alive = score[alive], alive + a
        while spared:
            probed = order[max(0, spared - PROBED) : spared]
            score = score + (q[probed] @ self.terms[np.ix_(probed, alive)] - low[probed].sum())
            spared -= len(probed)
            fit = score + self.reach[spared] >= self.threshold
            score, alive = score[fit], alive[fit]
        self.best_at, self.best = np.concatenate((self.best_at, alive)), np.concatenate((self.best, score))
        if len(self.best) >= self.k:
            self.threshold = np.sort(self.best)[len(self.best) - self.k]
            fit = self.best >= self.threshold
            self.best_at, self.best = self.best_at[fit], self.best[fit]

    def found(self) -> tuple[np.ndarray, list[int] | np.ndarray]:
        ids, best = self.shard.ids[self.best_at], self.best
        keep = sorted(range(len(best)), key=lambda i: (-best[i], ids[i]))[: self.k]
        return ids[keep], [int(best[i]) for i in keep]


def _integers(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) for v in x.ravel()]
    return out


def sortable(score: int) -> str | None:
    """A text that sorts as the score does, for scores that 38 digits don't tell apart; None for others."""
    if abs(score) < _WIDEST:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"1{len(digits):06d}{digits}"
    return "0" + "".join(chr(105 - ord(c)) for c in f"{len(digits):06d}{digits}")  # each digit as what it lacks to nine


def _pack(rows: DataFrame, by: str) -> DataFrame:
    """The vectors of each value of ``by`` in one row: rows, ids and values as bytes, and the length of a vector."""

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups:
            told = [[np.asarray(x, kind).tobytes() for x in batch.column(name).to_pylist()] for name, kind in (("rows", np.int64), ("ids", np.int64), ("vs", np.float64))]
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column("size"), *(pa.array(x, pa.binary()) for x in told)], [by, "size", f"{by}_rows", f"{by}_ids", f"{by}_values"])

    packed = rows.groupBy(by, F.size("v").alias("size")).agg(F.collect_list(F.struct("row", "id", "v")).alias("r"))
    packed = packed.select(by, "size", F.col("r.row").alias("rows"), F.col("r.id").alias("ids"), F.flatten(F.col("r.v")).alias("vs"))
    return packed.mapInArrow(common.tidied(run), f"{by} long, size int, {by}_rows binary, {by}_ids binary, {by}_values binary")


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, key, score decimal): for each row of ``vectors`` with ``is_query`` the k other rows of highest inner product.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = common.materialize(whole_numbers(vectors, key, vector, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # Shards and blocks have about as many rows each, whatever the ids are: rows are dealt by hash.
    n, m = rows.count(), rows.where(is_query).count()
    shards = _pack(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // SHARD))))), "shard")
    n_blocks = max(1, -(-m // BLOCK))
    blocks = _pack(rows.where(is_query).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(n_blocks))), "block")
    # Every block of queries is sent to every shard; rows of a block stay packed.
    met = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).join(blocks, ["block", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                take = lambda name, kind=np.int64: np.frombuffer(batch.column(name)[row].as_buffer(), kind)
                size = batch.column("size")[row].as_py()
                ids, wanted, own = take("shard_ids"), take("block_ids"), take("block_rows")
                shard = Shard(take("shard_rows"), ids, take("shard_values", np.float64).reshape(len(ids), size))
                queries = take("block_values", np.float64).reshape(len(wanted), size)
                found = shard.search_all(queries, own, k)
                counts = [len(a) for a, _ in found]
                exact = [x for _, b in found for x in b]
                scores = [max(-_WIDEST, min(_WIDEST, x)) for x in exact]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, counts)), pa.array(np.repeat(wanted, counts)), pa.array(np.concatenate([a for a, _ in found])), pa.array(scores, pa.decimal128(38, 0)), pa.array([sortable(x) for x in exact], pa.string())],
                    ["_query", "query_id", key, "score", "_wide"],
                )

    best = met.repartition("shard", "block").mapInArrow(common.tidied(run), f"_query long, query_id long, {key} long, score decimal(38,0), _wide string")
    by = Window.partitionBy("_query").orderBy(F.desc("score"), F.desc("_wide"), key)
    merged = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), key, "score")


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, k=20)
    return found.withColumn("score", F.col("score").try_cast("long"))


OP5_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= 20
"""
