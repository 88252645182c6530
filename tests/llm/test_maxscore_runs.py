"""Queries that go through a shard together find what each would find alone, in few products."""

import numpy as np

from marginalia.llm import topk


def test_queries_traverse_runs_together():
    r = np.random.default_rng(3)
    for wide in (40, 2**24, 2**40):  # sums in floating point, integers of 64 bits, integers of any length
        n = 3000 if wide == 40 else 700
        ids, values = r.permutation(n) * 3, np.floor(r.normal(size=(n, 12)) * wide)
        values[:50] = values[50:100]
        shard, asked = topk.Shard(np.arange(n), ids, values), [*range(0, n, 11)]
        exact = values.astype(np.int64).astype(object)
        for one, (at, best) in zip(asked, shard.search_all(values[asked], asked, 20)):
            scores = exact @ exact[one]
            want = sorted((-scores[i], ids[i]) for i in range(n) if i != one)[:20]
            assert [(-b, a) for a, b in zip(at, best)] == want


def test_a_block_of_queries_needs_few_products(monkeypatch):
    r = np.random.default_rng(4)
    values, calls = np.floor(r.normal(size=(5000, 16)) * 64), []
    shard = topk.Shard(np.arange(5000), np.arange(5000), values)
    monkeypatch.setattr(topk.Shard, "_as", lambda self, kind, real=topk.Shard._as: calls.append(kind) or real(self, kind))
    shard.search_all(values[:640], np.arange(640), 20)
    assert len(calls) == 640 + 3 * (640 // topk.TOGETHER)  # one a query for its bounds, one a run and group for the products
