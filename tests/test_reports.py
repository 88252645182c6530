"""Feeds, channels, drift and versions on small frames."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marginalia.operators import reports, retrieval


def test_feed_shows_primaries_with_their_confirmations(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = [(1, "a", "rules", at(1), None), (2, "b", "rules", at(3), 1), (3, "c", "rules", at(2), 1), (4, "a", "editorial", at(9), None), (5, "d", "news", at(9), None), (6, "d", "news", at(9), None), (7, "e", "news", None, None)]
    changes = spark.createDataFrame(rows, "id long, source string, type string, detected_at timestamp, consolidated_with long")
    domains = spark.createDataFrame([(1, "red"), (1, "blue"), (2, "green")], "id long, domain string")
    got = sorted(((r.id, r.domain, r.place, r.confirmation, r.confirmed_by) for r in reports.change_feed(changes, domains, 3).collect()), key=repr)
    assert got == sorted([(6, None, None, None, None), (5, None, None, None, None), (1, "blue", 1, 3, "c"), (1, "blue", 2, 2, "b")], key=repr)


def test_channels_hide_unreadable_sources_only(spark, tmp_path):
    like, failed = spark.range(3).select("id"), []
    assert retrieval.channel("gone", lambda: spark.read.parquet(str(tmp_path / "nothing")), like, failed).isEmpty() and failed == ["gone"]
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN|cannot be resolved"):
        retrieval.channel("bug", lambda: spark.range(3).select(F.col("no_such_column").alias("id")), like, failed)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|USER_RAISED"):
        retrieval.channel("bug", lambda: spark.range(3).select(F.expr("raise_error('own fault')").cast("long").alias("id")), like, failed)
    assert failed == ["gone"] and retrieval.channel("fine", lambda: spark.range(2), like, failed).count() == 2


def test_drift_counts_the_living(spark):
    rows = [("concept", "candidate", []), ("concept", "canonical", ["x"]), ("concept", "merged", []), ("odd", "canonical", None), ("mechanic", "merged", ["x"])]
    got = {r.kind: tuple(r)[1:] for r in reports.entity_drift(spark.createDataFrame(rows, "kind string, status string, aliases array<string>"), ["mechanic", "concept"]).collect()}
    assert got == {"mechanic": (1, 0, 0, 0, 1, 0), "concept": (2, 2, 1, 1, 1, 1), "odd": (3, 1, 0, 1, 0, 1)}


def test_versions_change_by_what_came_and_went(spark):
    old = [("same", "class", "a"), ("more", "class", "a"), ("less", "class", "a"), ("less", "class", "b"), ("axis", "disjoint", "a")]
    new = [("same", "class", "a"), ("same", "class", "a"), ("more", "class", "a"), ("more", "relation", "r"), ("less", "class", "a"), ("axis", "disjoint", "a"), ("axis", "disjoint", "b")]
    kinds = "name string, axis string, line string"
    got = {r.name: (r.change, r.added, r.removed) for r in reports.version_changes(spark.createDataFrame(old, kinds), spark.createDataFrame(new, kinds), "disjoint").collect()}
    assert got == {"same": ("patch", 0, 0), "more": ("minor", 1, 0), "less": ("major", 0, 1), "axis": ("major", 1, 0)}
