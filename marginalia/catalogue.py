"""All registered queries of the knowledge-base operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry
from .operators import aggregates, bundles, changes, entities, evaluation, filters, graph, identities, joins, linking, merges, passages, paths, projections, reports, retrieval, sections, sinks, windows  # noqa: F401  (they register queries)
from .functions import scalars, texts, values  # noqa: F401
from .sources import readers  # noqa: F401
from .streaming import streams  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP: Query = registry.QUERIES["rag01_hybrid"]


def queries() -> dict[str, Query]:
    return registry.QUERIES


def oracles() -> dict[str, str]:
    return registry.ORACLES
