"""Registry of the engine's own queries: name -> callable and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from confab.plans import edge_queries, flow_queries, fold_oracles, segment_queries, state_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**segment_queries.QUERIES, **text_queries.QUERIES, **state_queries.QUERIES, **flow_queries.QUERIES, **edge_queries.QUERIES}
ORACLES: dict[str, str] = {**segment_queries.ORACLES, **text_queries.ORACLES, **state_queries.ORACLES, **flow_queries.ORACLES, **fold_oracles.ORACLES, **edge_queries.ORACLES}
