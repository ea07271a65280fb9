"""All registered queries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagwright.plans import access, assets, entities, graphs, identity, papers, plants, quality, runs, series, shapes, stored

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (series, assets, stored, identity, entities, access, runs, shapes, graphs, papers, plants, quality)
FLAGSHIP = "ts_quality_score"


def queries() -> dict[str, Query]:
    return {name: q for part in PARTS for name, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
