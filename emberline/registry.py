"""All queries of the library but those of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.plans import analytics, annotations, catalog, feeds, fitting, formats, further, lifecycle, masks, places, polygons, relational, scalars, small, spatial, surfaces  # noqa: F401  the plans register themselves


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.QUERIES["agg_01_event_scores"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
