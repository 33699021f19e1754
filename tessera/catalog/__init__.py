"""All queries of the tile engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.fixtures import Slides

from . import conversions, directories, files, gates, geometry, layouts, pixels, rules, texts  # noqa: F401  each registers its queries
from .pixels import crop_halve_hash
from .registry import QUERIES, SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_halve_hash(Slides(spark, sf_dir))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
