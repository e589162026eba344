"""Areas: groups of sectors with a map frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roomtide.schema import AREA_SCHEMA, AREAS


def default_areas(spark: SparkSession) -> DataFrame:
    """The fixed list of areas as (area, sector, xmin, xmax, ymin, ymax)."""
    rows = [
        (area, sector, *frame) for area, (sectors, *frame) in AREAS.items() for sector in sectors
    ]
    return spark.createDataFrame(rows, AREA_SCHEMA)
