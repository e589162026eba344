"""Boundary features (GeoJSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# `coordinates` is kept as JSON text, because Polygon and MultiPolygon nest it differently.
_PROPERTIES = "struct<code: string, nom: string>"
_GEOMETRY = "struct<type: string, coordinates: string>"


def read_features(spark: SparkSession, paths: str | list[str], one_per_line: bool = False) -> DataFrame:
    """Features of all files as (code, name, geometry_type, coordinates).

    A FeatureCollection is one JSON document, so each file is read whole by one task. Boundary layers are some dozen to some
    ten thousand features (tens of kilobytes to tens of megabytes), which a task holds easily; larger ones come with
    one feature per line (`one_per_line`), which Spark splits.
    """
    if one_per_line:
        features = spark.read.schema(f"properties {_PROPERTIES}, geometry {_GEOMETRY}").json(paths)
    else:
        collection = f"features array<struct<properties: {_PROPERTIES}, geometry: {_GEOMETRY}>>"
        documents = spark.read.schema(collection).option("multiLine", True).json(paths)
        features = documents.selectExpr("inline(features)")
    return features.selectExpr(
        "properties.code AS code",
        "properties.nom AS name",
        "geometry.type AS geometry_type",
        r"translate(geometry.coordinates, ' \t\r\n', '') AS coordinates",
    )


def bind_layers(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both layers as one."""
    return first.unionByName(second)
