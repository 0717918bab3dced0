"""GeoJSON text from geometry columns, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def polygon(rings: Column) -> Column:
    """MultiPolygon struct of closed outer rings of struct<x, y>."""
    points = F.transform(rings, lambda r: F.array(F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    return F.struct(F.lit("MultiPolygon").alias("type"), points.alias("coordinates"))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def features(df: DataFrame, rings: str, properties: list[str]) -> DataFrame:
    """(feature): one GeoJSON feature per row; rows without geometry are left out."""
    return df.filter(F.col(rings).isNotNull()).select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), polygon(F.col(rings)).alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def collection(features_: DataFrame) -> DataFrame:
    """(collection): all features in one GeoJSON text; for a layer that fits one row."""
    return features_.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list("feature")), ","), F.lit("]}")).alias("collection"))


def rings(geometry: Column) -> Column:
    """Outer rings of a MultiPolygon text."""
    parsed = F.from_json(geometry, "type string, coordinates array<array<array<array<double>>>>")
    return F.transform(parsed["coordinates"], lambda p: F.transform(p[0], lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))))
