"""Points, boxes, polygons and distances."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import Field


def point(field: Field) -> tuple[Column, Column] | None:
    """Longitude and latitude of an array of two, of GeoJSON coordinates, or of a struct of lng and lat."""
    column, kind = field.column, field.kind
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        if "coordinates" in names:
            return point(Field(column.getField("coordinates"), kind["coordinates"].dataType))
        if {"lng", "lat"} <= set(names):
            return column.getField("lng"), column.getField("lat")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.get(column, F.lit(0)), F.get(column, F.lit(1))
    return None


def point_of(value: Any) -> tuple[float, float]:
    if isinstance(value, dict):
        value = value.get("$geometry", value)
        value = value["coordinates"] if "coordinates" in value else [value["lng"], value["lat"]]
    return float(value[0]), float(value[1])


def in_polygon(x: Column, y: Column, ring: list) -> Column:
    """A ray to the right crosses the ring an odd number of times."""
    odd = F.lit(0)
    corners = [point_of(p) for p in ring]
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 != y2:
            odd = odd + F.when(((y < y1) != (y < y2)) & (x < F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0)
    return odd % 2 == 1


def within(field: Field, spec: Any) -> Column:
    """$box (inclusive), $polygon, $geometry of type Polygon, or $center with a radius; all planar."""
    at = point(field)
    if at is None or not isinstance(spec, dict):
        return F.lit(False)
    x, y = at
    if "$box" in spec:
        (x1, y1), (x2, y2) = spec["$box"]
        return (x >= x1) & (x <= x2) & (y >= y1) & (y <= y2)
    if "$polygon" in spec or "$geometry" in spec:
        return in_polygon(x, y, spec["$polygon"] if "$polygon" in spec else spec["$geometry"]["coordinates"][0])
    if "$center" in spec:
        center, radius = spec["$center"]
        return planar(x, y, *point_of(center)) <= radius
    if "$centerSphere" in spec:  # a radius in radians
        center, radius = spec["$centerSphere"]
        lng, lat = point_of(center)
        return meters(x, y, F.lit(lng), F.lit(lat), 1.0) <= radius
    raise ValueError("$geoWithin takes $box, $polygon, $geometry, $center or $centerSphere")


def on_segment(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float], slack: float = 1e-12) -> Column:
    (x1, y1), (x2, y2) = a, b
    cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
    return (F.abs(cross) <= slack) & (x >= min(x1, x2) - slack) & (x <= max(x1, x2) + slack) & (y >= min(y1, y2) - slack) & (y <= max(y1, y2) + slack)


def intersects(field: Field, spec: Any) -> Column:
    """Points that a $geometry touches: a Point, a LineString, or a Polygon with its border and without its holes' insides."""
    at = point(field)
    shape = spec.get("$geometry", spec) if isinstance(spec, dict) else {}
    if at is None or "coordinates" not in shape:
        return F.lit(False)
    x, y = at
    kind, rings = shape.get("type", "Polygon"), shape["coordinates"]

    def border(line: list) -> Column:
        corners = [point_of(p) for p in line]
        return reduce(lambda p, q: p | q, [on_segment(x, y, a, b) for a, b in zip(corners[:-1], corners[1:], strict=True)])

    if kind == "Point":
        return on_segment(x, y, point_of(rings), point_of(rings))
    if kind == "LineString":
        return border(rings)
    if kind != "Polygon":
        raise ValueError("$geoIntersects takes a Point, LineString or Polygon")
    inside = in_polygon(x, y, rings[0])
    for hole in rings[1:]:
        inside = inside & ~in_polygon(x, y, hole)
    return reduce(lambda p, q: p | q, [border(r) for r in rings], inside)


def planar(x: Column, y: Column, lng: float, lat: float) -> Column:
    return F.sqrt(F.pow(x - F.lit(lng), 2) + F.pow(y - F.lit(lat), 2))


def near(field: Field, spec: Any) -> Column:
    """Distance up to $maxDistance, from $minDistance on: planar in degrees, or over the sphere in meters where `spherical` is set."""
    at = point(field)
    if at is None:
        return F.lit(False)
    d = distance(at, spec)
    most = spec.get("$maxDistance") if isinstance(spec, dict) else None
    least = spec.get("$minDistance") if isinstance(spec, dict) else None
    test = d.isNotNull() if most is None else d <= most
    return test if least is None else test & (d >= least)


def distance(at: tuple[Column, Column], spec: Any) -> Column:
    lng, lat = point_of(spec)
    return meters(*at, F.lit(lng), F.lit(lat)) if isinstance(spec, dict) and spec.get("spherical") else planar(*at, lng, lat)


def nearest(df: DataFrame, field: Field, spec: Any, k: int, key: str) -> DataFrame:
    """The k nearest rows with `distance`, nearest first, ties by key; rows without a point aren't among them."""
    at = point(field)
    if at is None:
        return df.limit(0).withColumn("distance", F.lit(0.0))
    return df.withColumn("distance", distance(at, spec)).where(F.col("distance").isNotNull() & near(field, spec)).orderBy("distance", key).limit(k)


def meters(x1: Column, y1: Column, x2: Column, y2: Column, radius: float = 6_371_008.8) -> Column:
    """Great-circle distance of points in degrees."""
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
