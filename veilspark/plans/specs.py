"""Region and band texts, parsed on the driver before a plan is built, by the same expressions as columns of them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import specs as s


def values_of(spark: SparkSession, *columns: Column) -> list:
    """The values of expressions of literals; the optimizer folds them, so no job runs."""
    return list(spark.sql("values (0)").select(*[c.alias(f"v{i}") for i, c in enumerate(columns)]).first() or ()) if columns else []


def value_of(spark: SparkSession, column: Column):
    return values_of(spark, column)[0]


def polygons_of(spark: SparkSession, specs: list[str]) -> list[list[tuple[int, int]]]:
    """The corners that each 'x1,y1,x2,y2' or 'x,y;x,y;x,y...' names; ValueError for any other text."""
    found = values_of(spark, *[s.parse_region(F.lit(x)) for x in specs])
    for spec, polygon in zip(specs, found, strict=True):
        if polygon is None:
            raise ValueError(f"not a region: {spec!r}")
    return [[(p["x"], p["y"]) for p in polygon] for polygon in found]


def polygon_of(spark: SparkSession, spec: str) -> list[tuple[int, int]]:
    return polygons_of(spark, [spec])[0]


def band_of(spark: SparkSession, spec: str) -> tuple[str, float]:
    """'side:ratio' with a ratio between 0 and 1; ValueError for any other text."""
    found = value_of(spark, s.parse_band(F.lit(spec)))
    if found is None:
        raise ValueError(f"not a band: {spec!r}")
    return found["name"], found["ratio"]
