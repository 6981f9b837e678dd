"""The 13 infrastructure layers and how each becomes targets."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.operators.clean import number_of
from snapgrid.operators.targets import (
    multiline_targets,
    multipoint_targets,
    point_targets,
    segment_targets,
)
from snapgrid.sources import schemas
from snapgrid.sources.readers import read_json_pages

# Fixed value: a pavement rating below this is bad.
BAD_RATING = 3.5


def lat_long_layer(df: DataFrame) -> DataFrame:
    return point_targets(df, "lat", "long")


def from_to_layer(df: DataFrame) -> DataFrame:
    return segment_targets(df, "fromlatitude", "fromlongitude", "tolatitude", "tolongitude")


def _depth() -> Column:
    """How deep the coordinates are nested: by the kind of geometry, or as they are written."""
    kind, text = F.col("the_geom.type"), F.col("the_geom.coordinates")
    written = F.length(F.regexp_replace(F.regexp_extract(text, r"^[\[\s]*", 0), r"\s", ""))
    known = F.when(kind == "Point", 1).when(kind.isin("MultiPoint", "LineString"), 2)
    return F.coalesce(known.when(kind == "MultiLineString", 3), written)


def _coordinates(df: DataFrame, *depths: int) -> DataFrame:
    """``_coordinates`` of the rows nested to one of ``depths``, wrapped to the last of them."""
    parsed = F.lit(None)
    for depth in depths:
        kind = "array<" * depth + "double" + ">" * depth
        found = F.from_json(F.col("the_geom.coordinates"), kind)
        for _ in range(depths[-1] - depth):
            found = F.array(found)
        parsed = F.when(_depth() == depth, found).otherwise(parsed)
    return df.select("*", parsed.alias("_coordinates")).where(F.size("_coordinates") > 0)


def geo_point_layer(df: DataFrame) -> DataFrame:
    """Points: a flat pair of numbers. Everything else in the layer is passed over."""
    pairs = _coordinates(df, 1).where(F.size("_coordinates") == 2)
    return pairs.select(
        F.col("_coordinates")[1].alias("a_lat"), F.col("_coordinates")[0].alias("a_lon")
    ).dropna()


def geo_multipoint_layer(df: DataFrame) -> DataFrame:
    """Points and multipoints in one layer."""
    dots = df.where(~F.coalesce(F.col("the_geom.type") == "LineString", F.lit(False)))
    return multipoint_targets(_coordinates(dots, 1, 2), "_coordinates")


def geo_multiline_layer(df: DataFrame) -> DataFrame:
    """Every segment of every line; single lines and multilines in one layer."""
    lines = df.where(~F.coalesce(F.col("the_geom.type") == "MultiPoint", F.lit(False)))
    return multiline_targets(_coordinates(lines, 2, 3), "_coordinates")


def bad_pavement_layer(df: DataFrame) -> DataFrame:
    """Segments of the streets with a bad rating; the rating is tested first."""
    return geo_multiline_layer(df.where(number_of(df, "systemrating") < BAD_RATING))


@dataclass(frozen=True)
class Layer:
    folder: str
    schema: str
    targets: Callable[[DataFrame], DataFrame]


LAYERS: Mapping[str, Layer] = {
    "Has_Enhanced_Crossing": Layer("enhanced_crossings", schemas.LAT_LONG_PAGE, lat_long_layer),
    "Has_Leading_Pedestrian_Signal": Layer("leading_intervals", schemas.LAT_LONG_PAGE, lat_long_layer),
    "Has_Turn_Traffic_Calming": Layer("turn_calming", schemas.LAT_LONG_PAGE, lat_long_layer),
    "Has_SIP": Layer("street_improvements", schemas.LAT_LONG_PAGE, lat_long_layer),
    "Has_Exclusive_Pedestrian_Signal": Layer("exclusive_signals", schemas.GEOMETRY_PAGE, geo_point_layer),
    "Has_Accessible_Pedestrian_Signal": Layer("accessible_signals", schemas.GEOMETRY_PAGE, geo_point_layer),
    "Is_Protected_Intersection": Layer("protected_intersections", schemas.GEOMETRY_PAGE, geo_multipoint_layer),
    "Has_Pedestrian_Ramp": Layer("pedestrian_ramps", schemas.GEOMETRY_PAGE, geo_point_layer),
    "Has_Bus_Lane": Layer("bus_lanes", schemas.GEOMETRY_PAGE, geo_multiline_layer),
    "Has_Speed_Hump": Layer("speed_humps", schemas.GEOMETRY_PAGE, geo_multiline_layer),
    "Is_Speed_Reduced": Layer("speed_reducers", schemas.FROM_TO_PAGE, from_to_layer),
    "Is_Bike_Route": Layer("bike_routes", schemas.GEOMETRY_PAGE, geo_multiline_layer),
    "Has_Bad_Pavement": Layer("pavement_ratings", schemas.RATED_GEOMETRY_PAGE, bad_pavement_layer),
}


def read_layers(spark: SparkSession, root: str, multiline: bool = False) -> dict[str, DataFrame]:
    """Targets of each flag from the pages landed in ``root/<folder>``."""
    return {
        flag: layer.targets(read_json_pages(spark, f"{root}/{layer.folder}", layer.schema, multiline))
        for flag, layer in LAYERS.items()
    }
