"""Layers read as VARIANT: no schema, any mix of geometries, and nothing lost without a word.

Every record of a page becomes targets or a row of the reject table that says why not.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.operators.clean import to_number
from snapgrid.operators.targets import multiline_targets, multipoint_targets, point_targets, segment_targets
from snapgrid.sources import layers

#: Why a record is no target.
NOT_JSON, NO_GEOMETRY, NO_COORDINATES, WRONG_KIND, NO_NUMBERS, NOT_RATED_BAD = (
    "not json", "no geometry", "no coordinates", "wrong kind of geometry", "no numbers", "not rated bad",
)
# How deep the coordinates of each kind of geometry are nested.
DEPTHS = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3}


def read_variant_pages(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """page, raw, record of everything under ``path``: a record a line, or an array of records a file.

    What does not parse stays as a row without a record.
    """
    lines = spark.read.text(path, wholetext=multiline).select(F.col("_metadata.file_path").alias("page"), F.col("value").alias("raw"))
    held = lines.where(F.trim("raw") != "").withColumn("_held", F.try_parse_json("raw"))
    several = F.try_variant_get("_held", "$", "array<variant>")
    # An array of records is taken apart; anything else is one record.
    each = F.when(F.expr("schema_of_variant(_held)").startswith("ARRAY"), several).otherwise(F.array("_held"))
    return held.select("page", "raw", F.explode_outer(each).alias("record"))


def field(path: str, kind: str = "string") -> Column:
    """A field of the record, or null where it is missing or does not fit."""
    return F.try_variant_get("record", path, kind)


def _shapes(depths: tuple[int, ...]) -> Mapping[int, Column]:
    """Coordinates as arrays of each depth, null where the record has another; they may also stand as text."""
    parsed = F.try_parse_json(field("$.the_geom.coordinates"))

    def pair(p: Column) -> Column:
        return (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull()

    def some(depth: int, value: Column) -> Column:
        return pair(value) if depth == 1 else F.exists(value, lambda part: some(depth - 1, part))

    found = {}
    for depth in depths:
        value = F.try_variant_get(parsed, "$", "array<" * depth + "double" + ">" * depth)
        found[depth] = F.when(some(depth, value), value)
    return found


def classified(pages: DataFrame, depths: tuple[int, ...], but: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` with reason (null for targets) and parts, the coordinates nested to the last of ``depths``.

    ``but`` names kinds of geometry that the layer does not take although their depth would do.
    """
    kind = field("$.the_geom.type")
    shapes = _shapes((1, 2, 3))
    shape = F.coalesce(*[F.when(value.isNotNull(), F.lit(depth)) for depth, value in shapes.items()])
    known = F.coalesce(*[F.when(kind == name, F.lit(depth)) for name, depth in DEPTHS.items()])
    fits = shape.isin(*depths) & F.coalesce(shape == known, F.lit(True)) & ~F.coalesce(kind.isin(*but), F.lit(False))
    parts = F.lit(None)
    for depth in depths:
        value = shapes[depth]
        for _ in range(depths[-1] - depth):
            value = F.array(value)
        parts = F.when(shape == depth, value).otherwise(parts)
    reason = (
        F.when(F.col("record").isNull(), NOT_JSON)
        .when(F.coalesce(field("$.the_geom"), field("$.the_geom.type")).isNull(), NO_GEOMETRY)
        .when(field("$.the_geom.coordinates").isNull(), NO_COORDINATES)
        .when(shape.isNull(), NO_NUMBERS)
        .when(~fits, WRONG_KIND)
    )
    return pages.withColumn("reason", reason).withColumn("parts", F.when(F.col("reason").isNull(), parts))


def _numbers(pages: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``pages`` with number columns from fields of the same name, and reason where one is missing."""
    made = pages.withColumns({c: to_number(field(f"$.{c}")) for c in columns})
    missing = F.greatest(*[F.col(c).isNull() for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNull()
    return made.withColumn("reason", F.when(F.col("record").isNull(), NOT_JSON).when(missing, NO_NUMBERS))


@dataclass(frozen=True)
class VariantLayer:
    targets: DataFrame
    rejects: DataFrame


def variant_layer(pages: DataFrame, layer: layers.Layer, properties: Mapping[str, tuple[str, str]] | None = None) -> VariantLayer:
    """Targets and rejects of one layer.

    ``properties`` names fields of the record that its targets keep, as {column: (path, type)}.
    """
    kept = properties or {}
    pages = pages.withColumns({c: field(*at) for c, at in kept.items()})
    if layer.targets is layers.lat_long_layer:
        rows = _numbers(pages, ("lat", "long"))
        targets = point_targets(rows.where("reason IS NULL"), "lat", "long", *kept)
    elif layer.targets is layers.from_to_layer:
        ends = ("fromlatitude", "fromlongitude", "tolatitude", "tolongitude")
        rows = _numbers(pages, ends)
        targets = segment_targets(rows.where("reason IS NULL"), *ends, *kept)
    elif layer.targets in (layers.geo_point_layer, layers.geo_multipoint_layer):
        points = layer.targets is layers.geo_point_layer
        rows = classified(pages, (1,)) if points else classified(pages, (1, 2), but=("LineString",))
        dots = rows.where("reason IS NULL").withColumn("parts", F.array("parts")) if points else rows.where("reason IS NULL")
        targets = multipoint_targets(dots, "parts", *kept)
    else:
        rows = classified(pages, (2, 3), but=("MultiPoint",))
        if layer.targets is layers.bad_pavement_layer:
            bad = F.coalesce(to_number(field("$.systemrating")) < layers.BAD_RATING, F.lit(False))
            rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & ~bad, NOT_RATED_BAD).otherwise(F.col("reason")))
        targets = multiline_targets(rows.where("reason IS NULL"), "parts", *kept)
    return VariantLayer(targets, rows.where("reason IS NOT NULL").select("page", "raw", "reason", *kept))


def read_variant_layers(spark: SparkSession, root: str, multiline: bool = False) -> dict[str, VariantLayer]:
    """Targets and rejects of each flag from the pages landed in ``root/<folder>``."""
    return {
        flag: variant_layer(read_variant_pages(spark, f"{root}/{layer.folder}", multiline), layer) for flag, layer in layers.LAYERS.items()
    }


def reject_table(read: Mapping[str, VariantLayer]) -> DataFrame:
    """flag, page, raw, reason of all layers."""
    tables = [layer.rejects.select(F.lit(flag).alias("flag"), "page", "raw", "reason") for flag, layer in read.items()]
    whole = tables[0]
    for more in tables[1:]:
        whole = whole.unionByName(more)
    return whole
