"""Is there anything of a layer within a radius of a point?"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgrid.operators.grid import CELL_X, CELL_Y, Grid
from snapgrid.operators.nearest import places
from snapgrid.operators.targets import BROADCAST_BYTES, ROW_BYTES, Extent, distance_to, joinable_cells

# Fixed value: the flags test for less than 50 metres.
FLAG_RADIUS_M = 50.0


def near_flag(
    points: DataFrame,
    targets: DataFrame,
    flag: str,
    radius_m: float = FLAG_RADIUS_M,
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """Add a 0/1 column: some target lies less than ``radius_m`` away.

    Either way Spark stops at the first match of a row and never builds the pairs.
    """
    extent = Extent.measure(targets)
    grid = Grid.for_radius(radius_m, extent.max_abs_lat)
    cells = joinable_cells(targets, grid, extent)
    if extent.fits_broadcast(grid):
        return _flag_in_place(points, cells, grid, flag, radius_m, lat, lon)
    return _flag_by_place(points, cells, grid, flag, radius_m, lat, lon)


def _flag_in_place(
    points: DataFrame, cells: DataFrame, grid: Grid, flag: str, radius_m: float, lat: str, lon: str
) -> DataFrame:
    """EXISTS against broadcast cells: one pass over the points, no shuffle."""
    # Names of their own: an outer reference must not be found in the layer.
    outer = {"_at_lat": F.col(lat), "_at_lon": F.col(lon)}
    placed = grid.locate(points.withColumns(outer), "_at_lat", "_at_lon").withColumnsRenamed(
        {CELL_Y: "_at_y", CELL_X: "_at_x"}
    )
    near = distance_to(cells, F.col("_at_lat").outer(), F.col("_at_lon").outer())
    exists = cells.where(
        (F.col(CELL_Y) == F.col("_at_y").outer())
        & (F.col(CELL_X) == F.col("_at_x").outer())
        & (near < F.lit(float(radius_m)))
    ).exists()
    return placed.withColumn(flag, exists.cast("int")).drop("_at_lat", "_at_lon", "_at_y", "_at_x")


def _flag_by_place(
    points: DataFrame, cells: DataFrame, grid: Grid, flag: str, radius_m: float, lat: str, lon: str
) -> DataFrame:
    """Semi-join of the distinct coordinates, brought back to the points.

    Unlike an EXISTS column, both joins can be split where a key is hot.
    """
    spots = grid.locate(places(points, lat, lon), "lat", "lon").alias("spot")
    near = distance_to(cells, F.col("spot.lat"), F.col("spot.lon")) < F.lit(float(radius_m))
    same_cell = [F.col(f"spot.{c}") == F.col(f"cell.{c}") for c in (CELL_Y, CELL_X)]
    hits = spots.join(cells.alias("cell"), [*same_cell, near], "left_semi").select(
        F.col("lat").alias(lat), F.col("lon").alias(lon), F.lit(1).alias(flag)
    )
    return points.join(hits, [lat, lon], "left").na.fill(0, [flag])


def near_flags(
    points: DataFrame,
    layers: Mapping[str, DataFrame],
    key: str,
    radius_m: float = FLAG_RADIUS_M,
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """Add one 0/1 column per layer to a point table that is small by construction.

    Made for a top-n ranking: the layers may be of any size and stream past the
    points, whose 3x3 cells are the exploded side. The points are counted; while
    they fit a broadcast no layer is shuffled. Matches shrink to one row per key
    on the map side. ``key`` must be unique.
    """
    # Point rows of the stack have no second end.
    stacked: DataFrame | None = None
    for i, targets in enumerate(layers.values()):
        ends = [
            F.col(c) if c in targets.columns else F.lit(None).cast("double").alias(c)
            for c in ("a_lat", "a_lon", "b_lat", "b_lon")
        ]
        tagged = targets.select(F.lit(i).alias("_layer"), *ends)
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    # Here the points bound the search: nothing further out can match them.
    outermost, rows, wide = points.agg(
        F.max(F.abs(lat)), F.count("*"), F.max(F.octet_length(F.col(key).cast("string")))
    ).first()
    grid = Grid.for_radius(radius_m, outermost or 0.0)
    around = grid.locate_around(points.select(key, lat, lon), lat, lon)
    if 9 * rows * (ROW_BYTES + (wide or 0)) <= BROADCAST_BYTES:
        around = F.broadcast(around)
    pieces = grid.cover(
        stacked.withColumns(
            {"_end_lat": F.coalesce("b_lat", "a_lat"), "_end_lon": F.coalesce("b_lon", "a_lon")}
        ),
        "a_lat", "a_lon", "_end_lat", "_end_lon", pad=0,
    )
    hits = (
        pieces.join(around, [CELL_Y, CELL_X])
        .where(distance_to(stacked, F.col(lat), F.col(lon), mixed=True) < F.lit(float(radius_m)))
        .groupBy(key)
        .agg(
            *[
                F.max((F.col("_layer") == i).cast("int")).alias(flag)
                for i, flag in enumerate(layers)
            ]
        )
    )
    return points.join(hits, key, "left").na.fill(0, list(layers))
