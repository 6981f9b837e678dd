"""A latitude/longitude grid whose cells are never smaller than the search radius.

Two places within the radius of each other then lie in the same cell or in
neighbouring ones, which turns a distance join into an equi-join on the cell.
Meant for data away from the poles and the date line.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE

CELL_Y, CELL_X = "_cell_y", "_cell_x"
_MARGIN = 1.001


def _floor_div(value: Column, step: float) -> Column:
    return F.floor(value / F.lit(step)).cast("bigint")


@dataclass(frozen=True)
class Grid:
    height: float
    width: float

    @staticmethod
    def for_radius(radius_m: float, max_abs_lat: float) -> Grid:
        """Grid for ``radius_m`` when no target lies beyond ``max_abs_lat``.

        A point may lie up to the radius further out than any target, so the
        widest cell needed is the one at that latitude.
        """
        height = radius_m / METRES_PER_DEGREE * _MARGIN
        outermost = math.radians(min(abs(max_abs_lat) + height, 90.0))
        reach = math.sin(min(radius_m / (2 * EARTH_RADIUS_M), math.pi / 2))
        shrink = math.cos(outermost)
        if shrink <= reach:
            return Grid(height, 360.0)
        # The chord bound covers the sphere, the second one the local plane.
        width = max(
            math.degrees(2 * math.asin(reach / shrink)), radius_m / METRES_PER_DEGREE / shrink
        )
        return Grid(height, width * _MARGIN)

    def locate(self, df: DataFrame, lat: str, lon: str) -> DataFrame:
        """Add the cell of each point."""
        return df.withColumns(
            {
                CELL_Y: _floor_div(F.col(lat), self.height),
                CELL_X: _floor_div(F.col(lon), self.width),
            }
        )

    def locate_around(self, df: DataFrame, lat: str, lon: str) -> DataFrame:
        """One row per cell of the 3x3 neighbourhood of each point."""
        one = F.lit(1).cast("bigint")
        y, x = _floor_div(F.col(lat), self.height), _floor_div(F.col(lon), self.width)
        return df.withColumn(CELL_Y, F.explode(F.sequence(y - one, y + one))).withColumn(
            CELL_X, F.explode(F.sequence(x - one, x + one))
        )

    def cover(
        self, df: DataFrame, a_lat: str, a_lon: str, b_lat: str, b_lon: str, pad: int
    ) -> DataFrame:
        """One row per cell that a segment touches, widened by ``pad`` cells.

        Goes row by row of the grid and takes the columns that the part of the
        segment near that row spans, so the number of cells grows with the length
        of the segment and not with the area of its bounding box.
        """
        a_y, b_y = F.col(a_lat) / F.lit(self.height), F.col(b_lat) / F.lit(self.height)
        a_x, b_x = F.col(a_lon) / F.lit(self.width), F.col(b_lon) / F.lit(self.width)
        pad_cells = F.lit(pad).cast("bigint")

        def spanned(one: Column, other: Column) -> Column:
            first = F.floor(F.least(one, other)).cast("bigint") - pad_cells
            last = F.floor(F.greatest(one, other)).cast("bigint") + pad_cells
            return F.explode(F.sequence(first, last))

        def x_at(y: Column) -> Column:
            """Where the segment crosses a row edge; its ends beyond them."""
            share = F.coalesce(F.try_divide(y - a_y, b_y - a_y), F.lit(0.0))
            return a_x + (b_x - a_x) * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))

        row = F.col(CELL_Y)
        level = a_y == b_y
        low = F.when(level, a_x).otherwise(x_at(row - pad_cells))
        high = F.when(level, b_x).otherwise(x_at(row + pad_cells + 1))
        return df.withColumn(CELL_Y, spanned(a_y, b_y)).withColumn(CELL_X, spanned(low, high))
