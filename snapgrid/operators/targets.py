"""One shape for everything a point can be near to.

A target row has ``a_lat, a_lon`` and, for a line segment, ``b_lat, b_lon``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.functions.geo import haversine_m, segment_distance_m
from snapgrid.operators.clean import number_of
from snapgrid.operators.grid import Grid

# Target cells, in bytes, that a join may broadcast.
BROADCAST_BYTES = 64 << 20
# What a row takes beside its text: coordinates, cell and object headers.
ROW_BYTES = 64


def point_targets(df: DataFrame, lat: str, lon: str, *keep: str) -> DataFrame:
    """Points as targets; text coordinates become numbers, bad ones are dropped."""
    return df.select(
        *keep,
        number_of(df, lat).alias("a_lat"),
        number_of(df, lon).alias("a_lon"),
    ).dropna(subset=["a_lat", "a_lon"])


def segment_targets(
    df: DataFrame, a_lat: str, a_lon: str, b_lat: str, b_lon: str, *keep: str
) -> DataFrame:
    """Rows that hold one segment in four columns."""
    ends = {"a_lat": a_lat, "a_lon": a_lon, "b_lat": b_lat, "b_lon": b_lon}
    return df.select(
        *keep, *[number_of(df, c).alias(name) for name, c in ends.items()]
    ).dropna(subset=list(ends))


def multipoint_targets(df: DataFrame, coordinates: str, *keep: str) -> DataFrame:
    """``array<[lon, lat]>`` to one point target per entry."""
    pairs = df.select(*keep, F.explode(coordinates).alias("_xy")).where(F.size("_xy") >= 2)
    return pairs.select(
        *keep, F.col("_xy")[1].alias("a_lat"), F.col("_xy")[0].alias("a_lon")
    ).dropna(subset=["a_lat", "a_lon"])


def polyline_targets(df: DataFrame, coordinates: str, *keep: str) -> DataFrame:
    """``array<[lon, lat]>`` to one target per pair of consecutive vertices."""
    line = F.col(coordinates)
    count = F.size(line)
    pairs = F.arrays_zip(
        F.slice(line, F.lit(1), count - 1).alias("a"), F.slice(line, F.lit(2), count - 1).alias("b")
    )
    legs = df.where(count >= 2).select(*keep, F.explode(pairs).alias("_leg"))
    return legs.select(
        *keep,
        F.col("_leg.a")[1].alias("a_lat"),
        F.col("_leg.a")[0].alias("a_lon"),
        F.col("_leg.b")[1].alias("b_lat"),
        F.col("_leg.b")[0].alias("b_lon"),
    ).dropna(subset=["a_lat", "a_lon", "b_lat", "b_lon"])


def multiline_targets(df: DataFrame, coordinates: str, *keep: str) -> DataFrame:
    """``array<line>``: every segment of every line."""
    lines = df.select(*keep, F.explode(coordinates).alias("_line"))
    return polyline_targets(lines, "_line", *keep)


def has_segments(targets: DataFrame) -> bool:
    return "b_lat" in targets.columns


def distance_to(targets: DataFrame, lat: Column, lon: Column, mixed: bool = False) -> Column:
    """Metres from a point to a target row; ``mixed`` layers also hold points."""
    to_point = haversine_m(lat, lon, F.col("a_lat"), F.col("a_lon"))
    if not has_segments(targets):
        return to_point
    to_segment = segment_distance_m(
        lat, lon, F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")
    )
    return F.when(F.col("b_lat").isNull(), to_point).otherwise(to_segment) if mixed else to_segment


@dataclass(frozen=True)
class Extent:
    """What has to be known of a target set before it is put on a grid."""

    max_abs_lat: float
    rows: int
    degrees: float
    text_bytes: float = 0.0

    @staticmethod
    def measure(targets: DataFrame) -> Extent:
        """One aggregate row over the targets."""
        if has_segments(targets):
            outer = F.greatest(F.abs("a_lat"), F.abs("b_lat"))
            length = F.greatest(
                F.abs(F.col("b_lat") - F.col("a_lat")), F.abs(F.col("b_lon") - F.col("a_lon"))
            )
        else:
            outer, length = F.abs("a_lat"), F.lit(0.0)
        texts = [c for c, kind in targets.dtypes if kind == "string"]
        width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
        row = targets.agg(F.max(outer), F.count("*"), F.sum(length), F.avg(width)).first()
        return Extent(row[0] or 0.0, row[1], row[2] or 0.0, row[3] or 0.0)

    def cell_bound(self, grid: Grid) -> float:
        """Upper bound on the rows of ``to_cells``: a strip of cells along a segment."""
        return 20 * (self.rows + self.degrees / min(grid.height, grid.width))

    def fits_broadcast(self, grid: Grid) -> bool:
        return self.cell_bound(grid) * (ROW_BYTES + self.text_bytes) <= BROADCAST_BYTES


def to_cells(targets: DataFrame, grid: Grid, pad: int) -> DataFrame:
    """Targets exploded to the cells in which points may look for them."""
    if has_segments(targets):
        return grid.cover(targets, "a_lat", "a_lon", "b_lat", "b_lon", pad)
    if pad:
        return grid.locate_around(targets, "a_lat", "a_lon")
    return grid.locate(targets, "a_lat", "a_lon")


def joinable_cells(targets: DataFrame, grid: Grid, extent: Extent) -> DataFrame:
    """Padded target cells, marked for the join that their number allows.

    The file size the optimizer goes by knows nothing of the explosion, so the
    measured bound decides. Up to ``BROADCAST_BYTES`` they are broadcast, and
    the points neither move nor can pile up on a cell. Beyond that both sides are
    sorted by cell, and adaptive execution splits the partition of a hot cell.
    """
    cells = to_cells(targets, grid, pad=1)
    return F.broadcast(cells) if extent.fits_broadcast(grid) else cells.hint("merge")
