"""Targets stored in the order of a Z-curve: built once, read only where points are.

Under its folder:

    cells   the targets, one row for each base cell that they touch, sorted by key over ranges of keys
    about   one row: size of a base cell, number of rows, outermost latitude, targets in the fullest cell by level

The key interleaves the bits of a cell's row and column, so cells of every coarser level
are ranges of keys: one table serves all radii. Points look around in their own cells,
targets are never repeated by a search, and row groups outside the box of the points are
skipped by their statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.functions.geo import DISTANCE_DIGITS
from snapgrid.operators.grid import CELL_X, CELL_Y, Grid
from snapgrid.operators.nearest import CROWDED_CELL, GROWTH, _closest, _growing, _nearest_far, _whole_units, join_back, places
from snapgrid.operators.targets import BROADCAST_BYTES, ROW_BYTES, distance_to, has_segments
from snapgrid.session import stage_table

KEY = "zkey"
# Degrees of a base cell (some 11 metres), bits of a row or column, ranges of keys that a scan is cut to.
BASE_DEGREES, BITS, MAX_RANGES = 1e-4, 24, 32
_OFFSET = 1 << (BITS - 1)
# Bytes of a row group: small, so that a box of points skips most of them.
ROW_GROUP_BYTES = 4 << 20
# Masks that spread the bits of a number, widest step first.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(value: Column) -> Column:
    """The bits of a number of 24 bits, each followed by a zero."""
    for step, mask in _SPREAD:
        value = value.bitwiseOR(F.shiftleft(value, step)).bitwiseAND(F.lit(mask).cast("long"))
    return value


def key_of(y: Column, x: Column) -> Column:
    """The key of a cell from its row and column, both from 0."""
    return F.shiftleft(_spread(y.cast("long")), 1).bitwiseOR(_spread(x.cast("long")))


def _key_number(y: int, x: int) -> int:
    return sum((y >> b & 1) << (2 * b + 1) | (x >> b & 1) << (2 * b) for b in range(BITS))


def box_ranges(low: tuple[int, int], high: tuple[int, int], at_most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, both ends included, that hold every cell of a box of rows and columns.

    Halves the squares that lie partly in the box, largest first, while there are few enough.
    """
    whole = [(0, 0, BITS)]
    inside: list[tuple[int, int, int]] = []
    while whole and len(whole) + len(inside) + 3 <= at_most:
        y, x, bits = whole.pop(0)
        size = 1 << bits
        if bits == 0 or (low[0] <= y and low[1] <= x and y + size - 1 <= high[0] and x + size - 1 <= high[1]):
            inside.append((y, x, bits))
            continue
        half = size >> 1
        for dy in (0, half):
            for dx in (0, half):
                a, b = y + dy, x + dx
                if a <= high[0] and b <= high[1] and a + half - 1 >= low[0] and b + half - 1 >= low[1]:
                    whole.append((a, b, bits - 1))
    ranges = sorted((_key_number(y, x), _key_number(y, x) + (1 << 2 * bits) - 1) for y, x, bits in whole + inside)
    merged: list[tuple[int, int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


@dataclass(frozen=True)
class SpatialIndex:
    cells: DataFrame
    target_id: str
    degrees: float
    rows: int
    max_abs_lat: float
    fullest: list[int]

    def level(self, radius_m: float) -> int:
        """The finest level whose cells are no smaller than the radius."""
        grid = Grid.for_radius(radius_m, self.max_abs_lat)
        return min(BITS, max(0, math.ceil(math.log2(max(grid.height, grid.width) / self.degrees))))


def build_index(targets: DataFrame, path: str, target_id: str, degrees: float = BASE_DEGREES) -> SpatialIndex:
    """Store targets (see ``operators.targets``) with their ids under ``path``; the index stays until it is written anew."""
    grid, spark = Grid(degrees, degrees), targets.sparkSession
    ends = ["a_lat", "a_lon", *(["b_lat", "b_lon"] if has_segments(targets) else [])]
    slim = targets.select(target_id, *ends)
    placed = grid.cover(slim, *ends, pad=0) if has_segments(targets) else grid.locate(slim, *ends)
    keyed = placed.withColumn(KEY, key_of(F.col(CELL_Y) + _OFFSET, F.col(CELL_X) + _OFFSET)).drop(CELL_Y, CELL_X)
    keyed = stage_table(keyed, "spatial-keyed")
    keyed.repartitionByRange(KEY, F.xxhash64(target_id)).sortWithinPartitions(KEY).write.mode("overwrite").option(
        "parquet.block.size", ROW_GROUP_BYTES
    ).parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    outer = F.greatest(F.abs("a_lat"), F.abs("b_lat")) if has_segments(targets) else F.abs("a_lat")
    rows, outermost = cells.agg(F.count("*"), F.max(outer)).first()
    # Counted once by the smallest cells; the cells of a level are sums of those.
    counts = stage_table(cells.groupBy(KEY).agg(F.count("*").alias("n")), "spatial-counts")
    fullest = []
    for level in range(BITS + 1):
        by_cell = counts.groupBy(F.shiftright(KEY, 2 * level).alias("c")).agg(F.sum("n").alias("n"))
        fullest.append(by_cell.agg(F.max("n")).first()[0] or 0)
        if fullest[-1] > 64 * CROWDED_CELL or fullest[-1] == rows:
            break
    about = [(degrees, rows, outermost or 0.0, target_id, fullest)]
    spark.createDataFrame(about, "degrees double, rows long, max_abs_lat double, target_id string, fullest array<long>").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/about")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> SpatialIndex:
    degrees, rows, outermost, target_id, fullest = spark.read.parquet(f"{path}/about").first()
    return SpatialIndex(spark.read.parquet(f"{path}/cells"), target_id, degrees, rows, outermost, list(fullest))


def _cell(index: SpatialIndex, lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    row = lambda at: F.shiftright(F.floor(at / F.lit(index.degrees)).cast("long") + _OFFSET, level)
    return row(lat), row(lon)


def near_cells(index: SpatialIndex, spots: DataFrame, level: int) -> DataFrame:
    """The targets whose cells lie in the box of the places, a cell of the level wider; the scan skips the rest."""
    box = spots.agg(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
    if box[0] is None:
        return index.cells.where("false")
    top = (1 << BITS) - 1
    cell = [math.floor(v / index.degrees) + _OFFSET for v in box]
    low, high = ([min(top, max(0, ((c >> level) + d) * (1 << level) + (d > 0) * ((1 << level) - 1))) for c in part] for part, d in ((cell[:2], -1), (cell[2:], 1)))
    wanted = F.lit(False)
    for a, b in box_ranges(tuple(low), tuple(high)):
        wanted = wanted | F.col(KEY).between(a, b)
    return index.cells.where(wanted)


def _joined(index: SpatialIndex, spots: DataFrame, radius_m: float) -> DataFrame:
    """Places with the targets of their own and the neighbouring cells, far ones included."""
    level = index.level(radius_m)
    y, x = _cell(index, F.col("lat"), F.col("lon"), level)
    # One side is repeated nine times at most, and it is not the stored one.
    around = spots.withColumn("_y", F.explode(F.sequence(y - 1, y + 1))).withColumn("_x", F.explode(F.sequence(x - 1, x + 1)))
    around = around.withColumn("_near", key_of(F.col("_y"), F.col("_x"))).drop("_y", "_x")
    cells = near_cells(index, spots, level).withColumn("_cell", F.shiftright(KEY, 2 * level)).drop(KEY)
    fits = index.rows * ROW_BYTES <= BROADCAST_BYTES
    return around.join(F.broadcast(cells) if fits else cells.hint("merge"), F.col("_near") == F.col("_cell")).drop("_near", "_cell")


def _within(index: SpatialIndex, spots: DataFrame, radius_m: float, ties: str) -> DataFrame:
    dist = distance_to(index.cells, F.col("lat"), F.col("lon"))
    half_unit = 0.5 * 10.0**-DISTANCE_DIGITS
    found = _joined(index, spots, radius_m).where(dist <= F.lit(float(radius_m) + half_unit))
    return _closest(found.select(*spots.columns, index.target_id, F.round(dist, DISTANCE_DIGITS).alias("dist")), index.target_id, ties)


def _widen(index: SpatialIndex, spots: DataFrame, radii: list[float], ties: str) -> tuple[DataFrame, DataFrame]:
    """Search with growing radii; returns the hits and the places without one."""
    spots = stage_table(spots, "indexed-places")
    columns, found = spots.columns, None
    for radius in radii:
        near = _within(index, spots.select("lat", "lon"), radius, ties)
        done = stage_table(spots.join(near, ["lat", "lon"], "left"), "indexed-nearest")
        hits = done.where(F.col("dist").isNotNull())
        found = hits if found is None else found.unionByName(hits)
        spots = done.where(F.col("dist").isNull()).select(*columns)
        if spots.isEmpty():
            break
    return found, spots


def _start(index: SpatialIndex, radius_m: float) -> float:
    """Radius at which no cell holds more than CROWDED_CELL targets, as far down as base cells."""
    level = index.level(radius_m)
    full = [n > CROWDED_CELL for n in [*index.fullest, *[index.rows] * (BITS + 1 - len(index.fullest))]]
    while level > 0 and full[level]:
        level, radius_m = level - 1, radius_m / 2
    return radius_m


def nearest_within(index: SpatialIndex, spots: DataFrame, radius_m: float, ties: str = "all") -> DataFrame:
    """``lat, lon, <target_id>, dist`` as ``nearest.nearest_within`` finds them; further columns of ``spots`` are kept.

    Where targets are dense the search starts close by, as far as the stored counts say,
    and widens for places without a hit.
    """
    start = _start(index, radius_m)
    if start >= radius_m:
        return _within(index, spots, radius_m, ties)
    return _widen(index, spots, _growing(start, radius_m), ties)[0]


def nearest_any(index: SpatialIndex, spots: DataFrame, start_m: float, rounds: int = 5, ties: str = "all") -> DataFrame:
    """Nearest target of every place, however far, as ``nearest.nearest_any`` finds it."""
    radii = [r for r in (_whole_units(start_m * GROWTH**i) for i in range(rounds)) if r > 0]
    found, rest = _widen(index, spots, radii, ties)
    if rest.isEmpty():
        return found
    far = _nearest_far(rest.select("lat", "lon"), index.cells.drop(KEY).dropDuplicates(), index.target_id, ties)
    return found.unionByName(rest.join(far, ["lat", "lon"]))


def near_flag(index: SpatialIndex, points: DataFrame, flag: str, radius_m: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Add a 0/1 column as ``proximity.near_flag`` does: some target lies less than ``radius_m`` away."""
    spots = stage_table(places(points, lat, lon), "indexed-places")
    near = distance_to(index.cells, F.col("lat"), F.col("lon")) < F.lit(float(radius_m))
    hits = _joined(index, spots, radius_m).where(near).select(F.col("lat").alias(lat), F.col("lon").alias(lon)).distinct()
    return points.join(hits.withColumn(flag, F.lit(1)), [lat, lon], "left").na.fill(0, [flag]).select(*points.columns, flag)


def snap(
    index: SpatialIndex, points: DataFrame, radius_m: float, lat: str = "latitude", lon: str = "longitude", distance_col: str = "snap_dist", ties: str = "all"
) -> DataFrame:
    """Each point with its nearest stored target in reach; points out of reach drop out."""
    near = nearest_within(index, stage_table(places(points, lat, lon), "indexed-spots"), radius_m, ties)
    return join_back(points, near, lat, lon, distance_col, "inner")
