"""Nearest target of each point, within a radius or without a limit."""

from __future__ import annotations

from math import ceil, floor, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.functions.geo import DISTANCE_DIGITS, METRES_PER_DEGREE, haversine_m
from snapgrid.operators.grid import CELL_X, CELL_Y, Grid
from snapgrid.operators.targets import Extent, distance_to, has_segments, joinable_cells
from snapgrid.session import stage_table

CROWDED_CELL = 256
# Targets that share a cell with a target, on the mean: a place has some three times as many candidates.
TYPICAL_CELL = 8
MAX_HALVINGS = 12
GROWTH = 4
# Targets aimed at in a leaf of the far search; each level cuts a cell in 4 x 4.
LEAF_TARGETS = 32
MAX_LEVELS = 12
_PLACE = ["lat", "lon"]


def places(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """Distinct coordinates of the points.

    Records pile up on the same coordinates, so this partial aggregate runs
    before anything is shuffled by cell and takes the largest piles away.
    """
    return (
        points.select(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
        .dropna(subset=_PLACE)
        .dropDuplicates(_PLACE)
    )


def _closest(candidates: DataFrame, target_id: str, ties: str) -> DataFrame:
    """Keep the closest candidates of each place; all of them on a tie, or one."""
    if ties not in ("all", "first"):
        raise ValueError("ties must be 'all' or 'first'")
    place = Window.partitionBy(*_PLACE)
    if ties == "first":
        nearest = F.row_number().over(place.orderBy("dist", target_id))
        return candidates.withColumn("_rank", nearest).where("_rank = 1").drop("_rank")
    closest = (
        candidates.withColumn("_rank", F.rank().over(place.orderBy("dist")))
        .where("_rank = 1")
        .drop("_rank")
    )
    # A polyline can be hit through several of its segments. Its rows are side by
    # side in the partitioning of the first window, so this adds no shuffle.
    previous = F.lag(target_id).over(place.orderBy(target_id))
    return (
        closest.withColumn("_previous", previous)
        .where(~F.col("_previous").eqNullSafe(F.col(target_id)))
        .drop("_previous")
    )


def _within(
    spots: DataFrame, targets: DataFrame, target_id: str, radius_m: float, extent: Extent, ties: str
) -> DataFrame:
    """Nearest target of each place among those at most ``radius_m`` away."""
    grid = Grid.for_radius(radius_m, extent.max_abs_lat)
    dist = distance_to(targets, F.col("lat"), F.col("lon"))
    half_unit = 0.5 * 10.0**-DISTANCE_DIGITS
    candidates = (
        grid.locate(spots, "lat", "lon")
        .join(joinable_cells(targets, grid, extent), [CELL_Y, CELL_X])
        # Rounding is dear, so it comes after the cut, which allows for it.
        .where(dist <= F.lit(float(radius_m) + half_unit))
        .select(*spots.columns, target_id, F.round(dist, DISTANCE_DIGITS).alias("dist"))
    )
    return _closest(candidates, target_id, ties)


def crowded_start(targets: DataFrame, radius_m: float, extent: Extent) -> float:
    """Radius at which no grid cell holds more than ``CROWDED_CELL`` targets and the cell of a target ``TYPICAL_CELL`` on the mean.

    Halves ``radius_m`` up to ``MAX_HALVINGS`` times. Targets that pile up on a place are parted
    by no radius, so the mean need not fall below twice that of the smallest cells. It only decides
    how the search goes, never what it finds.
    """
    grid = Grid.for_radius(radius_m, extent.max_abs_lat)
    finest = 2.0**MAX_HALVINGS
    cells = (
        targets.groupBy(
            F.floor(F.col("a_lat") * F.lit(finest / grid.height)).alias("y"),
            F.floor(F.col("a_lon") * F.lit(finest / grid.width)).alias("x"),
        )
        .count()
        .select("y", "x", F.col("count").alias("n"))
    )
    # The targets are counted once, by the smallest cells; larger ones are sums of those.
    cells = stage_table(cells, "crowding")
    mean = F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")
    typical = max(TYPICAL_CELL, 2 * (cells.agg(mean).first()[0] or 0))
    for level in range(MAX_HALVINGS + 1):
        shift = MAX_HALVINGS - level
        by_cell = cells.groupBy(F.shiftright("y", shift).alias("y"), F.shiftright("x", shift).alias("x"))
        most, met = by_cell.agg(F.sum("n").alias("n")).agg(F.max("n"), mean).first()
        if (most or 0) <= CROWDED_CELL and (met or 0) <= typical:
            return radius_m / 2**level
    return radius_m / 2**MAX_HALVINGS


def nearest_within(
    spots: DataFrame,
    targets: DataFrame,
    target_id: str,
    radius_m: float,
    ties: str = "all",
    start_m: float | None = None,
) -> DataFrame:
    """``lat, lon, <target_id>, dist`` for the places with a target in reach.

    ``spots`` has one row per ``lat, lon``; further columns of it are kept.
    ``start_m`` below the radius searches close by first and widens only for the
    places still without a hit: a hit is final, since every target in the smaller
    radius was a candidate. When it is not given, dense targets choose it, so that
    a crowded cell does not meet all of its points at the full radius.
    """
    extent = Extent.measure(targets)
    if start_m is None and extent.rows > CROWDED_CELL:
        start_m = crowded_start(targets, radius_m, extent)
    if start_m is None or start_m >= radius_m:
        return _within(spots, targets, target_id, radius_m, extent, ties)
    return _widen(spots, targets, target_id, extent, ties, _growing(start_m, radius_m))[0]


def nearest_any(
    spots: DataFrame,
    targets: DataFrame,
    target_id: str,
    start_m: float,
    rounds: int = 5,
    ties: str = "all",
) -> DataFrame:
    """Nearest target of every place, however far.

    The radius grows for the places without a hit. What is left after the last
    round lies far from everything, where a grid of that radius no longer helps;
    it descends a hierarchy of target cells, exactly.
    """
    ends = [c for c in ("a_lat", "a_lon", "b_lat", "b_lon") if c in targets.columns]
    targets = stage_table(targets.select(target_id, *ends).dropDuplicates(), "targets")
    radii = [r for r in (_whole_units(start_m * GROWTH**i) for i in range(rounds)) if r > 0]
    found, rest = _widen(spots, targets, target_id, Extent.measure(targets), ties, radii)
    if rest.isEmpty():
        return found
    far = _nearest_far(rest.select(*_PLACE), targets, target_id, ties)
    return found.unionByName(rest.join(far, _PLACE))


def _whole_units(radius_m: float) -> float:
    """``radius_m`` rounded down to the unit of rounded distances.

    A hit is final only if everything as near as it, after rounding, was a candidate.
    A radius within a unit would part two distances that round to the same.
    """
    units = 10**DISTANCE_DIGITS
    return floor(radius_m * units) / units


def _growing(start_m: float, radius_m: float) -> list[float]:
    radii = []
    while start_m < radius_m:
        radii.append(_whole_units(start_m))
        start_m *= GROWTH
    return [*[r for r in radii if r > 0], radius_m]


def _widen(
    spots: DataFrame, targets: DataFrame, target_id: str, extent: Extent, ties: str, radii: list[float]
) -> tuple[DataFrame, DataFrame]:
    """Search with growing radii; returns the hits and the places without one.

    Every round is written down once, hits and misses together, so the next one
    neither repeats it nor depends on its executors.
    """
    spots = stage_table(spots, "places")
    columns = spots.columns
    found: DataFrame | None = None
    for radius in radii:
        near = _within(spots.select(*_PLACE), targets, target_id, radius, extent, ties)
        done = stage_table(spots.join(near, _PLACE, "left"), "nearest")
        hits = done.where(F.col("dist").isNotNull())
        found = hits if found is None else found.unionByName(hits)
        spots = done.where(F.col("dist").isNull()).select(*columns)
        if spots.isEmpty():
            break
    return found, spots


def _nearest_far(spots: DataFrame, targets: DataFrame, target_id: str, ties: str) -> DataFrame:
    """Nearest targets of places far from all of them.

    The targets are summed up in a hierarchy of cells, each with its middle and its
    reach: how far a target of it may lie from there. From level to level a place
    keeps the cells that may hold its nearest target, which are those whose near side is
    no farther than the far side of the closest one, and meets only their parts. What
    is left are a few leaves for each place, whose targets are measured.
    """
    segments = has_segments(targets)
    lat, lon = (
        (F.col(f"a_{c}") + F.col(f"b_{c}")) / 2 if segments else F.col(f"a_{c}") for c in ("lat", "lon")
    )
    n, south, north, west, east = targets.agg(
        F.count("*"), F.min(lat), F.max(lat), F.min(lon), F.max(lon)
    ).first()
    if not n:
        return spots.select(*_PLACE, F.lit(None).cast(targets.schema[target_id].dataType).alias(target_id),
                            F.lit(None).cast("double").alias("dist")).where("false")
    levels = max(1, min(MAX_LEVELS, ceil(log(max(n / LEAF_TARGETS, 1), 16))))
    leaf = max(north - south, east - west, 1e-6) * 1.000001 / 4**levels
    y, x = ((F.floor((at - F.lit(low)) / F.lit(leaf))).cast("bigint") for at, low in ((lat, south), (lon, west)))
    placed = stage_table(targets.withColumns({"leaf_y": y, "leaf_x": x}), "far-targets")

    def apart(a: tuple[Column, Column], b: tuple[Column, Column], shrink: Column) -> Column:
        """The distance that ranks targets; for segments that of the plane around the place."""
        if not segments:
            return haversine_m(*a, *b)
        return F.sqrt(F.pow(b[0] - a[0], 2) + F.pow((b[1] - a[1]) * shrink, 2)) * METRES_PER_DEGREE

    def cells(level: int) -> DataFrame:
        """Cells of a level: their place, the cell above, their middle and reach."""
        shift, size = 2 * (levels - level), leaf * 4 ** (levels - level)
        y, x = F.shiftright("leaf_y", shift), F.shiftright("leaf_x", shift)
        mid = F.lit(south) + (y + 0.5) * size, F.lit(west) + (x + 0.5) * size
        ends = [("a_lat", "a_lon")] + ([("b_lat", "b_lon")] if segments else [])
        # A degree of longitude is nowhere longer than on the equator.
        out = [apart(mid, (F.col(p), F.col(q)), F.lit(1.0)) for p, q in ends]
        reach = F.greatest(*out) if segments else out[0]
        return (
            placed.groupBy(y.alias("y"), x.alias("x"))
            .agg(F.max(reach).alias("reach"))
            .select(
                "y", "x", F.shiftright("y", 2).alias("up_y"), F.shiftright("x", 2).alias("up_x"),
                (F.lit(south) + (F.col("y") + 0.5) * size).alias("mid_lat"),
                (F.lit(west) + (F.col("x") + 0.5) * size).alias("mid_lon"), "reach",
            )
        )

    # The first level has 16 cells at most.
    top = [F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in cells(1).drop("up_y", "up_x").collect()]
    near = spots.withColumn("cell", F.explode(F.array(*top))).select(*_PLACE, "cell.*")
    slack = 10.0**-DISTANCE_DIGITS
    for level in range(1, levels + 1):
        if level > 1:
            near = near.join(
                cells(level), (F.col("near_y") == F.col("up_y")) & (F.col("near_x") == F.col("up_x"))
            )
        away = apart((F.col("lat"), F.col("lon")), (F.col("mid_lat"), F.col("mid_lon")), F.cos(F.radians("lat")))
        bound = F.min(F.col("away") + F.col("reach")).over(Window.partitionBy(*_PLACE))
        near = (
            near.withColumn("away", away)
            .withColumn("bound", bound)
            .where(F.col("away") - F.col("reach") <= F.col("bound") * (1 + 1e-9) + 4 * slack)
            .select(*_PLACE, F.col("y").alias("near_y"), F.col("x").alias("near_x"))
        )
    dist = F.round(distance_to(targets, F.col("lat"), F.col("lon")), DISTANCE_DIGITS)
    candidates = near.join(
        placed, (F.col("near_y") == F.col("leaf_y")) & (F.col("near_x") == F.col("leaf_x"))
    ).select(*_PLACE, target_id, dist.alias("dist"))
    return _closest(candidates, target_id, ties)


def snap(
    points: DataFrame,
    nodes: DataFrame,
    radius_m: float,
    lat: str = "latitude",
    lon: str = "longitude",
    target_id: str = "NODEID",
    distance_col: str = "snap_dist",
    ties: str = "all",
    start_m: float | None = None,
) -> DataFrame:
    """Each point with its nearest node in reach; points out of reach drop out.

    The search runs on distinct coordinates; the rows are joined back on the
    coordinates as read. ``nodes`` are targets (see ``operators.targets``).
    """
    near = nearest_within(
        places(points, lat, lon), nodes, target_id, radius_m, ties, start_m
    )
    return join_back(points, near, lat, lon, distance_col, "inner")


def join_back(
    points: DataFrame, near: DataFrame, lat: str, lon: str, distance_col: str, how: str = "left"
) -> DataFrame:
    """Bring a per-coordinate result back to every row with those coordinates."""
    renamed = near.withColumnsRenamed({"lat": lat, "lon": lon, "dist": distance_col})
    return points.join(renamed, [lat, lon], how)
