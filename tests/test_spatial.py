"""Grid joins against brute force, and the rules on ties, caps and segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapgrid.functions.geo import haversine_m, segment_distance_m
from snapgrid.operators import nearest, proximity, targets
from snapgrid.operators.grid import CELL_X, CELL_Y, Grid
from tests.conftest import plan_of

R = 6_371_008.8
DEG = R * np.pi / 180


def haversine(lat1, lon1, lat2, lon2):
    h = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(
        np.radians(lat2)
    ) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(h))


def to_segment(lat, lon, a_lat, a_lon, b_lat, b_lon):
    k = np.cos(np.radians(lat)) * DEG
    a = np.array([(a_lon - lon) * k, (a_lat - lat) * DEG])
    d = np.array([(b_lon - a_lon) * k, (b_lat - a_lat) * DEG])
    length2 = (d * d).sum()
    u = 0.0 if length2 == 0 else min(max(-(a * d).sum() / length2, 0.0), 1.0)
    return float(np.hypot(*(a + u * d)))


def random_places(seed, n, spread):
    rng = np.random.default_rng(seed)
    return [
        (i, float(40.7 + rng.uniform(-spread, spread)), float(-74.0 + rng.uniform(-spread, spread)))
        for i in range(n)
    ]


def frames(spark, points, nodes):
    p = spark.createDataFrame(points, "id bigint, latitude double, longitude double")
    n = spark.createDataFrame(nodes, "NODEID bigint, latitude double, longitude double")
    return p, targets.point_targets(n, "latitude", "longitude", "NODEID")


def brute_nearest(points, nodes, radius=float("inf")):
    found = set()
    for i, lat, lon in points:
        dists = [(round(haversine(lat, lon, a, b), 6), n) for n, a, b in nodes]
        best = min(d for d, _ in dists)
        if best <= radius:
            found |= {(i, n) for d, n in dists if d == best}
    return found


@pytest.mark.parametrize("radius,spread", [(15.24, 0.001), (500.0, 0.03), (40_000.0, 0.3)])
def test_snap_equals_brute_force(spark, radius, spread):
    points, nodes = random_places(1, 300, spread), random_places(2, 120, spread)
    p, n = frames(spark, points, nodes)
    ours = {(r.id, r.NODEID) for r in nearest.snap(p, n, radius).collect()}
    assert ours == brute_nearest(points, nodes, radius)


def test_snap_without_broadcast_and_with_growing_radius(spark, monkeypatch):
    points, nodes = random_places(3, 300, 0.02), random_places(4, 200, 0.02)
    p, n = frames(spark, points, nodes)
    expected = brute_nearest(points, nodes, 400.0)
    monkeypatch.setattr(targets, "BROADCAST_BYTES", 0)
    merged = nearest.snap(p, n, 400.0)
    assert "SortMergeJoin [_cell_y" in plan_of(merged)
    assert {(r.id, r.NODEID) for r in merged.collect()} == expected
    grown = nearest.snap(p, n, 400.0, start_m=20.0)
    assert {(r.id, r.NODEID) for r in grown.collect()} == expected


def test_crowded_targets_start_closer(spark):
    nodes = random_places(5, 2000, 0.0005)
    _, n = frames(spark, [(0, 40.7, -74.0)], nodes)
    start = nearest.crowded_start(n, 1000.0, targets.Extent.measure(n))
    assert start < 1000.0
    points = random_places(6, 50, 0.002)
    p, _ = frames(spark, points, nodes[:1])
    ours = {(r.id, r.NODEID) for r in nearest.snap(p, n, 1000.0).collect()}
    assert ours == brute_nearest(points, nodes, 1000.0)


def test_targets_many_to_a_cell_start_closer_than_the_largest_cell_asks(spark):
    # Some 60 targets to a cell of 500 m, nowhere more than CROWDED_CELL: a place would have some 180 candidates.
    nodes = random_places(31, 3_000, 0.02)
    points = random_places(32, 200, 0.021)
    p, n = frames(spark, points, nodes)
    extent = targets.Extent.measure(n)
    start = nearest.crowded_start(n, 500.0, extent)
    grid = Grid.for_radius(500.0, extent.max_abs_lat)
    assert grid.locate(n, "a_lat", "a_lon").groupBy(CELL_Y, CELL_X).count().agg(F.max("count")).first()[0] <= nearest.CROWDED_CELL
    assert start <= 250.0
    ours = {(r.id, r.NODEID) for r in nearest.snap(p, n, 500.0).collect()}
    assert ours == brute_nearest(points, nodes, 500.0)


def test_targets_on_one_place_do_not_shrink_the_start(spark):
    # Twelve nodes on each of 30 places far apart: no radius parts them.
    nodes = [(100 * k + j, 40.0 + k * 0.05, -74.0) for k in range(30) for j in range(12)]
    p, n = frames(spark, [(7, 40.0005, -74.0)], nodes)
    assert nearest.crowded_start(n, 500.0, targets.Extent.measure(n)) == 500.0
    assert {r.NODEID for r in nearest.snap(p, n, 500.0).collect()} == set(range(12))


def test_start_radius_does_not_part_distances_that_round_to_the_same(spark):
    nodes = [(1, 40.7 + 0.12207065 / DEG, -74.0), (2, 40.7 - 0.12207085 / DEG, -74.0)]
    p, n = frames(spark, [(7, 40.7, -74.0)], nodes)
    for start in (None, 500.0, 0.1220710, 0.12207075, 500.0 / 4096):
        rows = nearest.snap(p, n, 500.0, start_m=start).collect()
        assert {(r.NODEID, r.snap_dist) for r in rows} == {(1, 0.122071), (2, 0.122071)}
    spots = nearest.places(p, "latitude", "longitude")
    for start in (500.0, 500.0 / 4096, 0.12207075 / 4):
        assert nearest.nearest_any(spots, n, "NODEID", start).count() == 2


@pytest.mark.parametrize("ties", ["all", "first"])
def test_nearest_any_with_all_points_far_away(spark, ties):
    nodes = random_places(21, 3_000, 0.4) + [(9_000, 40.7, -74.0), (9_001, 40.7, -74.0)]
    points = random_places(22, 20, 9.0) + [(99, 40.7, -73.0), (98, -33.0, 18.0)]
    p, n = frames(spark, points, nodes)
    near = nearest.nearest_any(nearest.places(p, "latitude", "longitude"), n, "NODEID", 0.001, rounds=2, ties=ties)
    rows = nearest.join_back(p, near, "latitude", "longitude", "distance").collect()
    expected = brute_nearest(points, nodes)
    if ties == "first":
        expected = {(i, min(b for a, b in expected if a == i)) for i, _ in expected}
    assert {(r.id, r.NODEID) for r in rows} == expected


def test_cap_is_inclusive_and_ties_keep_all(spark):
    lat_step = 10.0 / DEG
    nodes = [(1, 40.7 - lat_step, -74.0), (2, 40.7 + lat_step, -74.0)]
    p, n = frames(spark, [(7, 40.7, -74.0)], nodes)
    tied = nearest.snap(p, n, 10.0)
    assert {(r.NODEID, r.snap_dist) for r in tied.collect()} == {(1, 10.0), (2, 10.0)}
    assert [r.NODEID for r in nearest.snap(p, n, 10.0, ties="first").collect()] == [1]
    assert nearest.snap(p, n, 9.9999).count() == 0


def test_copies_of_a_coordinate_and_null_coordinates(spark):
    points = [(i, 40.7, -74.0) for i in range(50)] + [(99, None, -74.0)]
    p, n = frames(spark, points, [(1, 40.7, -74.00001), (1, 40.7, -74.00001)])
    rows = nearest.snap(p, n, 15.24).collect()
    assert sorted(r.id for r in rows) == list(range(50))


def segments_frame(spark, legs):
    s = spark.createDataFrame(legs, "sid bigint, a double, b double, c double, d double")
    return targets.segment_targets(s, "a", "b", "c", "d", "sid")


def random_legs(seed, n, spread, length):
    rng = np.random.default_rng(seed)
    legs = []
    for i in range(n):
        a = (40.7 + rng.uniform(-spread, spread), -74.0 + rng.uniform(-spread, spread))
        b = (a[0] + rng.uniform(-length, length), a[1] + rng.uniform(-length, length))
        legs.append((i, float(a[0]), float(a[1]), float(b[0]), float(b[1])))
    # Level, upright and zero-length ones.
    legs += [(n, 40.7, -74.01, 40.7, -73.99), (n + 1, 40.69, -74.0, 40.71, -74.0), (n + 2, 40.7, -74.0, 40.7, -74.0)]
    return legs


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("length", [0.0005, 0.02])
def test_near_flag_equals_brute_force(spark, monkeypatch, broadcast, length):
    if not broadcast:
        monkeypatch.setattr(targets, "BROADCAST_BYTES", 0)
    points, legs = random_places(7, 200, 0.02), random_legs(8, 40, 0.02, length)
    p, _ = frames(spark, points, [(1, 0.0, 0.0)])
    flagged = proximity.near_flag(p, segments_frame(spark, legs), "flag", 50.0)
    plan = plan_of(flagged)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    ours = {r.id: r.flag for r in flagged.collect()}
    assert ours == {
        i: int(any(to_segment(lat, lon, *leg[1:]) < 50.0 for leg in legs)) for i, lat, lon in points
    }
    assert 0 < sum(ours.values()) < len(ours)


def test_flag_is_strict_and_ignores_direction(spark):
    step = 50.0 / DEG
    p, _ = frames(spark, [(1, 40.7, -74.0), (2, 40.7 + step * 0.01, -74.0)], [(1, 0.0, 0.0)])
    layer = spark.createDataFrame([(40.7 - step, -74.0)], "lat double, long double")
    flagged = proximity.near_flag(p, targets.point_targets(layer, "lat", "long"), "flag", 49.9999)
    assert {r.flag for r in flagged.collect()} == {0}
    forth = segments_frame(spark, [(1, 40.69, -74.01, 40.71, -73.99), (2, 40.71, -74.01, 40.69, -73.99)])
    back = segments_frame(spark, [(1, 40.71, -73.99, 40.69, -74.01), (2, 40.69, -73.99, 40.71, -74.01)])
    for layer in (forth, back):
        assert [r.flag for r in proximity.near_flag(p, layer, "flag").collect()] == [1, 1]


def test_outer_reference_is_not_taken_from_the_layer(spark):
    """The layer is made from columns with the same names as the points."""
    p, n = frames(spark, [(1, 40.7, -74.0), (2, 40.8, -74.0)], [(1, 40.7, -74.0)])
    assert {r.id: r.flag for r in proximity.near_flag(p, n, "flag").collect()} == {1: 1, 2: 0}


def test_layers_at_once_equal_one_by_one(spark):
    points = random_places(9, 150, 0.02)
    p, spots = frames(spark, points, random_places(10, 60, 0.02))
    layers = {
        "near_spot": spots.drop("NODEID"),
        "near_leg": segments_frame(spark, random_legs(11, 30, 0.02, 0.01)).drop("sid"),
    }
    together = {(r.id, r.near_spot, r.near_leg) for r in proximity.near_flags(p, layers, "id", 200.0).collect()}
    alone = p
    for flag, layer in layers.items():
        alone = proximity.near_flag(alone, layer, flag, 200.0)
    assert together == {(r.id, r.near_spot, r.near_leg) for r in alone.collect()}
    assert len(together) == 150


def test_nearest_any_reaches_far_points(spark):
    points = random_places(12, 60, 0.01) + [(900, 41.9, -70.0), (901, 10.0, 20.0)]
    legs = random_legs(13, 50, 0.01, 0.002)
    p, _ = frames(spark, points, [(1, 0.0, 0.0)])
    near = nearest.nearest_any(
        nearest.places(p, "latitude", "longitude"), segments_frame(spark, legs), "sid", 20.0,
        rounds=3,
    )
    rows = nearest.join_back(p, near, "latitude", "longitude", "distance").collect()
    expected = set()
    for i, lat, lon in points:
        dists = [(round(to_segment(lat, lon, *leg[1:]), 6), leg[0]) for leg in legs]
        best = min(dists)[0]
        expected |= {(i, sid) for d, sid in dists if d == best}
    assert {(r.id, r.sid) for r in rows} == expected


def test_polyline_hit_through_a_shared_vertex_counts_once(spark):
    line = spark.createDataFrame(
        [("Elm", [[-74.001, 40.701], [-74.0, 40.7], [-73.999, 40.701]])],
        "name string, coordinates array<array<double>>",
    )
    p, _ = frames(spark, [(1, 40.6999, -74.0)], [(1, 0.0, 0.0)])
    legs = targets.polyline_targets(line, "coordinates", "name")
    assert legs.count() == 2
    near = nearest.nearest_within(nearest.places(p, "latitude", "longitude"), legs, "name", 100.0)
    assert [r.name for r in near.collect()] == ["Elm"]


def test_cells_cover_everything_within_the_radius(spark):
    """Every cell pair that a hit within the radius needs is in the padded cover."""
    grid = Grid.for_radius(100.0, 41.0)
    legs = segments_frame(spark, [(1, 40.70, -74.02, 40.72, -73.97)])
    cells = {(r[CELL_Y], r[CELL_X]) for r in targets.to_cells(legs, grid, 1).collect()}
    rows = targets.to_cells(legs, grid, 1).count()
    assert rows == len(cells)
    rng = np.random.default_rng(0)
    for _ in range(2000):
        t = rng.uniform()
        lat = 40.70 + 0.02 * t + rng.uniform(-100, 100) / DEG
        lon = -74.02 + 0.05 * t + rng.uniform(-100, 100) / DEG
        if to_segment(lat, lon, 40.70, -74.02, 40.72, -73.97) <= 100.0:
            assert (int(np.floor(lat / grid.height)), int(np.floor(lon / grid.width))) in cells


def test_distances(spark):
    row = spark.range(1).select(
        haversine_m(*[F.lit(x) for x in (40.7, -74.0, 40.8, -73.9)]).alias("h"),
        segment_distance_m(*[F.lit(x) for x in (40.7, -74.0, 40.701, -74.001, 40.701, -73.999)]).alias("s"),
        segment_distance_m(*[F.lit(x) for x in (40.7, -74.0, 40.701, -74.0, 40.701, -74.0)]).alias("z"),
    ).first()
    assert row.h == pytest.approx(haversine(40.7, -74.0, 40.8, -73.9))
    assert row.s == pytest.approx(0.001 * DEG)
    assert row.z == pytest.approx(0.001 * DEG)
