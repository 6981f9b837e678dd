"""The stored index finds what the searches without one find, and its scans skip what lies elsewhere."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from snapgrid.operators import nearest, proximity, spatial_index, targets
from snapgrid.plans import ranking
from tests.conftest import plan_of
from tests.test_spatial import brute_nearest, frames, random_places


def test_keys_interleave_rows_and_columns(spark):
    rng = np.random.default_rng(1)
    cells = [(int(y), int(x)) for y, x in rng.integers(0, 1 << 24, (200, 2))] + [(0, 0), (0, 1), (1, 0), ((1 << 24) - 1, (1 << 24) - 1)]
    df = spark.createDataFrame(cells, "y long, x long").withColumn("k", spatial_index.key_of(F.col("y"), F.col("x")))
    for r in df.collect():
        assert r.k == int("".join(a + b for a, b in zip(f"{r.y:024b}", f"{r.x:024b}")), 2) == spatial_index._key_number(r.y, r.x)


def test_ranges_hold_every_cell_of_the_box(spark):
    rng = np.random.default_rng(2)
    for _ in range(40):
        y, x, h, w = (int(v) for v in (*rng.integers(0, 1 << 16, 2), *rng.integers(0, 300, 2)))
        ranges = spatial_index.box_ranges((y, x), (y + h, x + w))
        assert 0 < len(ranges) <= spatial_index.MAX_RANGES and ranges == sorted(ranges)
        for a in {y, y + h, y + h // 2}:
            for b in {x, x + w, x + w // 3}:
                assert any(low <= spatial_index._key_number(a, b) <= high for low, high in ranges)
        assert sum(b - a + 1 for a, b in ranges) < 60 * (h + 8) * (w + 8) + 40 * max(h, w) ** 2


@pytest.fixture(params=[64 << 20, 0], ids=["broadcast", "merge"])
def small(request, monkeypatch):
    monkeypatch.setattr(spatial_index, "BROADCAST_BYTES", request.param)


@pytest.mark.parametrize("radius, spread", [(15.24, 0.001), (500.0, 0.03), (40_000.0, 0.3)])
def test_snap_equals_brute_force(spark, tmp_path, small, radius, spread):
    points, nodes = random_places(1, 300, spread), random_places(2, 120, spread)
    nodes += [(1_000, *nodes[3][1:]), (1_001, *nodes[3][1:])]
    points += [(900, *nodes[3][1:]), (901, None, 3.0)]
    p, n = frames(spark, points, nodes)
    index = spatial_index.build_index(n, str(tmp_path / "i"), "NODEID")
    got = {(r.id, r.NODEID) for r in spatial_index.snap(index, p, radius).collect()}
    assert got == brute_nearest(points[:-1], nodes, radius) == {(r.id, r.NODEID) for r in nearest.snap(p, n, radius).collect()}
    first = spatial_index.snap(index, p, radius, ties="first").where("id = 900").collect()
    assert [r.NODEID for r in first] == [3]


def test_crowded_targets_are_searched_close_by_first(spark, tmp_path):
    points, nodes = random_places(3, 150, 0.002), random_places(5, 2_000, 0.0005)
    p, n = frames(spark, points, nodes)
    index = spatial_index.build_index(n, str(tmp_path / "i"), "NODEID")
    assert spatial_index._start(index, 1_000.0) < 1_000.0 and spatial_index._start(index, 5.0) == 5.0
    assert {(r.id, r.NODEID) for r in spatial_index.snap(index, p, 1_000.0).collect()} == brute_nearest(points, nodes, 1_000.0)


def test_segments_and_far_places(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b), float(a + da), float(b + db)) for i, (a, b, da, db) in enumerate(
        np.column_stack([40.7 + rng.uniform(-0.02, 0.02, 60), -74 + rng.uniform(-0.02, 0.02, 60), rng.uniform(-0.01, 0.01, (60, 2))]))]
    layer = spark.createDataFrame(rows, "segment_id long, a_lat double, a_lon double, b_lat double, b_lon double")
    index = spatial_index.build_index(layer, str(tmp_path / "s"), "segment_id", degrees=1e-3)
    points = spark.createDataFrame([*random_places(7, 80, 0.03), (500, 41.9, -72.0), (501, 40.7, -60.0)], "id long, latitude double, longitude double")
    spots = nearest.places(points, "latitude", "longitude")
    rounded = lambda df: {(r.lat, r.lon, r.segment_id, r.dist) for r in df.collect()}
    assert rounded(spatial_index.nearest_any(index, spots, 50.0)) == rounded(nearest.nearest_any(spots, layer, "segment_id", 50.0))
    for radius in (30.0, 400.0):
        flagged = spatial_index.near_flag(index, points, "near", radius)
        assert sorted(flagged.collect()) == sorted(proximity.near_flag(points, layer, "near", radius).collect())


def test_files_are_in_key_order_and_scans_skip(spark, tmp_path):
    n = targets.point_targets(
        spark.createDataFrame(random_places(8, 4_000, 5.0), "NODEID bigint, latitude double, longitude double"), "latitude", "longitude", "NODEID"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    index = spatial_index.build_index(n, str(tmp_path / "i"), "NODEID")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    bounds = []
    for file in glob.glob(f"{tmp_path}/i/cells/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index("zkey")
        bounds += [(s.min, s.max) for s in (meta.row_group(k).column(at).statistics for k in range(meta.num_row_groups))]
    bounds.sort()
    assert len(bounds) > 1 and all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))
    spot = spark.createDataFrame([(40.7, -74.0), (40.71, -74.01)], "lat double, lon double")
    cells = spatial_index.near_cells(index, spot, index.level(1_000.0))
    assert "PushedFilters" in plan_of(cells) and "zkey" in plan_of(cells).split("PushedFilters")[1]
    assert cells.count() < 200 and spatial_index.near_cells(index, spot.limit(0), 3).count() == 0


def test_ranking_with_an_index(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 40.7, -74.0), (2, 40.71, -74.0)], "NODEID bigint, latitude double, longitude double")
    crashes = spark.createDataFrame([(k, 40.7 + 0.01 * (k % 2), -74.0) for k in range(9)], "collision_id long, latitude double, longitude double")
    index = spatial_index.build_index(targets.point_targets(nodes, "latitude", "longitude", "NODEID"), str(tmp_path / "i"), "NODEID")
    near = ranking.place_nodes(crashes, nodes, index=spatial_index.open_index(spark, str(tmp_path / "i")))
    assert index.rows == 2 and sorted(near.collect()) == sorted(ranking.place_nodes(crashes, nodes).collect())
