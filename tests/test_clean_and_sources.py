"""Cleaning rules, readers, layers, cache and incremental ingestion."""

import json
import os

import pytest
from pyspark.sql import functions as F

from snapgrid import session
from snapgrid.operators import clean
from snapgrid.plans.flags import flag_table
from snapgrid.sources import layers, readers, schemas
from snapgrid.streaming.ingest import ingest_pages

RAW = [
    {"collision_id": "1", "crash_date": "2024-03-01T00:00:00.000", "latitude": "40.4", "longitude": "-74.3",
     "number_of_persons_injured": "2"},
    {"collision_id": "2.0", "crash_date": "bad", "latitude": "41.0", "longitude": "-73.6",
     "number_of_persons_injured": "two"},
    {"collision_id": "3", "latitude": "0", "longitude": "-74.0"},
    {"collision_id": "4", "latitude": "41.0001", "longitude": "-74.0"},
    {"collision_id": "5", "latitude": "n/a", "longitude": "-74.0"},
    {"collision_id": "6", "latitude": "NaN", "longitude": "-74.0"},
    {"collision_id": "x", "latitude": "40.7", "longitude": "-74.0"},
]


def pages(spark, path, rows, array=False):
    path.mkdir()
    half = len(rows) // 2
    for i, part in enumerate((rows[:half], rows[half:])):
        text = json.dumps(part) if array else "\n".join(map(json.dumps, part))
        (path / f"page{i}.json").write_text(text)
    return str(path)


@pytest.mark.parametrize("array", [False, True])
def test_crash_pages_are_cleaned(spark, tmp_path, array):
    df = readers.read_crash_pages(spark, pages(spark, tmp_path / "p", RAW, array), multiline=array)
    rows = {r.collision_id: r for r in df.collect()}
    assert set(rows) == {"1", "2.0", "x"}
    assert rows["1"].number_of_persons_injured == 2.0
    assert rows["2.0"].number_of_persons_injured is None
    assert rows["2.0"].crash_date is None and rows["1"].crash_date.year == 2024
    assert rows["1"].number_of_persons_killed is None
    keyed = clean.keyed_crashes(df)
    assert sorted(r.collision_id for r in keyed.collect()) == [1, 2]


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" CRASH DATE", "Crash Date ", "zip"])
    tidy = clean.normalise_headers(df)
    assert tidy.columns == ["crash_date", "zip"] and tidy.first().crash_date == 1
    assert clean.normalise_headers(df.select("zip", " CRASH DATE"), lower=False, underscore=False).columns == [
        "zip", "CRASH DATE"
    ]


@pytest.mark.parametrize("text, number, key", [
    ("12d", None, None), ("7f", None, None), ("inf", None, None), ("-Infinity", None, None), ("1e400", None, None), ("NaN", None, None),
    (" 12 ", 12.0, 12), ("12.0", 12.0, 12), ("-1.5e3", -1500.0, -1500), (".5", 0.5, 0), ("5.", 5.0, 5), ("1,5", None, None), ("", None, None),
])
def test_numbers_and_keys(spark, text, number, key):
    row = spark.createDataFrame([(text,)], "t string").select(
        clean.to_number(F.col("t")).alias("n"), clean.to_integer_key(F.col("t")).alias("k")
    ).first()
    assert (row.n, row.k) == (number, key)


@pytest.mark.parametrize("text, day", [
    ("09/11/2021", "2021-09-11 00:00:00"), ("9/1/2021 3:05", "2021-09-01 03:05:00"), ("12/31/2021 11:59:58 PM", "2021-12-31 23:59:58"),
    ("2021-09-11T01:02:03", "2021-09-11 01:02:03"), ("2021-09-11", "2021-09-11 00:00:00"), ("13/13/2021", None), ("x", None), (None, None),
])
def test_dates(spark, text, day):
    row = spark.createDataFrame([(text,)], "t string").select(F.date_format(clean.to_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("d")).first()
    assert row.d == day


def test_typed_csv_goes_by_name(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Keywords,Title, doc id\nx,A,1\ny,B,2d\n")
    rows = readers.read_csv(spark, str(tmp_path / "c.csv"), schemas.CORPUS).collect()
    assert [tuple(r) for r in rows] == [(1, "A", "x"), (None, "B", "y")]
    with pytest.raises(ValueError, match="weight"):
        readers.read_csv(spark, str(tmp_path / "c.csv"), "Title string, weight double")


def test_cache_of_a_failed_build_is_not_read(spark, tmp_path):
    path = tmp_path / "cache"
    path.mkdir()
    spark.range(9).write.parquet(str(tmp_path / "whole"))
    next((tmp_path / "whole").glob("part-*.parquet")).rename(path / "part-0.parquet")
    assert readers.read_through(spark, str(path), lambda: spark.range(3).toDF("id")).count() == 3
    assert readers.read_through(spark, str(path), lambda: spark.range(7).toDF("id")).count() == 3
    with pytest.raises(ZeroDivisionError):
        readers.read_through(spark, str(tmp_path / "other"), lambda: 1 / 0)
    assert readers.read_through(spark, str(tmp_path / "other"), lambda: spark.range(2).toDF("id")).count() == 2


def test_single_lines_and_multilines_in_one_layer(spark):
    rows = [("LineString", "[[-74.0,40.7],[-74.0,40.8],[-74.1,40.8]]"), ("MultiLineString", "[[[-74.0,40.7],[-74.0,40.8]]]"),
            ("Point", "[-74.0,40.7]"), ("MultiPoint", "[[-74.0,40.7],[-74.1,40.7]]"), (None, "[[[1.0,2.0],[1.0,3.0]]]"), ("LineString", "oops"), ("LineString", None)]
    layer = spark.createDataFrame([(r,) for r in rows], schemas.GEOMETRY_PAGE)
    assert layers.geo_multiline_layer(layer).count() == 4
    assert layers.geo_multipoint_layer(layer).count() == 3
    assert layers.geo_point_layer(layer).count() == 1


def test_big_keys_stay_exact(spark):
    df = spark.createDataFrame([("9007199254740993",), ("7.0",), ("1e400",), (None,)], "k string")
    assert [r[0] for r in df.select(clean.to_integer_key(F.col("k"))).collect()] == [
        9007199254740993, 7, None, None
    ]


def test_union_pages_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([(2,)], "id int")
    assert {(r.id, r.s) for r in clean.union_pages(a, b).collect()} == {(1, "x"), (2, None)}


def test_csv_round_trip_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'A "quoted", name', "00501")], "id int, name string, zip string")
    readers.write_csv(df, str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c")).first().asDict() == {
        "id": "1", "name": 'A "quoted", name', "zip": "00501"
    }
    typed = readers.read_csv(spark, str(tmp_path / "c"), "id int, name string, zip string")
    assert typed.first().id == 1


def test_cache_is_read_through(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3).toDF("id")

    path = str(tmp_path / "cache")
    for _ in range(2):
        assert readers.read_through(spark, path, build).count() == 3
    assert len(built) == 1
    readers.read_through(spark, path, build, use_cache=False)
    assert len(built) == 2


def test_streamed_pages_equal_the_batch_and_count_once(spark, tmp_path):
    source = pages(spark, tmp_path / "in", RAW)
    args = (source, str(tmp_path / "out"), str(tmp_path / "state"))
    ingest_pages(spark, *args, pages_per_batch=1).awaitTermination()
    batch = readers.read_crash_pages(spark, source)
    assert sorted(spark.read.parquet(args[1]).collect()) == sorted(batch.collect())
    (tmp_path / "in" / "page9.json").write_text(json.dumps({**RAW[0], "collision_id": "10"}))
    ingest_pages(spark, *args).awaitTermination()
    assert {r.collision_id for r in spark.read.parquet(args[1]).collect()} == {"1", "2.0", "x", "10"}
    assert spark.read.parquet(args[1]).count() == 4


def geometry(kind, coordinates, **more):
    return {"the_geom": {"type": kind, "coordinates": coordinates}, **more}


def test_all_thirteen_layers(spark, tmp_path):
    """One node at every layer, one node at none, and records that must be passed over."""
    lat, lon = 40.7, -74.0
    cross = [[[lon - 0.01, lat - 0.01], [lon + 0.01, lat + 0.01]]]
    away = [[[lon - 0.3, lat], [lon - 0.29, lat]]]
    latlong = [{"lat": str(lat), "long": str(lon)}, {"lat": None, "long": "1"}, {"lat": "x", "long": "1"}]
    contents = {
        schemas.LAT_LONG_PAGE: latlong,
        schemas.FROM_TO_PAGE: [
            {"fromlatitude": str(lat + 0.01), "fromlongitude": str(lon - 0.01),
             "tolatitude": str(lat - 0.01), "tolongitude": str(lon + 0.01)},
            {"fromlatitude": "40.9"},
        ],
        schemas.RATED_GEOMETRY_PAGE: [geometry("MultiLineString", cross, systemrating="3.4"), geometry("MultiLineString", cross)],
    }
    by_flag = {
        "Is_Protected_Intersection": [geometry("MultiPoint", [[lon - 0.3, lat], [lon, lat]]), {"the_geom": None}],
        # The hit is on the second line, and on its second segment.
        "Has_Bus_Lane": [geometry("MultiLineString", [*away, [[lon - 0.2, lat], [lon - 0.1, lat], [lon + 0.1, lat]]])],
        "Has_Speed_Hump": [geometry("MultiLineString", cross)],
        "Is_Bike_Route": [geometry("MultiLineString", cross)],
    }
    points = [geometry("Point", [lon, lat]), geometry("Point", [lon, lat, 3.0]), geometry("Point", None), {}]
    for flag, layer in layers.LAYERS.items():
        rows = by_flag.get(flag) or contents.get(layer.schema) or points
        folder = tmp_path / layer.folder
        folder.mkdir()
        (folder / "page.json").write_text("\n".join(map(json.dumps, rows)))
    rankings = spark.createDataFrame(
        [(1, 5, 0.0, 1.0, 9.0, 1.0, "A & B", lat, lon), (2, 4, 0.0, 0.0, 4.0, 0.0, "C", lat + 0.05, lon)],
        schemas.RANKINGS,
    )
    table = flag_table(rankings, layers.read_layers(spark, str(tmp_path)))
    rows = {r.NODEID: r for r in table.collect()}
    assert table.columns[9:] == list(layers.LAYERS)
    assert {c for c in layers.LAYERS if rows[1][c] != 1} == set()
    assert {c for c in layers.LAYERS if rows[2][c] != 0} == set()
    assert len(layers.LAYERS) == 13


def test_pavement_rating_is_tested(spark):
    good = spark.createDataFrame(
        [(("MultiLineString", "[[[-74.0,40.7],[-74.0,40.8]]]"), "3.5")], schemas.RATED_GEOMETRY_PAGE
    )
    assert layers.bad_pavement_layer(good).count() == 0
    assert layers.bad_pavement_layer(good.withColumn("systemrating", F.lit("3.49"))).count() == 1


def test_stage_tables_live_in_the_checkpoint_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert session.stage_root(spark) == root
    staged = session.stage_table(spark.range(4).toDF("id"), "numbers")
    assert staged.count() == 4 and staged.inputFiles()[0].startswith(f"file://{root}")
    folder = staged.inputFiles()[0].removeprefix("file://")
    session.drop_stage_tables(spark)
    assert not os.path.exists(folder)
