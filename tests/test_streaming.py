"""Stateful ingestion: records that land again, corrections, retried batches, compaction."""

import json
import os

import pytest
from pyspark.sql import functions as F

from snapgrid.plans import ranking
from snapgrid.sources import readers
from snapgrid.streaming import sums
from snapgrid.streaming.ingest import ingest_distinct

NODES = [(1, 40.7, -74.0), (2, 40.71, -74.0), (3, 40.72, -74.0)]


def crash(key, node, injured=0, killed=0, day="2024-03-01", lat=None):
    lat = NODES[node - 1][1] if lat is None else lat
    return {"collision_id": str(key), "crash_date": f"{day}T00:00:00", "latitude": str(lat), "longitude": "-74.0",
            "number_of_persons_injured": str(injured), "number_of_persons_killed": str(killed)}


def land(folder, name, rows, at):
    folder.mkdir(exist_ok=True)
    path = folder / f"{name}.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    os.utime(path, (at, at))
    return str(folder)


def test_a_record_that_lands_again_is_appended_once(spark, tmp_path):
    rows = [crash(k, 1 + k % 3) for k in range(20)]
    keyless = [{**crash(0, 1), "collision_id": None}, {**crash(0, 2), "collision_id": None}, {**crash(0, 1), "collision_id": "7f"}]
    source = land(tmp_path / "in", "a", rows[:15] + keyless, 1_700_000_000)
    land(tmp_path / "in", "b", rows[10:] + keyless[:1] + [{**rows[3], "collision_id": "3.0"}], 1_700_000_060)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest_distinct(spark, source, out, state, pages_per_batch=1).awaitTermination()
    assert spark.read.parquet(out).count() == 23
    # The state outlives the run.
    land(tmp_path / "in", "c", rows[5:8] + keyless[1:] + [crash(99, 1)], 1_700_000_120)
    ingest_distinct(spark, source, out, state).awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == 24 and found.columns == [c for c in readers.read_crash_pages(spark, source).columns]


def test_state_older_than_the_delay_is_let_go(spark, tmp_path):
    day = 86_400
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(4):
        source = land(tmp_path / "in", f"p{k}", [crash(k, 1)], 1_700_000_000 + 30 * day * k)
        query = ingest_distinct(spark, source, out, state, delay="10 days")
        query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(out).count() == 4 and held[-1] <= 2


def expected(spark, rows, as_of):
    """The ranking of the last versions by the batch plan."""
    last = list({r["collision_id"]: r for r in rows}.values())
    crashes = readers.clean_crashes(spark.createDataFrame(last))
    nodes = spark.createDataFrame(NODES, "NODEID long, latitude double, longitude double")
    ranked = ranking.rank_nodes(crashes, nodes, as_of)
    return rounded(ranked)


def rounded(df):
    return sorted(
        tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        for r in df.select("NODEID", "crash_count", "total_killed", "total_injured", "severity_score", "severity_score_norm").collect()
    )


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame(NODES, "NODEID long, latitude double, longitude double")


PAGES = [
    [crash(k, 1 + k % 3, injured=k % 4, day=f"2023-0{1 + k % 9}-05") for k in range(30)] + [crash("x", 1), {"collision_id": "500"}],
    [crash(k, 1 + k % 3, injured=k % 4, day=f"2023-0{1 + k % 9}-05") for k in range(10, 20)] + [crash(31, 2, killed=1)],
    [crash(4, 3, injured=9), crash(5, 1, lat=0), crash(6, 2, lat="n/a"), crash(7, 2, lat=40.75), crash(500, 1), {**crash(8, 1), "crash_date": "?"}],
    [crash(5, 1, injured=1), crash(4, 3, injured=9), crash(31, 2, killed=1)],
]


def test_sums_follow_corrections_and_can_be_read_for_any_day(spark, nodes, tmp_path):
    root, seen = str(tmp_path / "root"), []
    for k, page in enumerate(PAGES):
        source = land(tmp_path / "in", f"p{k}", page, 1_700_000_000 + 60 * k)
        seen += [r for r in page if r["collision_id"] != "x"]
        sums.track_sums(spark, source, root, nodes, "2024-01-01" if k % 2 else "2025-01-01").awaitTermination()
        for day in ("2023-06-01", "2025-03-01"):
            assert rounded(sums.ranked_sums(spark, root, day)) == expected(spark, seen, day)


def test_a_batch_that_runs_again_counts_once(spark, nodes, tmp_path):
    root = str(tmp_path / "root")
    targets = sums.point_targets(nodes, "latitude", "longitude", "NODEID")
    schema = "collision_id string, crash_date string, latitude string, longitude string, number_of_persons_injured string, number_of_persons_killed string"
    seen = []
    for n, page in enumerate(PAGES):
        seen += [r for r in page if r["collision_id"] != "x"]
        rows = spark.createDataFrame(page, schema).withColumn("landed", F.timestamp_seconds(F.lit(1_700_000_000 + n)))
        sums.apply_batch(rows, n, root, targets, "2024-01-01")
        before = rounded(sums.ranked_sums(spark, root, "2024-01-01"))
        sums.apply_batch(rows, n, root, targets, "2024-01-01")
        assert rounded(sums.ranked_sums(spark, root, "2024-01-01")) == before == expected(spark, seen, "2024-01-01")
        if n == 1:
            sums.compact(spark, root)
            parts = ("versions", "sums", "versions-base", "sums-base")
            assert [sorted(os.listdir(f"{root}/{p}")) for p in parts] == [[], [], ["batch=1"], ["batch=1"]]
            assert rounded(sums.ranked_sums(spark, root, "2024-01-01")) == before
    # What lands late with an older time changes nothing.
    old = spark.createDataFrame(PAGES[0], schema).withColumn("landed", F.timestamp_seconds(F.lit(1_699_000_000)))
    sums.apply_batch(old, len(PAGES), root, targets, "2024-01-01")
    assert rounded(sums.ranked_sums(spark, root, "2024-01-01")) == before


def test_nothing_landed(spark, tmp_path):
    assert sums.node_sums(spark, str(tmp_path / "none"), "2024-01-01").count() == 0
    sums.compact(spark, str(tmp_path / "none"))
