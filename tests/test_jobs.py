"""The whole chain through files, from landed pages to recommendations."""

import json

import pytest

from snapgrid import jobs
from snapgrid.sources import layers, readers, schemas


@pytest.fixture(scope="module")
def files(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("chain")
    causes = ["Backing Unsafely", "Unsafe Speed", "Unspecified"]
    crashes = [
        {
            "collision_id": str(i), "crash_date": f"202{i % 4}-0{i % 9 + 1}-11T00:00:00.000",
            "crash_time": f"{i % 24}:05", "latitude": f"{40.7 + i % 6 * 0.01:.5f}", "longitude": "-74.00001",
            "number_of_persons_injured": str(i % 3), "number_of_persons_killed": str(int(i % 30 == 0)),
            "contributing_factor_vehicle_1": causes[(i % 6 // 3 + i // 40) % 3],
        }
        for i in range(120)
    ]
    (root / "crashes").mkdir()
    (root / "crashes" / "page0.json").write_text(json.dumps(crashes[:60]))
    (root / "crashes" / "page1.json").write_text(json.dumps(crashes[60:]))
    nodes = [(i, 40.7 + i * 0.01, -74.0) for i in range(6)]
    spark.createDataFrame(nodes, schemas.NODES).write.parquet(str(root / "nodes"))
    edges = [(i, i + 1, f"STREET {i}") for i in range(5)]
    spark.createDataFrame(edges, schemas.STREET_EDGES).write.parquet(str(root / "edges"))
    for flag, layer in layers.LAYERS.items():
        (root / "layers" / layer.folder).mkdir(parents=True)
        rows = [{"lat": "40.7", "long": "-74.0"}] if layer.schema == schemas.LAT_LONG_PAGE else []
        (root / "layers" / layer.folder / "page.json").write_text("\n".join(map(json.dumps, rows)))
    (root / "corpus.csv").write_text("Doc ID,Title,Keywords\n1,Speed Humps,unsafe speed calming\n2,Daylighting,backing visibility\n")
    (root / "truth.csv").write_text("predicted_cause,title\nUnsafe Speed,Speed Humps\nBacking Unsafely,Speed Humps\n")
    lines = [(1, "STREET 0", [[-74.001, 40.69], [-74.001, 40.76]])]
    spark.createDataFrame(lines, schemas.CENTERLINES).write.parquet(str(root / "centerlines"))
    (root / "export.csv").write_text("COLLISION_ID,CRASH DATE,LATITUDE,LONGITUDE,ZIP CODE\n1,2024-01-01,40.7,-74.0,00501\n2,,0,0,\n")
    return root


def test_chain(spark, files):
    def run(job, **paths):
        args = [x for k, value in paths.items() for x in ("--" + k.replace("_", "-"), str(value))]
        jobs.main([job, *args, "--out", str(files / "out")] + (["--multiline"] if "crashes" in paths and job != "streets" else []))

    out = files / "out"
    run("ingest", crashes=files / "crashes")
    assert spark.read.parquet(str(out / "ingested")).count() == 120
    run("rank", crashes=files / "crashes", nodes=files / "nodes", edges=files / "edges", as_of="2024-12-31")
    run("track", crashes=files / "crashes", nodes=files / "nodes", as_of="2024-12-31")
    tracked = readers.read_csv(spark, str(out / "tracked_rankings"))
    assert {(r.NODEID, r.crash_count) for r in tracked.collect()} == {(str(n), "20") for n in range(6)}
    ranked = readers.read_csv(spark, str(out / "rankings"), schemas.RANKINGS)
    assert ranked.count() == 6 and {r.crash_count for r in ranked.collect()} == {20}
    assert readers.read_csv(spark, str(out / "crash_to_node"), schemas.CRASH_TO_NODE).count() == 120

    run("flags", rankings=out / "rankings", layers=files / "layers")
    flagged = readers.read_csv(spark, str(out / "flags"), schemas.FLAGGED)
    assert {r.NODEID: r.Has_SIP + r.Has_Bus_Lane for r in flagged.collect()} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}

    run("causes", crashes=files / "crashes", node_map=out / "crash_to_node", rankings=out / "rankings",
        trees=5, depth=2, kind="forest")
    predicted = readers.read_csv(spark, str(out / "predictions"), schemas.PREDICTIONS)
    assert predicted.count() == 6 and predicted.where("actual_cause IS NULL OR NODEID <> ranked_node").count() == 0
    assert readers.read_csv(spark, str(out / "quality")).count() == 1

    run("score", crashes=files / "crashes", node_map=out / "crash_to_node", rankings=out / "rankings", model=out / "model")
    scored = readers.read_csv(spark, str(out / "scored"), schemas.PREDICTIONS)
    assert sorted(scored.collect()) == sorted(predicted.collect())
    assert readers.read_csv(spark, str(out / "scored_quality")).collect() == readers.read_csv(spark, str(out / "quality")).collect()

    run("recommend", rankings=out / "rankings", predictions=out / "predictions", corpus=files / "corpus.csv")
    run("index", corpus=files / "corpus.csv")
    run("fixes", flags=out / "flags", predictions=out / "predictions", corpus=files / "corpus.csv", index=out / "index")
    fit = {"Unsafe Speed": "Speed Humps", "Backing Unsafely": "Daylighting"}
    master = readers.read_csv(spark, str(out / "master"), schemas.MASTER).collect()
    assert len(master) == 6 and all(r.Top_Intervention == fit[r.predicted_cause] for r in master)
    fixed = readers.read_csv(spark, str(out / "fixes"), schemas.FLAGGED + ", Predicted_Fix string").collect()
    assert len(fixed) == 6 and all(r.Predicted_Fix in fit.values() for r in fixed)

    run("evaluate", predictions=out / "predictions", corpus=files / "corpus.csv", truth=files / "truth.csv")
    rows = {r["query"]: r["p_at_1"] for r in readers.read_csv(spark, str(out / "precision")).collect()}
    assert "Macro-Average" in rows and rows.get("Unsafe Speed", "1.0") == "1.0"

    run("streets", crashes=files / "export.csv", centerlines=files / "centerlines")
    street = spark.read.parquet(str(out / "streets")).collect()
    assert [(r.stname_lab, r.zip_code) for r in street] == [("STREET 0", "00501")]
    assert street[0].distance == pytest.approx(84.3, abs=0.1)
