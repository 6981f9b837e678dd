"""Cleaning reports from one pass; merged sketches within their stated errors."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapgrid.operators import clean, quality_report, sketches

RAW = [
    ("1", "2024-03-01", "40.7", "-74.0", "2"), ("2.0", "bad", "40.7", "-74.0", "two"), ("x", None, "40.7", "-74.0", ""), ("4", "3/4/2024", "0", "-74.0", "1"),
    ("5", "2024-03-01", "41.5", "-74.0", "1"), ("6", "2024-03-01", None, "-74.0", "1"), ("7", "2024-03-01", " ", "x", "1"), ("8", "2024-03-01", "12d", "-74.0", "1"),
    ("9", "2024-03-01", "40.7", None, "1"), ("10", "2024-03-01", "40.7", "inf", "1"),
]
HEADERS = [" Collision ID", "CRASH DATE", "Latitude", "LONGITUDE ", "number of persons injured"]


def test_every_row_has_an_outcome_and_kept_rows_are_the_clean_ones(spark, tmp_path):
    raw = spark.createDataFrame(RAW, HEADERS)
    path = str(tmp_path / "rows")
    counts = quality_report.clean_and_write(raw, path)
    kept = quality_report.read_clean(spark, path)
    want = clean.clean_crashes(raw)
    assert sorted(kept.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    assert counts["rows"] == 10 and counts["kept"] == 3 and counts["kept with a warning"] == 2
    assert [counts[e] for e in quality_report.ERRORS] == [2, 1, 1, 1, 1, 1]
    assert [counts[w] for w in quality_report.WARNINGS] == [1, 1, 1] and counts["number_of_persons_injured not a number"] == 1
    assert json.loads(spark.read.text(f"{path}-report").first()[0]) == counts
    warned = {r.collision_id: r.warnings for r in spark.read.parquet(path).where("outcome = 'kept'").collect()}
    assert warned == {"1": [], "2.0": ["date not readable", "number_of_persons_injured not a number"], "x": ["key not a whole number", "date missing"]}
    assert {r.metric: r.n for r in quality_report.report(spark, counts).collect()} == counts


def test_numbers_that_are_typed_already_and_empty_tables(spark, tmp_path):
    raw = spark.createDataFrame([(1, 40.7, -74.0, 2), (2, None, -74.0, 1)], "collision_id long, latitude double, longitude double, number_of_x int")
    counts = quality_report.clean_and_write(raw, str(tmp_path / "a"))
    assert (counts["kept"], counts["latitude missing"], counts["date missing"]) == (1, 1, 2)
    assert set(quality_report.clean_and_write(raw.limit(0), str(tmp_path / "b")).values()) == {0}


def test_merged_quantiles_keep_their_rank_error(spark):
    rng = np.random.default_rng(3)
    values = rng.lognormal(size=20_000)
    rows = spark.createDataFrame([(int(k % 40), float(v)) for k, v in enumerate(values)] + [(0, None), (1, float("nan"))], "day int, v double").repartition(6)
    daily = sketches.quantile_sketches(rows, "v", "day")
    assert daily.count() == 40
    by_week = sketches.merged_quantiles(daily, (F.col("day") / 7).cast("int").alias("week"))
    shares = (0.05, 0.25, 0.5, 0.75, 0.99)
    whole = sketches.with_quantiles(sketches.merged_quantiles(by_week), shares).first()
    assert whole.n == 20_000 and (whole.low, whole.high) == (values.min(), values.max())
    for s in shares:
        assert abs((values <= whole[f"p{round(100 * s)}"]).mean() - s) <= 2 * sketches.KLL_RANK_ERROR
    week = sketches.with_quantiles(by_week, (0.5,)).where("week = 2").first()
    mine = values[(np.arange(20_000) % 40) // 7 == 2]
    assert week.n == len(mine) and abs((mine <= week.p50).mean() - 0.5) <= 2 * sketches.KLL_RANK_ERROR


def test_distinct_counts_of_unions_and_intersections(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("month"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("node"))
    rows = rows.unionByName(rows.limit(500).withColumn("node", F.lit(None).cast("long")))
    exact = {m: {r.node for r in rows.where(F.col("month") == m).collect()} - {None} for m in range(3)}
    made = sketches.distinct_sketches(rows, "node", "month").cache()
    for r in sketches.distinct_estimates(made).collect():
        assert r.distinct == pytest.approx(len(exact[r.month]), rel=4 * sketches.HLL_ERROR)
    union = sketches.distinct_estimates(sketches.merged_distinct(made)).first().distinct
    assert union == pytest.approx(len(set().union(*exact.values())), rel=4 * sketches.HLL_ERROR)
    one, two = (made.where(F.col("month") == m).select(F.col("theta").alias(f"t{m}")) for m in (0, 1))
    both = one.join(two, F.lit(True)).select(sketches.in_both(F.col("t0"), F.col("t1")), sketches.only_in_first(F.col("t0"), F.col("t1"))).first()
    slack = 4 * sketches.THETA_ERROR * len(exact[0] | exact[1])
    assert abs(both[0] - len(exact[0] & exact[1])) <= slack and abs(both[1] - len(exact[0] - exact[1])) <= slack
