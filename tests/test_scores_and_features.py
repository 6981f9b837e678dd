"""Severity, names, features, causes, weights and quality measures."""

from datetime import datetime
from math import exp, sqrt

import pytest

from snapgrid.operators import evaluation, features, names, severity, summary
from snapgrid.plans import ranking

CRASH = (
    "collision_id bigint, crash_date timestamp, crash_time string, latitude double, longitude double, "
    "number_of_persons_killed double, number_of_persons_injured double, number_of_pedestrians_injured double, "
    "number_of_pedestrians_killed double, number_of_cyclist_injured double, number_of_cyclist_killed double, "
    "number_of_motorist_injured double, contributing_factor_vehicle_1 string, NODEID bigint"
)


def crash(i, day=datetime(2024, 1, 1), time="12:00", lat=40.7, lon=-74.0, killed=0.0, injured=0.0,
          ped=0.0, cause="Backing Unsafely", node=1):
    return (i, day, time, lat, lon, killed, injured, ped, 0.0, 0.0, None, 0.0, cause, node)


def test_score_follows_the_formula(spark):
    df = spark.createDataFrame([crash(1, datetime(2023, 1, 1), killed=1.0, injured=2.0)], CRASH)
    row = severity.score_rows(df, "2024-01-01").first()
    assert row.age_years == pytest.approx(365 / 365.25)
    assert row.base_severity == 17.0
    assert row.weighted_score == pytest.approx(17 * exp(-0.3 * 365 / 365.25))


def test_unknown_date_counts_but_adds_nothing_and_empty_sums_are_zero(spark):
    rows = [crash(1, None, killed=None, injured=None), crash(2, None, killed=None, injured=None)]
    row = severity.summarise(severity.score_rows(spark.createDataFrame(rows, CRASH), "2024-01-01"), "NODEID").first()
    assert row.asDict() == {
        "NODEID": 1, "crash_count": 2, "total_killed": 0.0, "total_injured": 0.0, "severity_score": 0.0
    }


def test_older_crashes_weigh_less(spark):
    rows = [crash(i, datetime(2024 - i, 1, 1)) for i in range(10)]
    scored = severity.score_rows(spark.createDataFrame(rows, CRASH), "2024-06-01").orderBy("collision_id")
    values = [r.weighted_score for r in scored.collect()]
    assert values == sorted(values, reverse=True)


def test_min_max_and_single_node(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 6.0), (3, 4.0)], "n int, s double")
    scaled = severity.min_max_scale(df, "s", "t")
    assert [r.t for r in scaled.orderBy("n").collect()] == [0.0, 1.0, 0.5]
    assert severity.min_max_scale(df.where("n = 1"), "s", "t").first().t is None


def test_ranking_end_to_end(spark):
    """Scaling runs over all nodes before the cut; a crash between two nodes counts at both."""
    step = 10.0 / 111195.08
    nodes = spark.createDataFrame(
        [(1, 40.7 - step, -74.0), (2, 40.7 + step, -74.0), (3, 40.8, -74.0), (4, 40.9, -74.0)],
        "NODEID bigint, latitude double, longitude double",
    )
    edges = spark.createDataFrame(
        [(1, 2, "OAK ST"), (2, 1, "OAK ST"), (1, 3, "ELM ST"), (3, 4, "ASH ST")],
        "NodeIDFrom bigint, NodeIDTo bigint, Street string",
    )
    crashes = spark.createDataFrame(
        [crash(1), crash(2, injured=4.0), crash(3, lat=40.8, killed=1.0), crash(4, lat=40.85), crash(5, lat=40.8)],
        CRASH,
    )
    table = ranking.intersection_rankings(crashes, nodes, edges, "2024-01-01", n=2)
    rows = [r.asDict() for r in table.collect()]
    assert table.columns == ranking.RANKING_COLUMNS
    assert [(r["NODEID"], r["crash_count"], r["severity_score"]) for r in rows] == [(1, 2, 14.0), (2, 2, 14.0)]
    assert [r["severity_score_norm"] for r in rows] == [1.0, 1.0]
    assert rows[0]["intersection_name"] == "ELM ST & OAK ST" and rows[1]["intersection_name"] == "OAK ST"
    whole = ranking.rank_nodes(crashes, nodes, "2024-01-01")
    assert {r.NODEID: r.severity_score_norm for r in whole.collect()} == {1: 1.0, 2: 1.0, 3: 0.0}
    mapped = ranking.crash_to_node_map(crashes, nodes)
    assert sorted((r.collision_id, r.NODEID) for r in mapped.collect()) == [
        (1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (5, 3)
    ]


def test_node_coordinates_takes_one_pair(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 1.0), (1, 1.0, 9.0), (1, None, 0.0), (2, 5.0, 5.0)], "NODEID int, latitude double, longitude double"
    )
    assert sorted(tuple(r) for r in names.node_coordinates(df).collect()) == [(1, 1.0, 9.0), (2, 5.0, 5.0)]


def test_flags_of_unknown_values_are_zero(spark):
    rows = [crash(1, datetime(2024, 1, 6), "23:15", injured=2.0), crash(2, None, "25:99", injured=None, ped=None),
            crash(3, datetime(2024, 1, 8), "7:30", ped=1.0), crash(4, time=None, killed=1.0)]
    made = {r.collision_id: r for r in features.row_features(spark.createDataFrame(rows, CRASH)).collect()}
    assert (made[1].hour, made[1].dayofweek, made[1].is_night, made[1].is_weekend, made[1].is_severe) == (23, 5, 1, 1, 1)
    assert made[2].hour is None
    assert (made[2].is_night, made[2].is_rush_hour, made[2].is_weekend, made[2].is_severe) == (0, 0, 0, 0)
    assert (made[3].is_rush_hour, made[3].is_pedestrian_injury, made[3].dayofweek) == (1, 1, 0)
    assert (made[4].is_fatal, made[4].is_severe, made[4].is_bike_death) == (1, 1, 0)


def test_top_causes_are_counted_before_useless_ones_go(spark):
    counts = {"Following Too Closely": 9, "Other Vehicular": 8, "A": 7, "B": 6, "C": 5, "D": 4, "Unspecified": 20, None: 3}
    rows = [crash(i, cause=c) for i, c in enumerate(c for c, n in counts.items() for _ in range(n))]
    df = features.with_clean_cause(spark.createDataFrame(rows, CRASH), "contributing_factor_vehicle_1")
    labelled = features.label_causes(df, "contributing_factor_vehicle_1")
    got = {(r[0], r[1]) for r in labelled.select("contributing_factor_vehicle_1", "cause_label").collect()}
    assert got == {("A", "A"), ("B", "B"), ("C", "C"), ("D", "Other")}


def test_mode_takes_the_smallest_on_a_tie(spark):
    rows = [(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, "z"), (3, None)]
    df = spark.createDataFrame(rows, "k int, c string")
    assert {r.k: r.primary_cause for r in features.primary_label(df, "k", "c").collect()} == {1: "a", 2: "z", 3: "Other"}


def test_node_features_do_not_depend_on_how_they_were_summed(spark):
    rows = [crash(i, time=f"{i % 24}:00", injured=float(i % 3), ped=float(i % 2), node=i % 4,
                  cause="AB"[i % 2]) for i in range(60)] + [crash(99, injured=None, node=9)]
    made = features.row_features(spark.createDataFrame(rows, CRASH))
    direct = features.node_features(features.node_sums(made, "NODEID"), "NODEID")
    finer = features.node_sums(made, "NODEID", "contributing_factor_vehicle_1")
    merged = features.node_features(features.merge_node_sums(finer, "NODEID"), "NODEID")
    assert sorted(direct.collect()) == sorted(merged.collect())
    last = direct.where("NODEID = 9").first()
    assert last.avg_injured is None and last.total_injured == 0.0 and last.ped_proportion == 0.0
    assert direct.columns == ["NODEID", *features.FEATURES] and len(features.FEATURES) == 22


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "c string")
    weights = {r.c: r.weight for r in evaluation.class_weights(df, "c").collect()}
    assert weights == {"a": pytest.approx(sqrt(8 / 12)), "b": pytest.approx(sqrt(8 / 4))}
    assert evaluation.with_class_weight(df, "c").count() == 8


def test_confusion_f1_and_mae(spark):
    pairs = [(0, 0)] * 3 + [(0, 2)] + [(1, 0)] * 2 + [(2, 2)] * 4
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, p double")
    matrix = evaluation.confusion_matrix(df, "a", "p", [0.0, 1.0, 2.0])
    assert [tuple(r)[1:] for r in matrix.collect()] == [(3, 0, 1), (2, 0, 0), (0, 0, 4)]
    row = evaluation.weighted_f1_and_mae(df, "a", "p").first()
    assert row.mae == pytest.approx(4 / 10)
    assert row.weighted_f1 == pytest.approx((4 * 6 / 9 + 0 + 4 * 8 / 9) / 10)


def test_precision_at_k(spark):
    ranked = spark.createDataFrame(
        [("c", "Good ", 1), ("c", "Bad", 2), ("c", "Fine", 3), ("d", "Good", 1), ("d", "Bad", 2), ("e", "Good", 1)],
        "cause string, title string, rank int",
    )
    truth = spark.createDataFrame([("c", "Good"), ("c", " Fine"), ("d", "Other one"), ("z", "Good")], "cause string, title string")
    made = evaluation.precision_at_k(evaluation.mark_hits(ranked, truth, "cause", "title"), "cause", ks=(1, 3))
    assert {r[0]: tuple(r)[1:] for r in made.collect()} == {
        "c": (1.0, pytest.approx(2 / 3)), "d": (0.0, 0.0), "Macro-Average": (0.5, pytest.approx(1 / 3))
    }


@pytest.mark.parametrize("leaf_rows", [1, 50, 10_000])
def test_quantiles_equal_numpy(spark, leaf_rows):
    import numpy as np

    rng = np.random.default_rng(0)
    values = np.concatenate([rng.exponential(1e6, 400), np.full(300, 7.0), -rng.uniform(0, 1, 300)])
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "x double")
    probs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = summary.exact_quantiles(df, "x", probs, accuracy=20, leaf_rows=leaf_rows)
    assert got == pytest.approx(list(np.quantile(values, probs)))


@pytest.mark.parametrize("leaf_rows", [1, 10_000])
def test_quantiles_of_extreme_values_end(spark, leaf_rows):
    import numpy as np

    values = [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, *[1.0] * 40, *[2.0] * 40, *(10.0**k for k in range(-300, 300, 10))]
    rows = [*values, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(x,) for x in rows], "x double")
    probs = [0.0, 0.3, 0.5, 0.77, 0.999, 1.0]
    got = summary.exact_quantiles(df, "x", probs, accuracy=10, leaf_rows=leaf_rows)
    ordered = sorted(values)
    for g, p in zip(got, probs):
        at = (len(values) - 1) * p
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        assert min(low, high) <= g <= max(low, high)
    assert summary.describe(df, "x").first().n == len(values)


def test_quantiles_take_three_scans(spark, monkeypatch):
    rows = spark.range(200_000).selectExpr("exp(id / 9000.0) AS x")
    calls = []
    monkeypatch.setattr(summary, "_histogram", lambda *a, f=summary._histogram: calls.append(1) or f(*a))
    got = summary.exact_quantiles(rows, "x", [0.5, 0.99])
    assert len(calls) == 1
    assert got == pytest.approx([float(__import__("numpy").exp(199_999 * p / 9000.0)) for p in (0.5, 0.99)], rel=1e-4)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert summary.exact_quantiles(df, "x", [0.5]) == [None]
    assert summary.describe(df, "x").first().n == 0
