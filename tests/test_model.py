"""Cause model: labels, weights, training, prediction and the registered queries."""

from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from snapgrid.operators import boosting
from snapgrid.operators.evaluation import with_class_weight
from snapgrid.operators.features import FEATURES
from snapgrid.operators.model import TreeSettings, fit_cause_model, index_labels, load_cause_model, split, standardise
from snapgrid.plans import causes
from tests.test_scores_and_features import CRASH, crash


def table(spark, n=240):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        kind = i % 3
        values = rng.normal(size=len(FEATURES)) * 0.3
        values[kind] += 2.0
        rows.append((i, *map(float, values), "Backing,Other,Turning".split(",")[kind]))
    fields = ", ".join(f"{c} double" for c in FEATURES)
    return spark.createDataFrame(rows, f"NODEID bigint, {fields}, primary_cause string")


def test_labels_are_alphabetical(spark):
    labelled, labels = index_labels(table(spark, 9))
    assert labels == ["Backing", "Other", "Turning"]
    assert {(r.primary_cause, r.label) for r in labelled.collect()} == {("Backing", 0.0), ("Other", 1.0), ("Turning", 2.0)}


def test_standardise_uses_population_deviation(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0)], "k int, a double, b double")
    rows = standardise(df, ["a", "b"]).orderBy("k").collect()
    a = np.array([1.0, 3.0, 0.0])
    assert [r.a for r in rows] == pytest.approx(list((a - a.mean()) / a.std()))
    assert [r.b for r in rows] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("kind,trees", [("forest", 20), ("boosted", 2)])
def test_model_learns_and_repeats(spark, kind, trees):
    settings = TreeSettings(trees=trees, depth=3, kind=kind)
    runs = [causes.run_model(table(spark), settings) for _ in range(2)]
    first, second = (sorted((r.NODEID, r.predicted_cause) for r in run.predictions.collect()) for run in runs)
    assert first == second and len(first) == 240
    quality = runs[0].quality().first()
    assert quality.weighted_f1 > 0.8 and quality.mae < 0.5
    assert runs[0].confusion().columns == ["actual", "predicted_Backing", "predicted_Other", "predicted_Turning"]


@pytest.mark.parametrize("kind,trees", [("forest", 10), ("boosted", 2)])
def test_a_stored_model_predicts_the_same(spark, tmp_path, kind, trees):
    run = causes.run_model(table(spark), TreeSettings(trees=trees, depth=3, kind=kind))
    run.model.save(str(tmp_path / "m"))
    run.model.save(str(tmp_path / "m"))
    loaded = load_cause_model(spark, str(tmp_path / "m"))
    assert loaded.labels == run.labels and loaded.stats == run.model.stats
    again = causes.score_table(loaded, table(spark))
    assert sorted(again.predictions.collect()) == sorted(run.predictions.collect())
    # Causes that the model does not know are predicted and left out of the quality.
    odd = table(spark).withColumn("primary_cause", F.when(F.col("NODEID") < 30, "New").otherwise(F.col("primary_cause")))
    scored = causes.score_table(loaded, odd)
    assert scored.predictions.count() == 240 and scored.predictions.where("label IS NULL").count() == 30
    assert scored.quality().first().weighted_f1 > 0.7
    assert causes.score_table(loaded, table(spark).limit(0)).predictions.count() == 0


def test_a_level_of_all_causes_is_one_job(spark):
    """Trees of all causes grow together: a job for each level of a round, whatever the number of causes."""
    labelled, labels = index_labels(table(spark))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    jobs = []
    for trees in (2, 6):
        context.setJobGroup(f"fit-{trees}", "")
        model = fit_cause_model(labelled, labels, TreeSettings(trees=trees, depth=3))
        jobs.append(len(tracker.getJobIdsForGroup(f"fit-{trees}")))
        assert model.model.feature.shape == (trees, 3, 15)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 4 * 3


def test_boosted_trees_by_brute_force():
    """The splits of a level are those of least weighted variance over all cells; equal sums in any order of blocks."""
    rng = np.random.default_rng(3)
    cells, marks = rng.integers(0, 5, (3, 400)).astype(np.uint8), rng.integers(0, 3, 400).astype(np.uint8)
    weights, margins = np.array([1.0, 0.5, 2.0]), rng.normal(size=(3, 400)).astype(np.float32)
    settings = TreeSettings(row_share=1.0, column_share=1.0, min_rows=3, features=("a", "b", "c"))
    feature, cell = np.full((3, 7), -1, np.int16), np.zeros((3, 7), np.int16)
    feature[:, 0], cell[:, 0] = 1, 2
    level = boosting._Level(settings, 1, 1, feature, cell, weights)
    keys = np.arange(400, dtype=np.uint64)
    whole = dict(level.sums(iter([(keys, cells, marks, margins)])))
    parts = [(keys[a:b], cells[:, a:b], marks[a:b], margins[:, a:b]) for a, b in [(300, 400), (0, 130), (130, 300)]]
    assert all(np.array_equal(found, whole[k]) for k, found in level.sums(iter(parts)))
    for k in range(3):
        side = np.where(marks == k, 1.0, -1.0)
        rest, w = 4 * side / (1 + np.exp(2 * side * margins[k])), weights[marks]
        for node, f, b, left, right, mean in level.splits((k, whole[k]))[1]:
            here = (cells[1] > 2) == (node == 2)
            cost = {}
            for f2 in range(3):
                for b2 in range(4):
                    sides = [here & (cells[f2] <= b2), here & (cells[f2] > b2)]
                    if min(x.sum() for x in sides) >= 3:
                        cost[f2, b2] = sum((w[x] * (rest[x] - np.average(rest[x], weights=w[x])) ** 2).sum() for x in sides)
            assert cost[f, b] == pytest.approx(min(cost.values()), rel=1e-4)
            goes = here & (cells[f] <= b), here & (cells[f] > b), here
            assert [left, right, mean] == pytest.approx([np.average(rest[x], weights=w[x]) for x in goes], abs=1e-4)


def test_margins_written_and_blocks_decide_nothing(spark, monkeypatch):
    labelled, labels = index_labels(table(spark))
    settings = TreeSettings(trees=5, depth=3)
    whole = fit_cause_model(labelled, labels, settings).model
    monkeypatch.setattr(boosting, "CUT_EVERY", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 70)
    cut = fit_cause_model(labelled.repartition(3), labels, settings).model
    assert whole.cuts == cut.cuts and np.array_equal(whole.feature, cut.feature) and np.array_equal(whole.cell, cut.cell)
    assert np.allclose(whole.value, cut.value, atol=1e-6) and (whole.feature >= 0).any(axis=2).all()


def test_cuts_share_the_rows_of_a_common_value_out():
    assert boosting.choose_cuts([0.0] * 7 + [1.0, 2.0]) == (0.0, 1.0, 2.0)
    cuts = boosting.choose_cuts([0.0] * 900 + list(range(1, 101)))
    assert len(cuts) == boosting.BINS - 1 and cuts[0] == 0.0 and max(np.diff(cuts)) <= 5


def test_hold_out_is_exact_for_each_label(spark):
    rows = spark.range(5000).selectExpr("id AS NODEID", "CASE WHEN id < 3 THEN 'rare' WHEN id % 3 > 0 THEN 'common' WHEN id % 2 > 0 THEN 'other' END AS label")
    sides = [split(rows.repartition(n), "NODEID", "label") for n in (1, 7)]
    (rest, held), (_, again) = ([side.collect() for side in both] for both in sides)
    assert sorted(r.NODEID for r in held) == sorted(r.NODEID for r in again)
    assert {r.NODEID for r in rest} | {r.NODEID for r in held} == set(range(5000)) and len(rest) + len(held) == 5000
    total, out = Counter(r.label for r in rest + held), Counter(r.label for r in held)
    assert out == {label: int(0.2 * n + 0.5) for label, n in total.items()}
    assert split(rows.where("false"), "NODEID", "label")[1].count() == 0


def test_rows_have_the_weight_of_their_class(spark):
    rows = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2 + [(None,)], "label string")
    got = {r.label: r.weight for r in with_class_weight(rows, "label").collect()}
    assert got["a"] == pytest.approx((11 / (3 * 8)) ** 0.5) and got["b"] == pytest.approx((11 / (3 * 2)) ** 0.5)


def test_training_table_and_ranked_predictions(spark):
    rows = [crash(i, datetime(2024, 1, 1 + i % 7), f"{i % 24}:10", injured=float(i % 3), node=None,
                  cause=["Backing Unsafely", "Unsafe Speed", "Unspecified", " Following Too Closely"][i % 4])
            for i in range(80)]
    crashes = spark.createDataFrame(rows, CRASH).drop("NODEID")
    node_map = spark.createDataFrame([(str(i), i % 5) for i in range(80)] + [("x", 1)], "collision_id string, NODEID bigint")
    made = causes.training_table(causes.crashes_at_nodes(crashes, node_map))
    assert made.columns == ["NODEID", *FEATURES, "primary_cause"]
    got = {r.NODEID: (r.total_crashes, r.primary_cause) for r in made.collect()}
    assert got == {n: (8, "Backing Unsafely") for n in range(5)}
    predicted = made.selectExpr("NODEID", "primary_cause", "primary_cause AS predicted_cause")
    ranks = spark.createDataFrame([(3, "A & B"), (8, "C")], "NODEID bigint, intersection_name string")
    rows = causes.ranked_predictions(predicted, ranks).collect()
    assert [r.asDict() for r in rows] == [
        {"NODEID": 3, "predicted_cause": "Backing Unsafely", "actual_cause": "Backing Unsafely",
         "ranked_node": 3, "intersection_name": "A & B"}
    ]


def test_registry_is_consistent():
    assert set(oracle_sql()) <= set(queries())
    # What is trained, sketched or tokenized, in operators that may be absent, has no SQL.
    assert not [q for q in set(queries()) - set(oracle_sql()) if q.startswith("q_")]
