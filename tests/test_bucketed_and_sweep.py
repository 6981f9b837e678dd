"""Bucketed tables join without a shuffle; settings are compared on the same folds."""

import pytest
from pyspark.sql import functions as F

from snapgrid.operators.model import TreeSettings
from snapgrid.plans import recommend, sweep
from snapgrid.sources import bucketed, schemas
from tests.conftest import plan_of
from tests.test_model import table


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_and_sums_on_the_key_move_nothing(spark, tmp_path, no_broadcast):
    ranked = spark.createDataFrame([(k, k, 0.0, 1.0, 2.0, 0.5, f"A {k}", 40.7, -74.0) for k in range(50)], schemas.RANKINGS)
    chosen = spark.createDataFrame([(k, f"cause {k % 3}", f"fix {k % 3}") for k in range(0, 50, 2)], "NODEID long, predicted_cause string, Top_Intervention string")
    a = bucketed.write_bucketed(ranked, str(tmp_path / "a"), "NODEID", 4)
    b = bucketed.write_bucketed(chosen, str(tmp_path / "b"), "NODEID", 4)
    joined = recommend.master_table(a, b)
    joined.collect()
    assert "SortMergeJoin" in plan_of(joined) and "Exchange" not in plan_of(joined)
    assert sorted(joined.collect(), key=str) == sorted(recommend.master_table(ranked, chosen).collect(), key=str)
    sums = a.groupBy("NODEID").agg(F.sum("crash_count"))
    sums.collect()
    assert "Exchange" not in plan_of(sums)
    # Another session would open them like this; numbers of buckets that divide each other still fit.
    again, other = bucketed.open_bucketed(spark, str(tmp_path / "a")), bucketed.write_bucketed(chosen, str(tmp_path / "c"), "NODEID", 8)
    spark.conf.set("spark.sql.bucketing.coalesceBucketsInJoin.enabled", True)
    mixed = recommend.master_table(again, other)
    assert again.schema == ranked.schema and mixed.count() == 50
    spark.conf.unset("spark.sql.bucketing.coalesceBucketsInJoin.enabled")


def test_what_stood_there_goes(spark, tmp_path):
    path = str(tmp_path / "t")
    bucketed.write_bucketed(spark.range(100).withColumnRenamed("id", "k"), path, "k", 4)
    again = bucketed.write_bucketed(spark.createDataFrame([(1, "x"), (None, "y")], "k long, `odd name` string"), path, "k", 2)
    assert sorted(again.collect(), key=str) == sorted([(1, "x"), (None, "y")], key=str)
    assert [bucketed.buckets_for(n) for n in (0, 1, 1_000_001, 9_000_000)] == [1, 1, 2, 16]
    assert bucketed.write_bucketed(again.limit(0), path, "k").count() == 0


def test_settings_are_scored_on_the_same_folds(spark):
    nodes = table(spark)
    settings = [TreeSettings(trees=1, depth=1, kind="forest"), TreeSettings(trees=10, depth=4, kind="forest")]
    scores = sweep.score_settings(nodes, settings, folds=3)
    rows = scores.collect()
    assert len(rows) == 6 and all(r.n_fitted + r.n_scored == 240 for r in rows)
    assert {(r.fold, r.n_scored) for r in rows if r.setting == 0} == {(r.fold, r.n_scored) for r in rows if r.setting == 1}
    folds = {r.f: r["count"] for r in nodes.groupBy(sweep.fold_of("NODEID", 3).alias("f")).count().collect()}
    assert {r.fold: r.n_scored for r in rows} == folds
    best = sweep.best_first(scores).collect()
    assert [r.trees for r in best] == [10, 1] and best[0].weighted_f1 > 0.8 > best[0].commonest_f1 and best[0].n_scored == 240
    assert sweep.score_settings(nodes.where("NODEID < 3").limit(1), settings, folds=3).count() == 0
