"""Cells and shells give the rows of the full ranking and meet part of the pairs where vectors cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapgrid.operators import cells, similarity


def frame(spark, rows, name, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} bigint, vector array<float>").repartition(3)


def clustered(rng, n, dim=12, groups=15):
    middles = rng.normal(size=(groups, dim))
    return middles[rng.integers(groups, size=n)] + 0.08 * rng.normal(size=(n, dim))


def ranked(df):
    return sorted((r.q, r.d, r.sim, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k, shell_rows, query_rows", [(1, 4_096, 8_192), (5, 20, 8_192), (5, 40, 7)])
def test_equals_the_full_ranking_and_skips(spark, monkeypatch, k, shell_rows, query_rows):
    monkeypatch.setattr(cells, "QUERY_ROWS", query_rows)
    rng = np.random.default_rng(4)
    d, q = clustered(rng, 900), clustered(np.random.default_rng(4), 60)
    d[10:60], d[70], d[80], q[3], q[4] = d[3], 0.0, 0.0, 0.0, d[10]
    docs, queries = frame(spark, d, "d", 100), frame(spark, q, "q")
    built = cells.build_cells(docs, "d", "vector", k, shell_rows)
    assert built.docs.count() == 900 - (1 if k == 1 else 0) and built.shells["n"].sum() == built.docs.count()
    got, report = cells.top_k_pruned(built, queries, "q", "vector", k)
    assert ranked(got) == ranked(similarity.top_k_dense(queries, docs, "q", "d", "vector", "vector", k))
    met, pairs = report.first()
    assert pairs == 60 * built.docs.count() and 0 < met < 0.4 * pairs


def test_vectors_without_structure_are_ranked_all_the_same(spark):
    rng = np.random.default_rng(7)
    docs, queries = frame(spark, rng.normal(size=(150, 20)), "d"), frame(spark, rng.normal(size=(20, 20)), "q")
    got, report = cells.top_k_pruned(cells.build_cells(docs, "d", "vector", 3, 30), queries, "q", "vector", 3)
    assert ranked(got) == ranked(similarity.top_k_dense(queries, docs, "q", "d", "vector", "vector", 3))
    assert report.first().met <= report.first().pairs


@pytest.mark.parametrize("at_once", [0.0, 2.0])
def test_a_query_is_one_row_for_each_group_of_shells(spark, monkeypatch, at_once):
    monkeypatch.setattr(cells, "GROUP_ROWS", 60)
    monkeypatch.setattr(cells, "AT_ONCE", at_once)
    rng = np.random.default_rng(7)
    docs, queries = frame(spark, rng.normal(size=(150, 20)), "d"), frame(spark, rng.normal(size=(20, 20)), "q")
    built = cells.build_cells(docs, "d", "vector", 3, 10)
    groups = built.shells["grouped"].nunique()
    assert groups <= 3 < len(built.shells)
    got, _ = cells.top_k_pruned(built, queries, "q", "vector", 3)
    assert ranked(got) == ranked(similarity.top_k_dense(queries, docs, "q", "d", "vector", "vector", 3))
    everywhere = cells._routed(built, queries.select("q", "vector", F.lit(-1.0).alias("beat")), "q", 3, False)
    for row in everywhere.collect():
        assert len(row.parts) <= groups
        assert sorted(x for part in row.parts for x in part[1:]) == sorted(row.shells)


def test_few_zero_and_no_documents(spark):
    queries = frame(spark, [[1.0, 0.0], [0.0, 0.0]], "q")
    for rows in ([[1.0, 1.0], [0.0, 0.0]], [[0.0, 0.0]] * 4, [[-1.0, 0.0]]):
        docs = frame(spark, rows, "d")
        got, _ = cells.top_k_pruned(cells.build_cells(docs, "d", "vector", 3), queries, "q", "vector", 3)
        assert ranked(got) == ranked(similarity.top_k_dense(queries, docs, "q", "d", "vector", "vector", 3))
    empty = cells.build_cells(docs.limit(0), "d", "vector", 3)
    assert cells.top_k_pruned(empty, queries, "q", "vector", 3)[0].count() == 0
    assert cells.top_k_pruned(cells.build_cells(docs, "d", "vector", 3), queries.limit(0), "q", "vector", 3)[0].count() == 0
