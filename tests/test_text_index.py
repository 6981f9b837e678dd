"""The stored index gives the rows of the full ranking and reads part of its blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapgrid.operators import text_index, vectors
from snapgrid.plans import recommend

COMMON = [f"c{k}" for k in range(12)]
RARE = [f"r{k}" for k in range(400)]


def texts(seed, n, long=14):
    rng = np.random.default_rng(seed)
    return [" ".join([*rng.choice(COMMON, int(rng.integers(1, long))), *rng.choice(RARE, int(rng.integers(0, 6)))]) for _ in range(n)]


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, text string")


def ranked(df):
    return sorted((r.query_id, r.doc_id, r.sim, r["rank"]) for r in df.collect())


DOCS = [(10 * k + 5, t) for k, t in enumerate(texts(1, 500))] + [(1, None), (2, ""), (3, "unheard"), (4, "c1 c1"), (6, "c1"), (7, "c1"), (8, "C1!")]
ASKED = [(k, t) for k, t in enumerate(texts(2, 25))] + [(100, None), (101, ""), (102, "nothing known"), (103, "c1"), (104, "unheard c3"), (105, "r7 r7 r8")]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    text_index.build_index(corpus(spark, DOCS), path, block=8)
    return path


@pytest.mark.parametrize("k", [1, 3, 40])
def test_equals_the_full_ranking(spark, built, k):
    index = text_index.open_index(spark, built)
    want = recommend.rank_documents(queries(spark, ASKED), corpus(spark, DOCS), k)
    assert ranked(text_index.search(index, queries(spark, ASKED), k)) == ranked(want)


def test_blocks_are_skipped_and_cover_all_postings(spark, built):
    index = text_index.open_index(spark, built)
    assert index.size == len(DOCS)
    effort = text_index.effort(index, queries(spark, ASKED[:25]), 1).agg(F.sum("read"), F.sum("blocks")).first()
    assert 0 < effort[0] < 0.5 * effort[1]
    held = index.postings.select(F.size("ids").alias("n"), "top", F.array_max("impacts").alias("m"), F.array_min("impacts").alias("low"))
    assert held.where("n > 8 OR top <> m").count() == 0
    assert held.agg(F.sum("n")).first()[0] == index.vectors.agg(F.sum(F.size("terms"))).first()[0]
    # Blocks of a word follow one another by impact.
    rows = index.postings.orderBy("term_id", "place").collect()
    assert all(a.impacts[-1] >= b.top for a, b in zip(rows, rows[1:]) if a.term_id == b.term_id)


def test_recommendations_come_from_the_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Humps", "humps speed calming"), (2, "Lights", "signal lights")], "doc_id long, title string, text string")
    index = text_index.build_index(docs, str(tmp_path / "index"))
    rows = spark.createDataFrame([(1, "speed"), (2, "lights out"), (3, None)], "n long, cause string")
    with_index = recommend.best_documents(rows, "cause", docs, index=index)
    assert sorted(with_index.collect(), key=str) == sorted(recommend.best_documents(rows, "cause", docs).collect(), key=str)


def test_empty_corpus_and_queries(spark, built, tmp_path):
    index = text_index.build_index(corpus(spark, DOCS).limit(0), str(tmp_path / "none"))
    assert text_index.search(index, queries(spark, ASKED), 3).count() == 0
    assert text_index.search(text_index.open_index(spark, built), queries(spark, ASKED).limit(0), 3).count() == 0


def test_texts_in_few_tasks_are_dealt_anew(spark):
    slots = 2 * spark.sparkContext.defaultParallelism
    lumped = spark.createDataFrame([(k, "a b") for k in range(100)], "k long, t string").coalesce(1)
    assert vectors.evenly(lumped, "k").rdd.getNumPartitions() == slots
    spread = spark.range(1_000).repartition(8)
    assert vectors.evenly(spread, "id") is spread
