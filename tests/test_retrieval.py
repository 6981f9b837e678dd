"""Cosine ranking, word vectors, recommendations and result views."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapgrid.functions.text import FLAG_PHRASES, flag_text, words
from snapgrid.operators import blocks, similarity, vectors
from snapgrid.plans import recommend, views
from snapgrid.sources import schemas
from tests.conftest import plan_of

CORPUS = [
    (1, "Marked Crosswalks", "pedestrian crossing"),
    (2, "Signal Timing", "signal braking rear end"),
    (3, "Raised Crosswalk ", "pedestrian crossing crosswalk raised"),
    (4, "Turn Calming", "turn slow vehicle turning"),
]


def corpus(spark):
    return recommend.corpus_texts(spark.createDataFrame(CORPUS, schemas.CORPUS))


def dense(spark, rows, name):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} bigint, vector array<double>"
    )


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_dense_ranking_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(0)
    q, d = rng.normal(size=(30, 8)), rng.normal(size=(50, 8))
    d[10], d[20], d[30] = d[3], d[3], 0.0
    ours = similarity.top_k_dense(
        dense(spark, q, "q"), dense(spark, d, "d"), "q", "d", "vector", "vector", 5, block_rows
    )
    norm = np.linalg.norm(d, axis=1)
    sims = np.round(q @ d.T / np.linalg.norm(q, axis=1)[:, None] / np.where(norm > 0, norm, 1), 9)
    expected = {
        (i, int(j), rank + 1)
        for i in range(30) for rank, j in enumerate(np.argsort(-sims[i], kind="stable")[:5])
    }
    assert {(r.q, r.d, r["rank"]) for r in ours.collect()} == expected


def test_zero_vectors_score_zero_and_the_smallest_id_wins(spark):
    ours = similarity.top_k_dense(
        dense(spark, [[0.0, 0.0]], "q"), dense(spark, [[1.0, 0.0], [0.0, 1.0]], "d"), "q", "d", "vector", "vector", 1
    )
    assert [(r.d, r.sim) for r in ours.collect()] == [(0, 0.0)]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_best_columns_are_picked_without_sorting_whole_rows(monkeypatch, k):
    rng = np.random.default_rng(1)
    plain = rng.normal(size=(20, 400))
    odd = [np.round(plain, 1), np.round(plain, 2) + rng.normal(size=plain.shape) * 1e-10, np.zeros((20, 400)), np.full((20, 400), np.nan)]
    odd += [np.where(np.arange(400) < 2, plain, np.nan), np.where(np.arange(400) < 7, plain, -np.inf), plain[:, :8]]
    for sims in odd:
        rounded = np.round(sims, 9) + 0.0
        order = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
        columns, scores = similarity.largest(sims, k)
        assert np.array_equal(columns, order)
        assert np.array_equal(scores, np.take_along_axis(rounded, order, axis=1), equal_nan=True)
    monkeypatch.setattr(similarity, "_rounded_best", lambda *_: pytest.fail("sorted whole"))
    columns, _ = similarity.largest(plain, k)
    assert np.array_equal(columns, np.argsort(-plain, axis=1)[:, :k])


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(similarity.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.8), 0.0]


def tokens(text):
    return [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split(" ") if w]


def brute_tf_idf(queries, docs):
    counts = [Counter(tokens(t)) for t in docs]
    in_docs = Counter(w for c in counts for w in c)

    def vector(c):
        return {w: n * math.log((len(docs) + 1) / (in_docs[w] + 1)) for w, n in c.items()}

    def norm(v):
        return math.sqrt(sum(x * x for x in v.values()))

    d = [vector(c) for c in counts]
    table = []
    for text in queries:
        q = vector(Counter(tokens(text)))
        scale = [norm(q) * norm(v) for v in d]
        table.append([
            round(sum(x * v.get(w, 0) for w, x in q.items()) / s, 9) if s else 0.0 for v, s in zip(d, scale)
        ])
    return table


@pytest.mark.parametrize("block_rows, table_bytes", [(3, 32 << 20), (4096, 0), (4096, 32 << 20)])
def test_word_vectors_equal_brute_force(spark, monkeypatch, block_rows, table_bytes):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", table_bytes)
    rng = np.random.default_rng(1)
    lexicon = ["signal", "Turn", "ÉCOLE", "straße", "x1", "lane", "the", "zebra", "red", "stop"]
    docs = [" ".join(rng.choice(lexicon[:8], rng.integers(0, 9))) for _ in range(20)]
    queries = [", ".join(rng.choice(lexicon, rng.integers(0, 6))) for _ in range(9)]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    monkeypatch.setattr(recommend, "top_k_sparse", lambda *a: similarity.top_k_sparse(*a, block_rows))
    ours = {(r.query_id, r["rank"]): (r.doc_id, r.sim) for r in recommend.rank_documents(q, d, 4).collect()}
    for i, sims in enumerate(brute_tf_idf(queries, docs)):
        for rank, j in enumerate(np.argsort(-np.array(sims), kind="stable")[:4]):
            doc, sim = ours[i, rank + 1]
            assert (doc, sim) == (j, pytest.approx(sims[j], abs=1e-8))
    assert len(ours) == 9 * 4


def test_whole_text_is_used(spark):
    text = "a " * 50_000 + "last"
    df = spark.createDataFrame([(text,)], "t string").select(words(F.col("t")).alias("w"))
    assert df.select(F.size("w"), F.element_at("w", -1)).first()[:] == (50_001, "last")
    both = spark.createDataFrame([(1, f" {text}!"), (2, "--"), (3, None)], "id bigint, t string")
    counts = {(r.id, t): n for r in vectors.term_counts(both, "id", "t").collect() for t, n in zip(r.terms, r.tf)}
    assert counts == {(1, "a"): 50_000, (1, "last"): 1}
    assert {r.id for r in vectors.term_counts(both, "id", "t").collect()} == {1, 2, 3}


def test_words_are_counted_a_bounded_number_at_a_time(spark, monkeypatch):
    lists = pa.array([["a"] * n for n in (3, 0, 9, 2, 2, 0)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), lists], ["k", "words"])
    monkeypatch.setattr(vectors, "WORDS_AT_ONCE", 5)
    pieces = list(vectors._pieces(iter([batch, batch.slice(0, 0)])))
    assert [x for p in pieces for x in p.column(0).to_pylist()] == list(range(6))
    # The first row of a piece may be long; the others add less than the bound.
    assert max(sum(map(len, p.column(1).to_pylist()[1:])) for p in pieces if p.num_rows) < 5
    texts = spark.createDataFrame([(k, "b a " * k) for k in range(5)], "k bigint, text string")
    found = {r.k: dict(zip(r.terms, r.tf)) for r in vectors.term_counts(texts, "k", "text").collect()}
    assert found == {k: ({"a": k, "b": k} if k else {}) for k in range(5)}


def test_long_texts_on_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30_000, 20_000)) for _ in range(12)]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")
    d = spark.createDataFrame(list(enumerate(texts[::-1])), "doc_id bigint, text string")
    for held in (2_000_000, 0):
        monkeypatch.setattr(blocks, "BROADCAST_VALUES", held)
        monkeypatch.setattr(blocks, "BLOCK_VALUES", 50_000)
        best = {r.query_id: r.doc_id for r in recommend.rank_documents(q, d, 1).collect()}
        assert best == {k: 11 - k for k in range(12)}


def test_pair_of_blocks_has_a_task_to_itself(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BROADCAST_VALUES", 0)
    rng = np.random.default_rng(0)
    q, d = (dense(spark, rng.normal(size=(n, 4)), c) for n, c in ((40, "q"), (60, "d")))
    ranked = similarity.top_k_dense(q, d, "q", "d", "vector", "vector", 3, 16)
    plan = plan_of(ranked)
    assert plan.count("REPARTITION_BY_NUM") <= 2 and ranked.count() == 120


def test_encoder_runs_in_batches(spark):
    def load():
        def to_vectors(texts):
            return [[float(len(t)), 1.0] for t in texts]

        return to_vectors

    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "id bigint, text string")
    made = {r.id: r.vector for r in vectors.encode(df, "id", "text", load).collect()}
    assert made == {1: [2.0, 1.0], 2: [3.0, 1.0]}
    ranked = recommend.rank_documents(df.withColumnRenamed("id", "query_id"), corpus(spark), 1, encoder=load)
    assert ranked.count() == 2


def test_flag_text(spark):
    flags = {flag: int(i in (0, 11)) for i, flag in enumerate(FLAG_PHRASES)}
    df = spark.createDataFrame(pd.DataFrame([{**flags, "cause": "Backing Unsafely"}, {**flags, "cause": None}]))
    assert [r[0] for r in df.select(flag_text(F.col("cause"))).collect()] == [
        "Has enhanced crossing, is bike route, Predicted cause is Backing Unsafely",
        "Has enhanced crossing, is bike route",
    ]
    assert len(FLAG_PHRASES) == 13


def predictions(spark):
    return spark.createDataFrame(
        [(1, "Signal braking"), (2, "Turning vehicle"), (3, "Signal braking"), (4, None), (5, "pedestrian")],
        "NODEID bigint, predicted_cause string",
    )


def test_best_intervention_comes_back_to_every_row(spark):
    made = recommend.recommend_for_causes(predictions(spark), corpus(spark))
    assert {r.NODEID: r.Top_Intervention for r in made.collect()} == {
        1: "Signal Timing", 2: "Turn Calming", 3: "Signal Timing", 4: None, 5: "Marked Crosswalks"
    }


def test_evaluation_of_causes(spark):
    truth = spark.createDataFrame(
        [("pedestrian", "Raised Crosswalk"), ("pedestrian", "Marked Crosswalks"), ("Signal braking", "Turn Calming")],
        schemas.TRUTH,
    )
    made = recommend.evaluate_causes(predictions(spark), corpus(spark), truth, ks=(1, 3))
    assert {r[0]: tuple(r)[1:] for r in made.collect()} == {
        "pedestrian": (1.0, pytest.approx(2 / 3)),
        # Only its own document shares a word; the rest tie at 0, smallest id first.
        "Signal braking": (0.0, 0.0),
        "Macro-Average": (0.5, pytest.approx(1 / 3)),
    }


def test_flag_fixes_and_views(spark):
    ranks = spark.createDataFrame(
        [(1, 5, 0.0, 1.0, 9.0, 1.0, "A & B", 40.7, -74.0), (2, 4, 0.0, 0.0, 9.5, 0.0, "C", 40.8, -74.0)], schemas.RANKINGS
    )
    flagged = ranks
    for flag in FLAG_PHRASES:
        flagged = flagged.withColumn(flag, F.lit(0))
    fixed = recommend.flag_fixes(flagged, predictions(spark), corpus(spark))
    assert fixed.columns == [*ranks.columns, *FLAG_PHRASES, "Predicted_Fix"]
    assert {r.NODEID: r.Predicted_Fix for r in fixed.collect()} == {1: "Signal Timing", 2: "Turn Calming"}
    master = recommend.master_table(ranks, recommend.recommend_for_causes(predictions(spark), corpus(spark)))
    assert [r.intersection_name for r in views.leaderboard(master).collect()] == ["C", "A & B"]
    assert views.leaderboard(master, "Signal braking").columns == views.LEADERBOARD_COLUMNS
    assert views.leaderboard(master, "Signal braking").count() == 1
    assert views.map_feed(master, "All").columns == views.MAP_COLUMNS
    assert {r[0] for r in views.filter_values(master).collect()} == {"Signal braking", "Turning vehicle"}
    assert views.random_rows(master, "NODEID", 1).count() == 1
