"""Ranked search against a plain scorer, and what the sharing of term sets keeps."""

import math
import re
from collections import Counter

import numpy as np

from snapgrid.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = [f"w{k}" for k in range(60)] + ["été", "ÄRGER", "Ab", "aB", "日本", "x1y"]


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counted = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, n_all = len(counted), sum(len(t) for _, t in counted)
    in_docs = Counter(t for _, ts in counted for t in set(ts))
    out = []
    for item, text in items:
        scored = []
        for id_, ts in counted:
            m, tf = 100 - 50 + 50 * len(ts) * n_docs // n_all, Counter(ts)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * in_docs[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
                for t in set(terms(text)) if t in tf
            )
            if score > 0:
                scored.append((-score, id_ is not None, id_))
        out += [(item, r, id_, -s) for r, (s, _, id_) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "a", 2.0) for i, t in docs], "doc_id long, text string, rank int, query string, score double").repartition(3)
    return d, spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")


def test_equals_the_plain_scorer(spark):
    rng = np.random.default_rng(2)
    docs = [(k, " ".join(rng.choice(WORDS, rng.integers(1, 50)))) for k in range(120)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, docs[3][1]), (300, None), (301, ""), (302, "-- ,."), (303, "w1 " * 50_000)]
    common = " ".join(WORDS[:12])
    items = [(k, common + " " + " ".join(rng.choice(WORDS, 6))) for k in range(15)]
    items += [(20, None), (21, ""), (22, "unknownword"), (3, items[3][1]), (None, "w1 w2 AB"), (23, docs[5][1])]
    d, q = tables(spark, docs, items)
    for k, block in ((5, 2 << 20), (50, 100)):
        got = [tuple(r) for r in lexical.search(d, q, k, block_bytes=block).collect()]
        assert sorted(got, key=str) == brute(docs, items, k)


def test_slices_of_documents_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = [(k, " ".join(rng.choice(WORDS[:8], 4))) for k in range(200)]
    items = [(0, "w1 w2 w3"), (1, "w1 w2 w3 w4"), (2, "w1 w2 w3 w5")]
    monkeypatch.setattr(lexical, "CELLS", 100)
    d, q = tables(spark, docs, items)
    assert sorted([tuple(r) for r in lexical.search(d, q, 10).collect()], key=str) == brute(docs, items, 10)


def test_empty_tables(spark):
    d, q = tables(spark, [(1, "w1")], [(1, "w1")])
    assert lexical.search(d.limit(0), q).count() == lexical.search(d, q.limit(0)).count() == 0


def test_shared_sets_are_disjoint_and_whole():
    rng = np.random.default_rng(8)
    core = [set(range(0, 10)), set(range(6, 18)), set(range(20, 30))]
    sets = [set().union(*[core[c] for c in rng.choice(3, 2)], {int(x) for x in rng.integers(30, 90, 5)}) for _ in range(40)]
    nodes, members = lexical.shared_sets(sets, 100)

    def spread(m):
        out = []
        for x in m:
            out += [x] if x < 100 else spread(nodes[x - 100])
        return out

    for whole, m in zip(sets, members, strict=True):
        found = spread(m)
        assert len(found) == len(set(found)) and set(found) == whole
    plan = lexical.Plan(list(map(str, range(40))), sets, np.ones(100, dtype=np.int64))
    assert plan.additions() < sum(map(len, sets)) / 2
