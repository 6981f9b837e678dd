"""Ranked lexical search: many queries at once over shared partial scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from graphlib import TopologicalSorter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapgrid.llm.common import slices
from snapgrid.session import stage_table

#: Bytes of query text that are evaluated in one pass; more queries take more passes.
BLOCK_BYTES = 2 << 20
#: Partial scores that a task holds at once (8 bytes each).
CELLS = 4_000_000
#: Fewest members of a shared set that is worth an accumulator of its own.
LEAST_SHARED = 3

#: ASCII letters and digits, A-Z lower-cased, and all bytes of other code points stay; the rest separates.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return (text or b"").translate(_FOLD).split()


def weight(n_docs: int, in_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * in_docs + 1)))


def shared_sets(sets: Sequence[set[int]], n_terms: int, least: int = LEAST_SHARED) -> tuple[list[list[int]], list[list[int]]]:
    """Mine what ``sets`` share: (members of each shared node, members of each set).

    Members are terms (below ``n_terms``) and nodes (``n_terms`` and up, in the order of
    the first list); everything below a member list is disjoint and together is the set.
    The two sets, nodes included, with most in common give a node; all sets that hold the
    whole of it refer to it from then on. Ends when no two have ``least`` members in common.
    """
    used = sorted(set().union(*sets)) if sets else []
    place = {t: k for k, t in enumerate(used)}
    most = len(sets) + max(0, sum(map(len, sets)) - len(used)) // max(1, least - 1)
    rows = np.zeros((len(sets), len(used)), dtype=np.float32)
    for i, s in enumerate(sets):
        rows[i, [place[t] for t in s]] = 1
    grown = np.zeros((len(sets), 0), dtype=np.float32)
    common = rows @ rows.T
    np.fill_diagonal(common, 0)
    made = 0
    while len(common) and common.max() >= least and made < most:
        i, j = divmod(int(common.argmax()), len(common))
        both = np.concatenate([rows[i] * rows[j], grown[i] * grown[j]])
        whole = np.concatenate([rows, grown], axis=1)
        holders = np.flatnonzero(whole @ both >= both.sum())
        rows[holders] *= 1 - both[: len(used)]
        grown[holders] *= 1 - both[len(used) :]
        mark = np.zeros((len(rows), 1), dtype=np.float32)
        mark[holders] = 1
        rows = np.concatenate([rows, both[None, : len(used)]])
        grown = np.concatenate([np.concatenate([grown, mark], axis=1), np.append(both[len(used) :], 0)[None]])
        common = np.pad(common, ((0, 1), (0, 1)))
        made += 1
        whole = np.concatenate([rows, grown], axis=1)
        for r in [*holders, len(rows) - 1]:
            common[r] = common[:, r] = whole @ whole[r]
            common[r, r] = 0
    listed = [
        [used[k] for k in np.flatnonzero(rows[r])] + [n_terms + int(k) for k in np.flatnonzero(grown[r])] for r in range(len(rows))
    ]
    return listed[len(sets) :], listed[: len(sets)]


class Plan:
    """The queries of a block as a sharing DAG over term weights."""

    def __init__(self, keys: Sequence[str], sets: Sequence[set[int]], weights: np.ndarray):
        useful = [{t for t in s if weights[t] > 0} for s in sets]
        self.keys, self.weights, self.n_terms = list(keys), weights, len(weights)
        nodes, self.queries = shared_sets(useful, self.n_terms)
        order = TopologicalSorter({k + self.n_terms: [c for c in members if c >= self.n_terms] for k, members in enumerate(nodes)})
        self.nodes = [(k, nodes[k - self.n_terms]) for k in order.static_order()]

    def additions(self) -> int:
        """Members that are added up for one document that holds every term."""
        return sum(len(m) for _, m in self.nodes) + sum(map(len, self.queries))

    def scores(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
        """Score of each query (down) for each of ``n_rows`` documents, from each posting's part."""
        sums = np.zeros((self.n_terms + len(self.nodes), n_rows), dtype=np.int64)
        sums[term, row] = value
        for k, members in self.nodes:
            np.add.reduce(sums[members], axis=0, out=sums[k])
        found = np.zeros((len(self.queries), n_rows), dtype=np.int64)
        for q, members in enumerate(self.queries):
            if members:
                np.add.reduce(sums[members], axis=0, out=found[q])
        return found


def matched_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str, text: str) -> DataFrame:
    """id, n (terms of the whole text), terms and tf: those that the vocabulary has; texts without a term drop out."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    slim = docs.select(F.col(text).alias("text"), F.col(id_column).cast("long").alias("id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in slices(batches, "text"):
            ids, sizes, terms, tfs = [], [], [], []
            for id_, text_ in zip(batch.column(1).to_pylist(), batch.column(0).cast(pa.binary()).to_pylist(), strict=True):
                if found := terms_of(text_):
                    counts = Counter(found)
                    held = counts.keys() & number.keys()
                    ids.append(id_)
                    sizes.append(len(found))
                    terms.append([number[t] for t in held])
                    tfs.append([counts[t] for t in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                ["id", "n", "terms", "tf"],
            )

    return slim.mapInArrow(count, "id long, n long, terms array<int>, tf array<long>")


def best_in_tasks(matched: DataFrame, plan: Plan, n_docs: int, n_all: int, k: int) -> DataFrame:
    """query (key), id, score: the ``k`` best of each query among the documents of one task."""
    shared = matched.sparkSession.sparkContext.broadcast(plan)
    at_once = max(1, CELLS // (plan.n_terms + len(plan.nodes) + len(plan.queries) + 1))

    def first_k(query: np.ndarray, score: np.ndarray, null: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((id_, ~null, -score, query))
        query = query[order]
        order = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
        return score[order], null[order], id_[order]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        n_queries = len(plan.queries)
        query, score, null, id_ = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        bar = np.ones(n_queries, dtype=np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, at_once):
                batch = whole.slice(a, at_once)
                ids = batch.column(0)
                # Exact whatever the size of the numbers.
                m = np.array([50 + 50 * n * n_docs // n_all for n in batch.column(1).to_pylist()], dtype=np.int64)
                term = batch.column(2).flatten().to_numpy().astype(np.int64)
                tf = batch.column(3).flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(batch.column(2)).to_numpy())
                value = plan.weights[term] * (1_000_000_000 * tf // (1_000 * tf + 20 * m[row]))
                scores = plan.scores(row, term, value, batch.num_rows)
                q, r = np.nonzero(scores >= bar[:, None])
                query, score = np.concatenate([query, q]), np.concatenate([score, scores[q, r]])
                null = np.concatenate([null, ids.is_null().to_numpy(zero_copy_only=False)[r]])
                id_ = np.concatenate([id_, ids.fill_null(0).to_numpy()[r]])
                keep_query = np.sort(query)
                keep_query = keep_query[np.arange(len(keep_query)) - np.searchsorted(keep_query, keep_query) < k]
                score, null, id_ = first_k(query, score, null, id_)
                query = keep_query
                # A query that has its k takes no smaller score from now on.
                full = np.flatnonzero(np.bincount(query, minlength=n_queries) >= k)
                bar[full] = score[np.searchsorted(query, full, side="right") - 1]
        keys = pa.array(plan.keys, pa.string()).take(pa.array(query))
        yield pa.RecordBatch.from_arrays([keys, pa.array(id_, mask=null), pa.array(score)], ["query", "id", "score"])

    return matched.select("id", "n", "terms", "tf").mapInArrow(rank, "query string, id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the ``k`` documents that score highest, above 0.

    Items with equal texts are one query. Queries are cut in blocks of some
    ``block_bytes`` of text. For each block one pass over the whole texts finds the terms
    that its queries have; statistics cover all documents. Sets of terms that queries
    share are mined, each has one accumulator a document, and queries add up along the
    DAG. Each task hands on its best ``k`` a query; a limited rank leaves the best of all.

    Every row of either table counts for itself: repeated documents each take a rank, a
    repeated item is ranked for each of its rows. Equal scores stand by ascending doc_id,
    a missing id first. Null and termless items have no rows, termless documents no part.
    Empty tables give an empty one; other columns play no part.
    """
    spark = docs.sparkSession
    named = items.select(F.col(item_id).alias("item_id"), F.sha2(text, 256).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    asked = stage_table(named.select("key", "text").distinct(), "lexical-queries")
    held = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(held / block_bytes))
    ranked = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).orderBy("key").collect()
        found = [terms_of(r.text.encode()) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*found)))}
        matched = stage_table(matched_terms(docs, vocabulary, doc_id, text), "lexical-terms")
        n_docs, n_all = matched.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        in_docs = dict(matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([weight(n_docs, in_docs[t]) if t in in_docs else 0 for t in range(len(vocabulary))], dtype=np.int64)
        plan = Plan([r.key for r in rows], [{vocabulary[t] for t in f} for f in found], weights)
        ranked.append(best_in_tasks(matched, plan, n_docs, n_all, k))
    best = ranked[0]
    for more in ranked[1:]:
        best = best.union(more)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return named.select("item_id", "key").join(best, F.col("key") == F.col("query")).select("item_id", "rank", F.col("id").alias("doc_id"), "score")
