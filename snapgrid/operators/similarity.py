"""Cosine ranking of documents per query, dense or sparse.

Scores are rounded to ``SCORE_DIGITS`` before they are ranked, so that equal
vectors tie whatever order their products were added in; the smaller document id
wins a tie. A zero vector has similarity 0 to everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from snapgrid.operators.blocks import BLOCK_ROWS, reduce_blocks

SCORE_DIGITS = 9
_SLAB = 2_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense array columns of one row."""

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)

    def product(x: Column, y: Column) -> Column:
        return x.cast("double") * y.cast("double")

    dot = total(F.zip_with(a, b, product))
    norms = F.sqrt(total(F.zip_with(a, a, product))) * F.sqrt(total(F.zip_with(b, b, product)))
    return F.coalesce(F.try_divide(dot, norms), F.lit(0.0))


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def dense_scores(queries: pd.DataFrame, docs: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
    d = _unit(np.stack(docs["vector"].to_numpy()).astype(float))
    step = max(1, _SLAB // len(docs))
    for at in range(0, len(queries), step):
        part = slice(at, min(at + step, len(queries)))
        yield part, _unit(np.stack(queries["vector"].to_numpy()[part]).astype(float)) @ d.T


def _flat(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and weight of everything that the rows list."""
    sizes = frame["terms"].map(len).to_numpy(dtype=np.int64)
    row = np.repeat(np.arange(len(frame)), sizes)
    if not sizes.sum():
        return row, np.zeros(0, np.int64), np.zeros(0)
    return row, np.concatenate(frame["terms"].to_numpy()), np.concatenate(frame["weights"].to_numpy())


def _sparse_scores(queries: pd.DataFrame, docs: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
    """Products by way of an index from word to documents: only words that both sides have cost anything."""
    d_row, d_term, d_weight = _flat(docs)
    order = np.argsort(d_term, kind="stable")
    d_row, d_term, d_weight = d_row[order], d_term[order], d_weight[order]
    step = max(1, _SLAB // len(docs))
    for at in range(0, len(queries), step):
        part = slice(at, min(at + step, len(queries)))
        q = queries.iloc[part]
        q_row, q_term, q_weight = _flat(q)
        first = np.searchsorted(d_term, q_term)
        found = np.searchsorted(d_term, q_term, side="right") - first
        scores = np.zeros(len(q) * len(docs))
        # A word of a query and a document each; some millions of them at a time.
        ends = np.cumsum(found)
        cuts = np.searchsorted(ends, np.arange(_SLAB, ends[-1] if len(ends) else 0, _SLAB))
        for a, b in zip([0, *cuts], [*cuts, len(q_term)]):
            n = found[a:b]
            if not n.sum():
                continue
            posting = np.repeat(first[a:b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            cell = np.repeat(q_row[a:b] * len(docs), n) + d_row[posting]
            scores += np.bincount(cell, np.repeat(q_weight[a:b], n) * d_weight[posting], len(scores))
        scale = q["norm"].to_numpy()[:, None] * docs["norm"].to_numpy()[None, :]
        scores = scores.reshape(len(q), len(docs))
        yield part, np.divide(scores, scale, out=np.zeros_like(scores), where=scale > 0)


def _rounded_best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    sims = np.round(sims, SCORE_DIGITS) + 0.0
    best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return best, np.take_along_axis(sims, best, axis=1)


def largest(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rounded scores of the k best of each row, best first, the smaller column on a tie.

    Rows are not sorted whole: what rounds to the k-th best score or more is picked out first. Only
    rows where too much does, or whose scores are not numbers, are sorted.
    """
    rows, n = sims.shape
    most = 2 * k + 16
    if n <= most:
        return _rounded_best(sims, k)
    top = np.partition(sims, n - k, axis=1)[:, n - k :]
    near = sims >= top[:, :1] - 2 * 10.0**-SCORE_DIGITS
    found = np.count_nonzero(near, axis=1)
    # What is no number counts as the largest there.
    hard = (found > most) | np.isnan(top).any(axis=1)
    best, scores = np.empty((rows, k), np.int64), np.empty((rows, k))
    if hard.any():
        best[hard], scores[hard] = _rounded_best(sims[hard], k)
        near[hard] = False
    row, column = np.nonzero(near)
    value = np.round(sims[row, column], SCORE_DIGITS) + 0.0
    order = np.lexsort((column, -value, row))
    starts = np.cumsum(np.where(hard, 0, found)) - np.where(hard, 0, found)
    taken = order[(starts[~hard][:, None] + np.arange(k)).astype(np.int64)]
    best[~hard], scores[~hard] = column[taken], value[taken]
    return best, scores


def best_of(
    query_id: str, doc_id: str, k: int, scores: Callable[[pd.DataFrame, pd.DataFrame], Iterator[tuple[slice, np.ndarray]]]
) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best of the right rows for each of the left rows, as a function of two frames."""

    def best_in_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({query_id: [], doc_id: [], "sim": []})
        right = right.sort_values(doc_id, ignore_index=True)
        ids, parts = right[doc_id].to_numpy(), []
        for part, sims in scores(left, right):
            best, sims = largest(sims, k)
            parts.append(
                pd.DataFrame(
                    {
                        query_id: np.repeat(left[query_id].to_numpy()[part], best.shape[1]),
                        doc_id: ids[best].ravel(),
                        "sim": sims.ravel(),
                    }
                )
            )
        return pd.concat(parts)

    return best_in_block


def _top_k(
    queries: DataFrame,
    docs: DataFrame,
    query_id: str,
    doc_id: str,
    k: int,
    scores: Callable[[pd.DataFrame, pd.DataFrame], Iterator[tuple[slice, np.ndarray]]],
    values: str,
    block_rows: int,
) -> DataFrame:
    schema = StructType(
        [
            StructField(query_id, queries.schema[query_id].dataType),
            StructField(doc_id, docs.schema[doc_id].dataType),
            StructField("sim", DoubleType()),
        ]
    )

    candidates = reduce_blocks(
        queries, docs, [query_id], [doc_id], best_of(query_id, doc_id, k, scores), schema, F.size(values) + 1, block_rows
    )
    order = Window.partitionBy(query_id).orderBy(F.col("sim").desc(), doc_id)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_dense(
    queries: DataFrame,
    docs: DataFrame,
    query_id: str,
    doc_id: str,
    query_vector: str,
    doc_vector: str,
    k: int,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, doc_id, sim, rank`` of the k most similar documents per query.

    Exact. Every block of queries meets every block of documents in a task of
    bounded size, which hands on k rows per query; both ids must be unique.
    """
    return _top_k(
        queries.select(query_id, F.col(query_vector).alias("vector")),
        docs.select(doc_id, F.col(doc_vector).alias("vector")),
        query_id, doc_id, k, dense_scores, "vector", block_rows,
    )


def top_k_sparse(
    queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, k: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The same for word vectors: ``terms`` (word numbers) with ``weights``, and the ``norm``."""
    columns = ["terms", "weights", "norm"]
    return _top_k(
        queries.select(query_id, *columns), docs.select(doc_id, *columns),
        query_id, doc_id, k, _sparse_scores, "terms", block_rows,
    )
