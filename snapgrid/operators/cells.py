"""Exact cosine top-k that meets part of the pairs: documents in shells of cells, queries where their best may lie.

Cells are the nearest of some centres. A shell holds the documents of a cell whose angle
to its centre lies in a range, so by the triangle inequality on the sphere a query knows
how near a document of a shell can be at most. Where the centres came from decides how
much is skipped and never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from snapgrid.operators.similarity import largest
from snapgrid.session import stage_table

# Rows that the centres are fitted on, centres and rounds at most.
SAMPLE_ROWS, MAX_CENTRES, ROUNDS = 20_000, 2_048, 8
# Documents of a shell and queries that meet its group in one task.
SHELL_ROWS, QUERY_ROWS = 4_096, 8_192
# Documents of a group: shells that follow each other and meet a query in one row.
GROUP_ROWS = 16_384
# Share of the pairs of a task from which on they are ranked at once; below it, shell by shell.
AT_ONCE, _SLAB = 0.25, 2_000_000
# What rounding may add to a bound.
_SLACK = 1e-7


@dataclass(frozen=True)
class Cells:
    """Centres, documents with their shell and its group, and a row for each shell (cell, low and high angle, n, grouped)."""

    centres: np.ndarray
    docs: DataFrame
    shells: pd.DataFrame
    smallest: list
    doc_id: str


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def fit_centres(docs: DataFrame, vector: str, n: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Directions of spherical k-means on a bounded sample of the documents."""
    rows = docs.select(vector).where(F.rand(11) <= min(1.0, 1.2 * sample_rows / max(n, 1))).limit(sample_rows).toPandas()[vector]
    units = _unit(_matrix(rows)) if len(rows) else np.zeros((0, 1))
    units = units[np.abs(units).sum(axis=1) > 0]
    count = min(MAX_CENTRES, max(1, int(sqrt(n))), len(units))
    centres = units[np.random.default_rng(5).permutation(len(units))[:count]]
    for _ in range(ROUNDS if count > 1 else 0):
        mine = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, units)
        moved = _unit(sums)
        centres = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, moved, centres)
    return centres


def build_cells(docs: DataFrame, doc_id: str, vector: str, k: int, shell_rows: int = SHELL_ROWS) -> Cells:
    """Place documents (unique ids, vectors of one length) in shells; stage ``docs`` first if it is dear to compute.

    Zero vectors have similarity 0 to everything: of them the ``k`` smallest ids are kept, as
    a cell without a centre. A cell is cut in shells at quantiles of the angle, and a shell
    that is still too large, such as one of equal vectors, by a hash of the id. One row for
    each shell comes to the driver.
    """
    n = docs.count()
    centres = fit_centres(docs, vector, n)
    slim = docs.select(F.col(doc_id), F.col(vector).alias("vector"))
    schema = StructType([*slim.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = _unit(_matrix(batch["vector"]))
            angles = _angles(units, centres) if len(centres) else np.zeros((len(units), 1))
            cell, zero = angles.argmin(axis=1), np.abs(units).sum(axis=1) == 0
            yield batch.assign(cell=np.where(zero, -1, cell).astype(np.int32), angle=np.where(zero, 0.0, angles.min(axis=1)))

    placed = stage_table(slim.mapInPandas(place, schema), "cells-placed")
    smallest = [r[0] for r in placed.select(doc_id).orderBy(doc_id).limit(k).collect()]
    zeros = placed.where("cell = -1").orderBy(doc_id).limit(k)
    placed = placed.where("cell >= 0").unionByName(zeros)
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("angle", F.array(*[F.lit(i / 64) for i in range(1, 64)])).alias("cuts"))
    # Every 64 / parts-th of the quantiles is a cut.
    parts = F.least(F.ceil(F.col("n") / shell_rows), F.lit(64))
    sizes = sizes.select(F.col("cell").alias("c"), F.filter("cuts", lambda x, i: F.floor((i + 1) * parts / 64) > F.floor(i * parts / 64)).alias("cuts"))
    ringed = placed.join(F.broadcast(sizes), F.col("cell") == F.col("c")).withColumn("ring", F.size(F.filter("cuts", lambda x: x < F.col("angle"))))
    ringed = stage_table(ringed.drop("c", "cuts"), "cells-ringed")
    crowd = ringed.groupBy(F.col("cell").alias("c"), F.col("ring").alias("r")).agg(F.ceil(F.count("*") / (2 * shell_rows)).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64(doc_id), F.col("pieces")).cast("int")
    cut = ringed.join(F.broadcast(crowd), (F.col("cell") == F.col("c")) & (F.col("ring") == F.col("r"))).withColumn("piece", piece)
    cut = stage_table(cut.drop("c", "r", "pieces"), "cells-cut")
    shells = cut.groupBy("cell", "ring", "piece").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    shells = shells.orderBy("cell", "ring", "piece").toPandas()
    shells["shell"] = np.arange(len(shells), dtype=np.int32)
    shells["grouped"] = ((shells["n"].cumsum() - 1) // GROUP_ROWS).astype(np.int32)
    number = docs.sparkSession.createDataFrame(
        shells[["cell", "ring", "piece", "shell", "grouped"]] if len(shells) else [], "cell int, ring int, piece int, shell int, grouped int"
    )
    placed = cut.join(F.broadcast(number), ["cell", "ring", "piece"]).select(doc_id, "vector", "shell", "grouped")
    return Cells(centres, placed, shells, smallest, doc_id)


def _bounds(cells: Cells, vectors: pd.Series) -> np.ndarray:
    """The largest cosine that each query (down) can have with a document of each shell."""
    shells = cells.shells
    units = _unit(_matrix(vectors))
    # Without a centre there are zero vectors only, whose bound is set below.
    angles = _angles(units, cells.centres)[:, shells["cell"].to_numpy().clip(0)] if len(cells.centres) else np.zeros((len(units), len(shells)))
    away = np.maximum(0.0, np.maximum(angles - shells["high"].to_numpy(), shells["low"].to_numpy() - angles))
    bound = np.cos(away)
    # Zero vectors on either side.
    bound[:, shells["cell"].to_numpy() < 0] = 0.0
    bound[np.abs(units).sum(axis=1) == 0] = 0.0
    return bound


def _routed(cells: Cells, queries: DataFrame, query_id: str, k: int, first: bool) -> DataFrame:
    """``query_id``, vector and shells of each query: the best ones that hold k documents, or all others that may beat ``beat``.

    ``parts`` has the same shells by group: a list for each, with the group before them.
    """
    small = Cells(cells.centres, None, cells.shells, [], cells.doc_id)
    fields = [queries.schema[query_id], StructField("vector", queries.schema["vector"].dataType), StructField("shells", ArrayType(IntegerType()))]
    fields.append(StructField("parts", ArrayType(ArrayType(IntegerType()))))
    sizes, group = cells.shells["n"].to_numpy(), cells.shells["grouped"].to_numpy()

    def by_group(shells: list[int]) -> list[list[int]]:
        ordered = np.sort(np.array(shells, np.int64))
        starts = np.flatnonzero(np.diff(group[ordered])) + 1
        return [[int(group[part[0]]), *part.tolist()] for part in np.split(ordered, starts) if len(part)]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.iloc[at : at + 512]
                bounds, out = _bounds(small, batch["vector"]), []
                for row, bound in enumerate(bounds):
                    order = np.argsort(-bound, kind="stable")
                    begun = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1
                    if first:
                        out.append(order[:begun].tolist())
                    else:
                        rest = order[begun:]
                        out.append(rest[bound[rest] >= batch["beat"].iloc[row] - _SLACK].tolist())
                yield pd.DataFrame({query_id: batch[query_id], "vector": batch["vector"], "shells": out, "parts": [by_group(x) for x in out]})

    columns = [query_id, "vector"] if first else [query_id, "vector", "beat"]
    return queries.select(*columns).mapInPandas(route, StructType(fields))


def _best_in_group(query_id: str, doc_id: str, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best documents of a group for each query, among the shells that the query asks for (or k of each)."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({query_id: [], doc_id: [], "sim": []})
        right = right.sort_values(doc_id, ignore_index=True)
        queries, docs = _unit(_matrix(left["vector"])), _unit(_matrix(right["vector"]))
        shells, of = np.unique(right["shell"].to_numpy(), return_inverse=True)
        columns, found = [np.flatnonzero(of == j) for j in range(len(shells))], []
        asked = np.zeros((len(left), len(shells)), dtype=bool)
        rows = np.repeat(np.arange(len(left)), left["shells"].map(len).to_numpy(dtype=np.int64))
        asked[rows, np.searchsorted(shells, np.concatenate(left["shells"].to_numpy()))] = True

        def add(row: np.ndarray, column: np.ndarray, sims: np.ndarray) -> None:
            place, sims = largest(sims, k)
            # What was not asked for.
            kept = ~np.isneginf(sims).ravel()
            ids = left[query_id].to_numpy()[np.repeat(row, place.shape[1])[kept]]
            found.append(pd.DataFrame({query_id: ids, doc_id: right[doc_id].to_numpy()[column[place.ravel()[kept]]], "sim": sims.ravel()[kept]}))

        if (asked * np.bincount(of)).sum() >= AT_ONCE * len(left) * len(right):
            step = max(1, _SLAB // len(right))
            for at in range(0, len(left), step):
                part = np.arange(at, min(at + step, len(left)))
                if asked[part].all():
                    sims = queries[part] @ docs.T
                else:
                    sims = np.full((len(part), len(right)), -np.inf)
                    for j, column in enumerate(columns):
                        row = np.flatnonzero(asked[part, j])
                        sims[np.ix_(row, column)] = queries[part[row]] @ docs[column].T
                add(part, np.arange(len(right)), sims)
        else:
            for j, column in enumerate(columns):
                row, step = np.flatnonzero(asked[:, j]), max(1, _SLAB // len(column))
                for at in range(0, len(row), step):
                    add(row[at : at + step], column, queries[row[at : at + step]] @ docs[column].T)
        return pd.concat(found)

    return best


def _meet(cells: Cells, routed: DataFrame, query_id: str, k: int) -> DataFrame:
    """The best of each query in its shells; a query is one row for each group of them, and the queries of a group meet it in chunks."""
    doc_id = cells.doc_id
    asked = routed.select(query_id, "vector", F.explode("parts").alias("part"))
    shells = F.slice("part", F.lit(2), F.size("part") - 1).alias("shells")
    asked = stage_table(asked.select(query_id, "vector", F.col("part")[0].alias("grouped"), shells), "cells-asked")
    crowd = asked.groupBy("grouped").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks"))
    crowd = stage_table(crowd, "cells-crowd")
    chunk = F.pmod(F.xxhash64(query_id), F.col("chunks")).cast("int")
    left = asked.join(F.broadcast(crowd), "grouped").withColumn("chunk", chunk).drop("chunks")
    right = cells.docs.join(F.broadcast(crowd), "grouped").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    schema = StructType([routed.schema[query_id], cells.docs.schema[doc_id], StructField("sim", DoubleType())])
    return left.groupBy("grouped", "chunk").cogroup(right.groupBy("grouped", "chunk")).applyInPandas(_best_in_group(query_id, doc_id, k), schema)


def _ranked(candidates: DataFrame, query_id: str, doc_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(query_id).orderBy(F.col("sim").desc(), doc_id)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_pruned(cells: Cells, queries: DataFrame, query_id: str, query_vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``similarity.top_k_dense``, and one row with pairs met and all pairs.

    ``k`` is at most that of ``build_cells``. Each query meets the shells that promise most
    until it has k documents, then every other shell that may hold a better one.
    """
    doc_id, total = cells.doc_id, int(cells.shells["n"].sum())
    queries = stage_table(queries.select(query_id, F.col(query_vector).alias("vector")), "cells-queries")
    n_queries = queries.count()
    if not total or not n_queries:
        schema = StructType([queries.schema[query_id], cells.docs.schema[doc_id], StructField("sim", DoubleType()), StructField("rank", IntegerType())])
        spark = queries.sparkSession
        return spark.createDataFrame([], schema), spark.createDataFrame([(0, 0)], "met long, pairs long")
    any_number = F.exists("vector", lambda x: x != 0)
    directed, still = queries.where(any_number), queries.where(~any_number)
    routed = stage_table(_routed(cells, directed, query_id, k, True), "cells-first")
    found = stage_table(_ranked(_meet(cells, routed, query_id, k), query_id, doc_id, k), "cells-found")
    kth = found.where(F.col("rank") == k).select(query_id, F.col("sim").alias("beat"))
    # Fewer than k documents in all shells: nothing more to find.
    again = stage_table(_routed(cells, directed.join(kth, query_id), query_id, k, False), "cells-again")
    more = _meet(cells, again.where(F.size("shells") > 0), query_id, k)
    best = _ranked(found.drop("rank").unionByName(more), query_id, doc_id, k)
    # A query without a direction has similarity 0 to all: the smallest ids.
    ids: Column = F.array(*[F.lit(i) for i in cells.smallest[:k]])
    nowhere = still.select(query_id, F.posexplode(ids).alias("rank", doc_id)).select(
        query_id, doc_id, F.lit(0.0).alias("sim"), (F.col("rank") + 1).alias("rank")
    )
    sizes = F.array(*[F.lit(int(n)) for n in cells.shells["n"]]) if len(cells.shells) <= 4_096 else None
    shells = routed.select("shells").unionByName(again.select("shells"))
    if sizes is not None:
        met = shells.select(F.aggregate("shells", F.lit(0).cast("long"), lambda acc, s: acc + F.get(sizes, s)).alias("m")).agg(F.sum("m").alias("met"))
    else:
        held = queries.sparkSession.createDataFrame(cells.shells[["shell", "n"]])
        met = shells.select(F.explode("shells").alias("shell")).join(F.broadcast(held), "shell").agg(F.sum("n").alias("met"))
    report = met.select(F.coalesce("met", F.lit(0)).cast(LongType()).alias("met"), F.lit(n_queries * total).cast(LongType()).alias("pairs"))
    return best.unionByName(nowhere), report
