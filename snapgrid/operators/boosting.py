"""Gradient-boosted trees, one label against the rest, grown level by level for all labels at once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.session import scratch_folder, stage_table

# Cells that a feature is cut into, and the quantiles among which the cuts are chosen.
BINS, QUANTILES = 32, 1_000
BLOCK_ROWS = 50_000
# A task streams its blocks; above this many rows there are more tasks than cores.
ROWS_A_TASK = 2_000_000
# Residuals are summed as whole multiples of its inverse, so the order of a sum decides nothing. A row adds
# ONE and its residual (4 at most) to one sum of its block: both are whole and BLOCK_ROWS of them stay exact.
PRECISION, ONE = float(1 << 16), float(1 << 36)
# Trees after which the rows with their margins are written, which ends the chain of steps.
CUT_EVERY = 25
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class BoostedTrees:
    """Trees as heaps of nodes: arrays by tree, label and node; a leaf has feature -1.

    A row goes right where its cell of the feature is above ``cell``. ``value`` holds the rate.
    """

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    feature: np.ndarray
    cell: np.ndarray
    value: np.ndarray

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """Summed values of each label (rows) for each row (columns)."""
        made = np.zeros((self.feature.shape[1], bins.shape[1]))
        for feature, cell, value in zip(self.feature, self.cell, self.value, strict=True):
            add_tree(made, bins, feature, cell, value)
        return made

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``: the label with the largest margin, the first of equals."""

        def predicted(*columns: pa.Array) -> pa.Array:
            cells = binned([c.to_numpy(zero_copy_only=False) for c in columns], self.cuts)
            return pa.array(self.margins(cells).argmax(axis=0).astype(float))

        return df.withColumn("prediction", F.arrow_udf(predicted, "double")(*[F.col(c).cast("double") for c in self.features]))

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes and cuts as Parquet; what was there goes."""
        trees, labels, nodes = self.feature.shape
        tree, label, node = (x.ravel() for x in np.mgrid[:trees, :labels, :nodes])
        columns = {"tree": tree, "label": label, "node": node, "feature": self.feature.ravel(), "cell": self.cell.ravel()}
        table = pa.table({**{c: x.astype(np.int32) for c, x in columns.items()}, "value": self.value.ravel()})
        spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        cuts = list(zip(range(len(self.cuts)), self.features, map(list, self.cuts), strict=True))
        spark.createDataFrame(cuts, "nth int, feature string, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cuts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        cuts = spark.read.parquet(f"{path}/cuts").orderBy("nth").collect()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "label", "node").toArrow()
        shape = tuple(pa.compute.max(nodes[c]).as_py() + 1 for c in ("tree", "label", "node"))
        feature, cell, value = (nodes[c].to_numpy().reshape(shape) for c in ("feature", "cell", "value"))
        return BoostedTrees(tuple(r.feature for r in cuts), tuple(tuple(r.cuts) for r in cuts), feature, cell, value)


def binned(columns: list[np.ndarray], cuts: tuple[tuple[float, ...], ...]) -> np.ndarray:
    """The cell of each value, a row for each feature."""
    return np.stack([np.searchsorted(c, x).astype(np.uint8) for x, c in zip(columns, cuts, strict=True)])


def place(bins: np.ndarray, feature: np.ndarray, cell: np.ndarray, levels: int) -> np.ndarray:
    """The node of one tree that each row comes to in ``levels`` steps, or the leaf before."""
    n = bins.shape[1]
    flat, rows, node = bins.ravel(), np.arange(n), np.zeros(n, dtype=np.int64)
    start = feature.astype(np.int64) * n
    for _ in range(levels):
        right = flat.take(np.maximum(start[node], 0) + rows) > cell[node]
        node = np.where(feature[node] >= 0, 2 * node + 1 + right, node)
    return node


def add_tree(margins: np.ndarray, bins: np.ndarray, feature: np.ndarray, cell: np.ndarray, value: np.ndarray) -> None:
    depth = (feature.shape[1] + 1).bit_length() - 2
    for k in range(len(feature)):
        margins[k] += value[k][place(bins, feature[k], cell[k], depth)]


def draw(keys: np.ndarray, seed: int, round: int) -> np.ndarray:
    """A number from 0 to 1 for each key: the same wherever the row lies."""
    x = keys ^ np.random.default_rng([seed % (1 << 32), round]).integers(0, 1 << 64, dtype=np.uint64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(33))) >> np.uint64(11)) * 2.0**-53


def choose_cuts(quantiles: list[float]) -> tuple[float, ...]:
    """At most BINS - 1 cuts that share the rows evenly; a common value takes one and leaves the rest to the others."""
    values, counts = np.unique(np.array(quantiles, dtype=float), return_counts=True)
    if len(values) < BINS:
        return tuple(map(float, values))
    cuts, left, held = [], counts.sum(), 0
    for value, n in zip(values, counts, strict=True):
        held += n
        if len(cuts) < BINS - 1 and held * (BINS - len(cuts)) >= left:
            cuts.append(float(value))
            left, held = left - held, 0
    return tuple(cuts)


def _blocks(rows: DataFrame, features: tuple[str, ...], cuts: tuple[tuple[float, ...], ...], labels: int, parts: int) -> RDD:
    """(keys, cells, labels, margins) of at most BLOCK_ROWS rows each, dealt evenly to ``parts`` tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if n + part.num_rows > BLOCK_ROWS:
                    yield packed(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        cells = binned([table[c].to_numpy() for c in features], cuts)
        marks = table["label"].to_numpy().astype(np.uint8 if labels < 256 else np.int64)
        made = (table["drawn"].to_numpy(), cells, marks)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in made], ["keys", "cells", "marks"])

    def opened(numbered: tuple) -> tuple:
        _, (keys, cells, marks) = numbered
        marks = np.frombuffer(marks, np.uint8 if labels < 256 else np.int64)
        cells = np.frombuffer(cells, np.uint8).reshape(len(features), len(marks))
        return np.frombuffer(keys, np.uint64), cells, marks, np.zeros((labels, len(marks)), np.float32)

    typed = rows.select("label", "drawn", *[F.col(c).cast("double") for c in features])
    table = stage_table(typed.mapInArrow(pack, "keys binary, cells binary, marks binary"), "boosting_rows")
    numbered = table.rdd.zipWithIndex().map(lambda x: (x[1], tuple(x[0])))
    return numbered.partitionBy(parts, lambda number: number).map(opened)


@dataclass(frozen=True)
class _Level:
    """One level of the trees of one round; sums go over a draw of the rows that is the same at every level."""

    settings: object
    round: int
    level: int
    feature: np.ndarray
    cell: np.ndarray
    weights: np.ndarray

    def sums(self, blocks: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        """(label, rows and residuals by feature, class, node and cell)."""
        labels, slots = len(self.weights), 1 << self.level
        made: list = [None] * labels
        for keys, cells, marks, margins in blocks:
            drawn = np.flatnonzero(draw(keys, self.settings.seed, self.round) < self.settings.row_share)
            cells, marks, margins = cells[:, drawn], marks[drawn].astype(np.int64), margins[:, drawn]
            size = labels * (slots + 1) * BINS
            for k in range(labels):
                # Rows in a leaf above this level go to a slot of their own.
                node = place(cells, self.feature[k], self.cell[k], self.level) - (slots - 1)
                base = (marks * (slots + 1) + np.where(node >= 0, node, slots)) * BINS
                side = np.where(marks == k, 1.0, -1.0)
                rest = side if not self.round else 4 * side / (1 + np.exp(np.clip(2.0 * side * margins[k], -60, 60)))
                rest = np.rint(rest * PRECISION) + ONE
                if made[k] is None:
                    made[k] = np.zeros((2, len(cells), size))
                for f, cell in enumerate(cells):
                    both = np.bincount(base + cell, weights=rest, minlength=size)
                    counted = np.rint(both / ONE)
                    made[k][0, f] += counted
                    made[k][1, f] += both - counted * ONE
        for k, found in enumerate(made):
            if found is not None:
                yield k, found.reshape(2, -1, labels, slots + 1, BINS)[:, :, :, :slots]

    def splits(self, found: tuple[int, np.ndarray]) -> tuple[int, list[tuple]]:
        """(label, [(node, feature, cell, mean left, mean right, mean)]); feature -1 where nothing is gained."""
        k, sums = found
        rows = sums[0].sum(axis=1).cumsum(axis=-1)
        weight = np.einsum("l,flnb->fnb", self.weights, sums[0]).cumsum(axis=-1)
        total = np.einsum("l,flnb->fnb", self.weights, sums[1]).cumsum(axis=-1) / PRECISION
        n_left, w_left, s_left = rows[..., :-1], weight[..., :-1], total[..., :-1]
        n_right, w_right, s_right = rows[..., -1:] - n_left, weight[..., -1:] - w_left, total[..., -1:] - s_left
        least = max(1, self.settings.min_rows)
        fits = (n_left >= least) & (n_right >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            left, right, mean = s_left / w_left, s_right / w_right, total[..., -1:] / weight[..., -1:]
            # Drop of the weighted variance.
            gain = (s_left * left + s_right * right - total[..., -1:] * mean) / weight[..., -1:]
        gain = np.where(fits & (gain > LEAST_GAIN) & (gain >= self.settings.min_gain), gain, -1.0)
        features, out = len(gain), []
        for slot in range(gain.shape[1]):
            if not rows[0, slot, -1]:
                continue
            node = (1 << self.level) - 1 + slot
            order = np.random.default_rng([self.settings.seed % (1 << 32), self.round, k, node]).permutation(features)
            here = gain[:, slot].copy()
            here[order[ceil(self.settings.column_share * features) :]] = -1.0
            f, b = np.unravel_index(here.argmax(), here.shape)
            if here[f, b] > 0:
                out.append((node, int(f), int(b), float(left[f, slot, b]), float(right[f, slot, b]), float(mean[f, slot, 0])))
            else:
                out.append((node, -1, 0, 0.0, 0.0, float(mean[0, slot, 0])))
        return k, out


def fit_boosted(rows: DataFrame, labels: int, weights: Mapping[int, float], settings) -> BoostedTrees:
    """``settings.trees`` boosted trees for each label against the rest, on rows with ``label``, scaled features and ``drawn``, a hash by
    which rows are drawn for a round.

    Logistic loss; a tree fits its residuals by weighted variance, the first one the sides
    themselves. A level of the trees of all labels is one Spark job: tasks count rows and
    residuals by cell, they are added up and the splits chosen for each label in a task of its own, and the driver sees
    the splits. Rows lie in blocks of one byte a feature beside their margins, which are
    carried from tree to tree. ``weights`` are by label.
    """
    spark = rows.sparkSession
    # One text for each feature: as columns, every quantile would be a call to the JVM.
    asked = f"array({', '.join(f'{k / QUANTILES}D' for k in range(QUANTILES + 1))})"
    quantiles = [F.expr(f"percentile_approx(cast(`{c}` AS double), {asked}, {2 * QUANTILES})").alias(c) for c in settings.features]
    found = rows.agg(F.count("*").alias("n"), *quantiles).first()
    if not found.n:
        raise ValueError("no rows to fit")
    cuts = tuple(choose_cuts(found[c]) for c in settings.features)
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(cores, ceil(found.n / BLOCK_ROWS)), ceil(found.n / ROWS_A_TASK))
    kept = StorageLevel.MEMORY_AND_DISK
    state = _blocks(rows.coalesce(parts), tuple(settings.features), cuts, labels, parts).persist(kept)
    by_label = np.array([weights.get(k, 1.0) for k in range(labels)])
    nodes = (1 << (settings.depth + 1)) - 1
    shape = (settings.trees, labels, nodes)
    feature, cell, value = np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape)
    before = None
    try:
        for t in range(settings.trees):
            rate = settings.rate if t else 1.0
            for level in range(max(1, settings.depth)):
                step = _Level(settings, t, level, feature[t], cell[t], by_label)
                sums = state.mapPartitions(step.sums)
                # One task has whole sums: there is nothing to add up.
                grown = (sums if parts == 1 else sums.reduceByKey(np.add, labels)).map(step.splits).collect()
                if before is not None:
                    before.unpersist()
                    before = None
                split = False
                for k, chosen in grown:
                    for node, f, b, left, right, mean in chosen:
                        if not level:
                            value[t, k, 0] = rate * mean
                        if f >= 0 and settings.depth:
                            feature[t, k, node], cell[t, k, node] = f, b
                            value[t, k, 2 * node + 1], value[t, k, 2 * node + 2] = rate * left, rate * right
                            split = True
                if not split:
                    break
            if t + 1 < settings.trees:
                before, state = state, _advanced(state, feature[t], cell[t], value[t])
                if (t + 1) % CUT_EVERY == 0:
                    path = scratch_folder(spark, "boosting_margins")
                    state.saveAsPickleFile(path, 1)
                    before.unpersist()
                    before, state = None, spark.sparkContext.pickleFile(path)
                state = state.persist(kept)
    finally:
        for held in (before, state):
            if held is not None:
                held.unpersist()
    return BoostedTrees(tuple(settings.features), cuts, feature, cell, value)


def _advanced(state: RDD, feature: np.ndarray, cell: np.ndarray, value: np.ndarray) -> RDD:
    """The blocks with a round of trees added to their margins."""

    def add(block: tuple) -> tuple:
        keys, cells, marks, margins = block
        margins = margins.copy()
        add_tree(margins, cells, feature, cell, value)
        return keys, cells, marks, margins

    return state.map(add)
