"""Exact all-against-all reductions without an all-against-all row set.

A small right side is broadcast to the left one. Otherwise both are cut into blocks of
bounded size by a hash of their key, and each pair of blocks meets in one task. Either
way numpy reduces what meets to a few rows per left row, so pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of a task at least, and rows and values of a block at most: a value is a word or
# a vector component of about 16 bytes.
SMALL_BLOCK = 64
BLOCK_ROWS = 16_384
BLOCK_VALUES = 4_000_000
# Values of a right side that is broadcast (about 32 MB).
BROADCAST_VALUES = 2_000_000
_LEFT, _RIGHT, _PAIR = "_left_block", "_right_block", "_pair"


def reduce_blocks(
    left: DataFrame,
    right: DataFrame,
    left_key: list[str],
    right_key: list[str],
    reduce: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    values: Column,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``reduce`` on parts of both sides such that all rows meet; keys are unique on their side.

    ``values`` says how many values a row of either side holds; both sides are measured
    by it first, so they should be stage tables. With blocks each left row is sent to all
    right blocks and the other way round, and a pair of blocks has a partition to itself.
    """
    (n_left, left_values), (n_right, right_values) = (
        side.agg(F.count("*"), F.coalesce(F.sum(values), F.lit(0))).first() for side in (left, right)
    )
    if n_right <= block_rows and right_values <= BROADCAST_VALUES:
        return _with_broadcast(left, right, left_key, reduce, schema, n_left)
    left_blocks, right_blocks = (
        max(1, ceil(n / block_rows), ceil(held / BLOCK_VALUES))
        for n, held in ((n_left, left_values), (n_right, right_values))
    )
    left_side = left.withColumn(
        _LEFT, F.pmod(F.xxhash64(*left_key), F.lit(left_blocks)).cast("int")
    ).withColumn(_RIGHT, F.explode(F.sequence(F.lit(0), F.lit(right_blocks - 1))))
    right_side = right.withColumn(
        _RIGHT, F.pmod(F.xxhash64(*right_key), F.lit(right_blocks)).cast("int")
    ).withColumn(_LEFT, F.explode(F.sequence(F.lit(0), F.lit(left_blocks - 1))))
    # A pair of blocks is small in bytes and large in work: a fixed number of
    # partitions keeps adaptive execution from merging them by size.
    tasks = left_blocks * right_blocks
    pair = F.col(_LEFT) * right_blocks + F.col(_RIGHT)
    sides = [
        side.withColumn(_PAIR, pair.cast("int")).drop(_LEFT, _RIGHT).repartitionById(tasks, _PAIR).groupBy(_PAIR)
        for side in (left_side, right_side)
    ]
    return sides[0].cogroup(sides[1]).applyInPandas(reduce, schema)


def _with_broadcast(
    left: DataFrame, right: DataFrame, left_key: list[str], reduce: Callable, schema: str, n_left: int
) -> DataFrame:
    """Every part of the left side with the whole right side, which is small."""
    context = left.sparkSession.sparkContext
    shared = context.broadcast(right.toArrow().to_pandas())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield reduce(batch, shared.value)

    parts = max(1, min(2 * context.defaultParallelism, ceil(n_left / SMALL_BLOCK)))
    # A file of a few megabytes would be one task, whatever the work on its rows.
    return left.repartition(parts, *left_key).mapInPandas(run, schema)
