"""Helpers shared by the operators: columns, grouped Arrow maps, running totals, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapgrid.session import stage_table

#: ASCII white space; every other code point belongs to a word.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text that one call of a text function holds at once.
SLICE_BYTES = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def n_words(text: str) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def row_key(df: DataFrame) -> Column:
    """A hash of a whole row, for joining decisions back to rows with repeated ids."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % divisor


def one_text(df: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and text, one row for each key: the text with the least hash. Combined on the map side."""
    return df.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], text: str, at_most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``at_most`` bytes of text, or one row."""
    for batch in batches:
        if batch.nbytes <= at_most:
            yield batch
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // at_most
        starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b > a:
                yield batch.slice(int(a), int(b - a))


def grouped(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fn: Callable[[pa.Table], pa.RecordBatch | None],
    schema: str,
    least: int = 1,
) -> DataFrame:
    """Apply ``fn`` to each group of at least ``least`` rows; groups must be of bounded size.

    Groups are cut out of sorted partitions, so that millions of tiny groups cost no
    call each; a group may span Arrow batches.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            edges = bounds(table)
            yield from done(table, edges[:-1])
            rest = table.slice(int(edges[-2]))
        if rest is not None:
            yield from done(rest, np.array([0, rest.num_rows]))

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for key in keys:
            column = table.column(key).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    def done(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in np.flatnonzero(np.diff(edges) >= least):
            out = fn(table.slice(int(edges[k]), int(edges[k + 1] - edges[k])))
            if out is not None and out.num_rows:
                yield out

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(cut, schema)


def running(df: DataFrame, group: str, order: list[str], value: Column, bucket: Column, into: str) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows before this one in its group.

    Rows are ordered by ``bucket``, then by ``order``. A window sees one bucket of one
    group at a time; a small table of bucket totals gives where each bucket starts, so a
    group with most of all rows is still dealt out over many tasks.
    """
    amount, part, start = (fresh(df, c) for c in ("amount", "part", "part_start"))
    rows = df.withColumn(part, bucket.cast("long")).withColumn(amount, value.cast("long"))
    before = Window.partitionBy("g", "p").orderBy(*order, amount).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(F.col(group).alias("g"), F.col(part).alias("p"))
        .agg(F.sum(amount).alias("t"))
        .withColumn(
            start,
            F.coalesce(
                F.sum("t").over(Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select(F.col("g").alias("_g"), F.col("p").alias("_p"), start)
    )
    inside = rows.withColumns({"g": F.col(group), "p": F.col(part)}).withColumn(
        into, F.coalesce(F.sum(amount).over(before), F.lit(0))
    )
    return (
        inside.join(totals, F.col("g").eqNullSafe(F.col("_g")) & (F.col("p") == F.col("_p")))
        .withColumn(into, F.col(into) + F.col(start))
        .drop("g", "p", "_g", "_p", part, amount, start)
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, root), root the smallest node.

    Alternates two steps until nothing changes: every node hangs its larger neighbours
    on its smallest neighbour, then its smaller ones. Each step is an aggregate
    (combined on the map side) and a join that can be split at a hot node; each round is
    written to the shared folder. Nodes without an edge are not in the result.
    """
    edges = stage_table(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-edges",
    )
    mark = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("n"))
        small = small.select(F.col("a"), F.col("m").alias("b")).union(
            small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        edges = stage_table(small.distinct(), f"{name}-round")
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = seen
