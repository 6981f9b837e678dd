"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from snapgrid.llm.common import components, grouped
from snapgrid.session import stage_table

#: Vectors aimed at for each cell, cells of all labels together, and rows of a block.
CELL_ROWS, MAX_CELLS, BLOCK_ROWS = 512, 8_192, 2_048
#: Bounds of the sample that the cells are fitted on (numbers, rows); all rows are compared.
SAMPLE_VALUES, SAMPLE_ROWS = 2_000_000, 30_000


def valid(vector: str) -> Column:
    """Whether a vector is there, not zero, and all its components are finite numbers."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow."""
    rows = np.asarray(rows, dtype=np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centres of ``k`` cells at most: mean directions of the rows nearest by cosine."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), size=min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(rows[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(rows), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def fit_cells(distinct: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Centres for each (label, length), fitted on a bounded sample taken by a hash of the vector.

    A label that would have one cell has no centre and doesn't come to the driver, so
    fewer than MAX_CELLS do.
    """
    total, widest = distinct.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(1))).first()
    least = max(CELL_ROWS, total // MAX_CELLS)
    sizes = distinct.groupBy("label", "size").count().where(F.col("count") > least).collect()
    wanted = min(SAMPLE_ROWS, SAMPLE_VALUES // widest)
    share = min(1.0, wanted / max(total, 1))
    chance = F.pmod(F.xxhash64("embedding", F.lit(5)), F.lit(1_000_000))
    sample = distinct.where(chance < round(share * 1_000_000)).select("label", "size", "embedding").limit(2 * wanted).toArrow()
    centres = {}
    for r in sizes:
        k = min(round(r["count"] / CELL_ROWS), max(1, round(MAX_CELLS * r["count"] / total)))
        mine = pa.compute.and_(pa.compute.equal(sample["label"], r["label"]), pa.compute.equal(sample["size"], r["size"]))
        rows = sample.filter(mine)
        if k > 1 and rows.num_rows:
            centres[r["label"], r["size"]] = spherical_kmeans(unit(matrix(rows["embedding"])), min(k, max(1, rows.num_rows // 4)))
    return centres


def _cells(rows: np.ndarray, centres: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's own cell) for each cell that a row must be seen in.

    If a partner at most ``chord`` away lives in another cell, it is nearer to that
    centre, so the row is at most ``chord`` from the plane between the two centres.
    """
    near = rows @ centres.T
    own = near.argmax(axis=1)
    apart = np.linalg.norm(centres[own][:, None, :] - centres[None], axis=2) if len(rows) * centres.size < 2e7 else None
    if apart is None:
        apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[own]
    seen = near[np.arange(len(rows)), own][:, None] - near <= chord * apart + 1e-7
    seen[np.arange(len(rows)), own] = True
    r, c = np.nonzero(seen)
    return r, c, own[r] == c


def near_links(distinct: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, links, root): partial sums of linked vectors, and a smaller node linked through others.

    ``distinct`` has node, label, size, embedding, copies. Each vector lives in one cell
    and is also seen in every cell where a partner of it might live, so no pair is
    missed; its links are counted in its own cell. A cell of more than ``block_rows`` is
    cut in pieces, each two of which meet in a task of their own.
    """
    spark = distinct.sparkSession
    chord = float(np.sqrt(2 - 2 * threshold))
    centres = spark.sparkContext.broadcast(fit_cells(distinct))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "size")], axis=1)
            for one in np.unique(key, axis=0):
                mine = np.flatnonzero((key == one).all(axis=1))
                found = centres.value.get((int(one[0]), int(one[1])))
                for a in range(0, len(mine), 1024):
                    part = batch.take(pa.array(mine[a : a + 1024]))
                    if found is None:
                        r, c, own = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), np.ones(part.num_rows, bool)
                    else:
                        r, c, own = _cells(unit(matrix(part.column("embedding"))), found, chord)
                    out = part.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(c.astype(np.int32)), pa.array(own)], [*out.schema.names, "cell", "own"]
                    )

    slim = distinct.select("node", "label", "size", "embedding", "copies")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields)
    placed = stage_table(slim.mapInArrow(place, f"{kept}, cell int, own boolean"), "vector-cells")
    sizes = placed.groupBy("label", "size", "cell").count().where(F.col("count") > block_rows)
    # At most MAX_CELLS rows.
    crowded = F.broadcast(
        stage_table(
            sizes.select(
                F.col("label").alias("l"), F.col("size").alias("s"), F.col("cell").alias("c"),
                F.ceil(F.col("count") / block_rows).cast("int").alias("pieces"),
            ),
            "vector-crowded",
        )
    )
    dealt = placed.join(crowded, (F.col("label") == F.col("l")) & (F.col("size") == F.col("s")) & (F.col("cell") == F.col("c")), "left")
    pieces = F.coalesce("pieces", F.lit(1))
    other = F.sequence(F.lit(0), pieces - 1)
    mine = F.col("mine")
    tasks = F.concat(
        F.transform(
            F.filter(other, lambda j: F.col("own") & (j != mine)),
            lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(True).alias("row"), F.lit(False).alias("column")),
        ),
        F.transform(
            other,
            lambda i: F.struct(i.alias("i"), mine.alias("j"), ((i == mine) & F.col("own")).alias("row"), F.lit(True).alias("column")),
        ),
    )
    dealt = (
        dealt.withColumn("mine", F.pmod(F.xxhash64("node"), pieces).cast("int"))
        .withColumn("task", F.explode(tasks))
        .select("node", "label", "size", "embedding", "copies", "cell", "task.*")
    )

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        is_row, is_column = group["row"].to_numpy(), group["column"].to_numpy()
        if not is_row.any() or len(is_row) < 2:
            return None
        vectors, node, copies = unit(matrix(group["embedding"])), group["node"].to_numpy(), group["copies"].to_numpy()
        rows, columns = np.flatnonzero(is_row), np.flatnonzero(is_column)
        links, ends = np.zeros(len(node), dtype=np.int64), []
        for a in range(0, len(rows), 512):
            part = rows[a : a + 512]
            linked = vectors[part] @ vectors[columns].T >= threshold
            linked &= part[:, None] != columns
            links[part] = linked @ copies[columns]
            r, c = np.nonzero(linked)
            ends.append(np.stack([part[r], columns[c]]))
        r, c = np.concatenate(ends, axis=1)
        root, before = np.arange(len(node)), None
        order = np.argsort(node)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(node))
        root = rank.copy()
        while before is None or not np.array_equal(root, before):
            before = root.copy()
            low = np.minimum(root[r], root[c])
            np.minimum.at(root, r, low)
            np.minimum.at(root, c, low)
            root = root[order[root]]
        used = (links > 0) | (root != rank)
        made = [pa.array(node[used]), pa.array(links[used]), pa.array(node[order[root[used]]])]
        return pa.RecordBatch.from_arrays(made, ["node", "links", "root"])

    keys = ["label", "size", "cell", "i", "j"]
    return grouped(dealt, keys, ["node"], compare, "node long, links long, root long", least=2)


def _coded(rows: DataFrame) -> DataFrame:
    """``rows`` with the label as a whole number: itself, or its number in a table of the labels."""
    if isinstance(rows.schema["label"].dataType, IntegralType):
        return rows.withColumn("label", F.col("label").cast("long"))
    codes = rows.where("label IS NOT NULL").select(F.col("label").alias("l")).distinct().withColumn("code", F.monotonically_increasing_id())
    codes = stage_table(codes, "vector-labels")
    return rows.join(codes, F.col("label") == F.col("l"), "left").withColumn("label", F.col("code")).drop("l", "code")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id_column``, n_links, component_id and kept of every row.

    Vectors are linked if their labels and lengths are equal and their
    cosine is at least ``threshold``; a missing label, and a vector that is missing, empty,
    zero or not finite links with nothing. Equal vectors are compared once and count as
    often as they stand. component_id is the smallest id reachable, the row's own
    included; without any id in reach it is null. kept tells whether that is the row's id.
    """
    rows = vectors.select(
        F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).alias("embedding"),
        (valid(vector) & F.col(label).isNotNull()).alias("valid"),
    )
    rows = _coded(rows)
    good = rows.where("valid").select("id", "label", "embedding")
    distinct = (
        good.groupBy("label", "embedding")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
        .withColumn("size", F.size("embedding"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    distinct = stage_table(distinct, "vectors")
    found = stage_table(near_links(distinct, threshold, block_rows), "vector-links")
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    counts = found.groupBy(F.col("node").alias("n")).agg(F.sum("links").alias("links"))
    groups = (
        distinct.join(counts, F.col("node") == F.col("n"), "left")
        .drop("n")
        .join(linked.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
        .withColumn("root", F.coalesce("root", "node"))
        .select("node", "label", "embedding", "first_id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    groups = stage_table(groups, "vector-groups")
    named = groups.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id"))
    by_vector = groups.join(named, F.col("root") == F.col("r")).select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), "n_links", "component_id"
    )
    matched = good.join(by_vector, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")))
    alone = rows.where("NOT valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = matched.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(
        F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
