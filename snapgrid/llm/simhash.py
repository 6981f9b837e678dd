"""Near-duplicates by SimHash: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.llm.common import components, fresh, grouped, row_key, slices
from snapgrid.session import stage_table

BITS = 64
#: Shingles whose bits are counted at once.
SHINGLES_AT_ONCE = 50_000
#: Fingerprints of one block that one call compares; larger blocks are cut in pieces.
BLOCK_ROWS = 4_096


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    counts, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = zip(starts[at : at + SHINGLES_AT_ONCE], ends[at : at + SHINGLES_AT_ONCE], strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in part], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    majority = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(majority.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """Columns ``keep`` and ``fingerprint`` (long) of every row; a null text is empty."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            made = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], [*keep, "fingerprint"])

    slim = docs.select(F.col(text).alias("text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    return slim.mapInArrow(add, f"{schema}, fingerprint long")


def block_masks(n: int, distance: int) -> list[int]:
    """Bit masks such that fingerprints at most ``distance`` apart agree under one at least.

    With b blocks, ``distance`` differing bits leave b - distance blocks untouched. b
    grows with the number of fingerprints, so that the bits under a mask always suffice
    to tell that many random fingerprints apart.
    """
    need = math.log2(max(n, 2)) + 6
    blocks = distance + 1
    while blocks < 16 and BITS * (blocks - distance) // blocks < need:
        blocks += 1
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(distinct: DataFrame, n: int, distance: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) that join exactly the fingerprints linked, directly or through others.

    Within a block all fingerprints are compared, and what is found linked is handed on
    as a star, so a block of m fingerprints gives less than m edges. A block of more
    than ``block_rows`` is cut in pieces; every two pieces meet in a task of their own.
    """
    masks = [_signed(m) for m in block_masks(n, distance)]
    rows = distinct.select(
        F.col("fingerprint").alias("fp"),
        F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("mask", "key"),
    )
    # Blocks with one fingerprint link nothing; the aggregate is combined on the map side.
    sizes = rows.groupBy("mask", "key").count()
    crowded = stage_table(
        sizes.where(F.col("count") > block_rows).select(
            F.col("mask").alias("m"), F.col("key").alias("k"), F.ceil(F.col("count") / block_rows).cast("int").alias("pieces")
        ),
        "simhash-crowded",
    )
    whole = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if not crowded.isEmpty():
        same = (F.col("mask") == F.col("m")) & (F.col("key") == F.col("k"))
        mine = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
        pairs = (
            rows.join(crowded, same)
            .withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
            .select("fp", "mask", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        )
        whole = whole.join(crowded, same, "left_anti").unionByName(pairs)

    def stars(group: pa.Table) -> pa.RecordBatch | None:
        left = group.column("fp").to_numpy()
        found = []
        while len(left) > 1:
            root, ring, left = left[0], left[:1], left[1:]
            while len(ring) and len(left):
                near = np.zeros(len(left), dtype=bool)
                for at in range(0, len(ring), 64):
                    near |= (np.bitwise_count((ring[at : at + 64, None] ^ left).view(np.uint64)) <= distance).any(axis=0)
                ring, left = left[near], left[~near]
                found.append(np.stack([np.full(len(ring), root), ring]))
        if not found:
            return None
        a, b = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return grouped(whole, ["mask", "key", "i", "j"], ["fp"], stars, "a long, b long", least=2)


def near_duplicates(
    docs: DataFrame,
    distance: int = 3,
    shingle: int = 3,
    id_column: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id_column``, ``keep``, fingerprint (long), component (long), component_id of every row.

    Equal fingerprints are compared once. ``component_id`` is the smallest id reachable
    over links; ``component`` names the group by its smallest fingerprint, also where no
    row of the group has an id (then component_id is null). Null and wordless texts
    share the fingerprint zero. Repeated rows and ids each keep their row. An empty table
    gives an empty one; other columns of ``docs`` play no part.
    """
    rows = stage_table(fingerprints(docs, text, (id_column, *keep), shingle), "simhash-rows")
    distinct = stage_table(
        rows.groupBy("fingerprint").agg(F.min(id_column).alias("first_id")), "simhash-distinct"
    )
    linked = components(links(distinct, distinct.count(), distance, block_rows), "simhash")
    groups = distinct.join(linked, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("component")
    )
    groups = stage_table(groups, "simhash-groups")
    named = groups.groupBy(F.col("component").alias("c")).agg(F.min("first_id").alias("component_id"))
    # What is joined to all rows is one row per fingerprint.
    by_fingerprint = stage_table(
        groups.join(named, F.col("component") == F.col("c")).select(
            F.col("fingerprint").alias("f"), "component", "component_id"
        ),
        "simhash-named",
    )
    return rows.join(by_fingerprint, F.col("fingerprint") == F.col("f")).drop("f")


def digits(fingerprint: str) -> Column:
    """Sixteen lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def drop_near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each group: the smallest id, then the smallest row hash.

    All columns stay. A group whose rows all lack an id keeps one of them.
    """
    row, kept_id, kept_row = (fresh(docs, c) for c in ("row_hash", "kept_id", "kept_row"))
    keyed = docs.withColumn(row, row_key(docs))
    rows = near_duplicates(keyed, distance, shingle, keep=(row,))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)).alias("kept")
    kept = stage_table(
        rows.groupBy("component").agg(first).select(F.col("kept.doc_id").alias(kept_id), F.col(f"kept.{row}").alias(kept_row)),
        "simhash-kept",
    )
    wanted = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(row) == F.col(kept_row))
    return keyed.join(kept, wanted, "left_semi").dropDuplicates(["doc_id", row]).drop(row)
