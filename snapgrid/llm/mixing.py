"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgrid.llm.common import WORD, fresh, n_words, row_key, running, slices
from snapgrid.session import stage_table

#: Words of a block, less where the table is so small that fewer than LEAST_SLOTS would be dealt.
BLOCK_WORDS, LEAST_SLOTS = 4_096, 20_000
#: Source totals are the only thing that comes to the driver.
MAX_SOURCES = 100_000
#: Words of a partition of the mixed documents.
PART_WORDS = 4_000_000
_BITS = 40


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, at_most: float) -> list[float]:
    """Words to take from each source: ``share`` of all words by weight, none above ``at_most`` times its size.

    What a full source leaves goes to the others by weight, until none is above.
    """
    found, free = [0.0] * len(sizes), list(range(len(sizes)))
    budget = share * sum(sizes)
    while free:
        unit = budget / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > at_most * sizes[i]]
        for i in over or free:
            found[i] = at_most * sizes[i] if over else unit * weights[i]
        budget -= sum(found[i] for i in over)
        free = [i for i in free if i not in set(over)] if over else []
    return found


def schedule(spark, needed: Sequence[int]) -> DataFrame:
    """(slot, source_ix, rank): which source each slot serves, and its how-manieth slot that is.

    Slot t is the t-th van der Corput point (the bits of t reversed) looked up in the
    cumulative shares, so every stretch of slots mirrors the shares. A source gets exactly
    ``needed`` slots: further ones are void, missing ones follow at the end.
    """
    total = sum(needed)
    edges = np.cumsum(np.asarray(needed, dtype=np.float64)) / max(total, 1)
    last = max((i for i, n in enumerate(needed) if n), default=0)

    @F.pandas_udf("int")
    def served(point: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(edges, point.to_numpy(), side="right"), last).astype(np.int32))

    bits = F.reverse(F.lpad(F.bin("id"), _BITS, "0"))
    points = spark.range(total).select(
        F.col("id").alias("slot"), served(F.conv(bits, 2, 10).cast("double") / float(1 << _BITS)).alias("source_ix")
    )
    parts = max(1, min(65_536, total // 50_000))
    ranked = running(points, "source_ix", ["slot"], F.lit(1), F.floor(F.col("slot") * parts / max(total, 1)), "rank")
    ranked = stage_table(ranked.select("slot", "source_ix", "rank"), "mix-slots")
    got = {r.source_ix: r.n for r in ranked.groupBy("source_ix").agg(F.count("*").alias("n")).collect()}
    short = [(i, got.get(i, 0), n) for i, n in enumerate(needed) if got.get(i, 0) < n]
    limits = spark.createDataFrame(
        [(i, int(n)) for i, n in enumerate(needed)], "ix int, needed long"
    )
    kept = ranked.join(F.broadcast(limits), F.col("source_ix") == F.col("ix")).where("rank < needed").select("slot", "source_ix", "rank")
    tail = spark.createDataFrame(short, "source_ix int, got long, needed long").select(
        (F.lit(total) + F.col("source_ix")).alias("slot"), "source_ix", F.explode(F.sequence("got", F.col("needed") - 1)).alias("rank")
    )
    return kept.union(tail)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    at_most: int = 2,
    keep: tuple[str, ...] = ("doc_id",),
    source: str = "source",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Rows and pieces of the mix.

    Rows, one for each of ``docs``: ``keep``, source, size (words), source_ix, start (in
    its source's shuffled stream), source_size, target. Pieces: source_ix, start, slot,
    epoch, from_word, words: what a slot takes of the document at ``start``.

    Sources are ordered by code point, null last, and take ``weights`` in turn. A
    source's documents follow one another in the order of a hash; blocks of equally many
    words are cut from that stream and dealt to the source's slots by rank. The stream
    begins again when it is used up. Documents without words give no piece. Equal rows
    each have their place. An empty table gives empty results.
    """
    spark = docs.sparkSession
    slim = docs.select(
        *keep,
        F.col(source).alias("source"),
        n_words(text).alias("size"),
        F.xxhash64(*[F.col(c) for c in keep], F.col(text)).alias("h"),
    )
    slim = stage_table(slim, "mix-sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, str(r.source)))
    sizes = [int(r.n) for r in totals]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, at_most)
    taken = [min(int(w), at_most * n) for w, n in zip(wanted, sizes, strict=True)]
    block = max(1, min(BLOCK_WORDS, sum(taken) // LEAST_SLOTS))
    known = spark.createDataFrame(
        [(r.source, i, n, float(w), t) for i, (r, n, w, t) in enumerate(zip(totals, sizes, wanted, taken, strict=True))],
        T.StructType(
            [
                T.StructField("s", slim.schema["source"].dataType),
                T.StructField("source_ix", T.IntegerType()),
                T.StructField("source_size", T.LongType()),
                T.StructField("target", T.DoubleType()),
                T.StructField("to_take", T.LongType()),
            ]
        ),
    )
    # One row a source, counted above: small enough to broadcast.
    rows = slim.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    buckets = max(1, min(65_536, sum(r.rows for r in totals) // 2_000))
    bucket = F.shiftrightunsigned(F.shiftrightunsigned("h", 48) * buckets, 16)
    rows = running(rows, "source_ix", ["h"], F.col("size"), bucket, "start").drop("h")
    rows = stage_table(rows, "mix-rows")
    # A place in the endless stream for each pass, cut where the source has given its share.
    at = F.col("start") + F.col("epoch") * F.col("source_size")
    passes = (
        rows.where("size > 0 AND start < to_take")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("to_take") - F.col("start") - 1) / F.col("source_size")))))
        .select("source_ix", "start", "epoch", at.alias("a"), F.least(at + F.col("size"), "to_take").alias("b"))
    )
    parts = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    slots = schedule(spark, [math.ceil(t / block) for t in taken])
    low, high = F.greatest("a", F.col("rank") * block), F.least("b", (F.col("rank") + 1) * block)
    pieces = parts.join(slots, ["source_ix", "rank"]).select(
        "source_ix", "start", "slot", "epoch", (low - F.col("a")).alias("from_word"), (high - low).alias("words")
    )
    return rows.drop("to_take"), pieces


def taken_words(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``rows`` with ``taken``: the words the mix takes of each, repeats counted, and the first and last slot that they stand in."""
    sums = pieces.groupBy(F.col("source_ix").alias("i"), F.col("start").alias("b")).agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )
    full = rows.where("size > 0").join(sums, (F.col("source_ix") == F.col("i")) & (F.col("start") == F.col("b")), "left")
    full = full.drop("i", "b").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return full.unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")), allowMissingColumns=True)


_WORD = re.compile(WORD)


def _first_words(text: str, n: int) -> str:
    """``text`` up to the end of its n-th word."""
    for k, m in enumerate(_WORD.finditer(text), 1):
        if k == n:
            return text[: m.end()]
    return text


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents in the order of its schedule: a row for each pass over a document.

    Rows are dealt to partitions by ranges of the slot at which a pass begins, and sorted
    by it, so every stretch of the written table mirrors the shares. A pass that the share
    ends within is cut there. All columns stay, whatever their names (``n_chars``, if there,
    is counted anew); an id taken twice stands twice. Documents of which nothing is taken,
    and those without words, are not in it. Equal rows are read once and each take their
    own amounts. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    row, check = fresh(docs, "row_hash"), fresh(docs, "row_check")
    keyed = docs.withColumns({row: row_key(docs), check: F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in docs.columns])})
    rows, pieces = mix(keyed, keep=(row, check))
    passes = pieces.groupBy("source_ix", "start", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    # Of each pass only what names its row: texts meet it once.
    slim = rows.where("size > 0").select(row, check, "source_ix", "start", "size").join(passes, ["source_ix", "start"])
    own = {c: fresh(docs, f"mix_{c}") for c in ("row", "check", "cut", "slot", "epoch", "start", "part")}
    cut = F.when(F.col("words") < F.col("size"), F.col("words"))
    slim = slim.select(
        F.col(row).alias(own["row"]), F.col(check).alias(own["check"]), cut.alias(own["cut"]), F.col("words").alias("n"),
        *[F.col(c).alias(own[c]) for c in ("slot", "epoch", "start")],
    )
    slim = stage_table(slim, "mix-passes")
    total, last = slim.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max(own["slot"])).first()
    parts = max(1, min(65_536, max(spark.sparkContext.defaultParallelism, total // PART_WORDS)))
    part = F.floor(F.col(own["slot"]) * parts / F.lit((last or 0) + 1)).cast("int")
    whole = keyed.dropDuplicates([row, check])
    same = (F.col(own["row"]) == F.col(row)) & (F.col(own["check"]) == F.col(check))
    joined = slim.drop("n").join(whole, same).drop(row, check).withColumn(own["part"], part)
    dealt = joined.repartitionById(parts, own["part"]).sortWithinPartitions(*[own[c] for c in ("slot", "epoch", "start")])
    return _cut(docs, dealt.select(*[F.col(f"`{c}`") for c in docs.columns], own["cut"]))


def _cut(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """``joined`` without its last column, the number of words at which the text is cut (null: nowhere)."""
    names, types, text = docs.columns, docs.schema, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[text]):
            cuts = zip(batch.column(text).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)
            made = pa.array([t if n is None else _first_words(t, n) for t, n in cuts], batch.schema.field(text).type)
            columns = [*batch.columns[:text], made, *batch.columns[text + 1 : len(names)]]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.mapInArrow(cut, types)
    return out.withColumn("n_chars", F.char_length("text").cast(types["n_chars"].dataType)) if "n_chars" in names else out
