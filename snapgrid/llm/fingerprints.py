"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapgrid.llm.common import WORD

#: Hashes of a sketch, and words of a shingle.
HASHES, SHINGLE = 128, 5
#: Buckets of neighbouring ids: rows for each, and bounds of their number.
BUCKET_ROWS, COARSE, FINE = 256, 512, 128
#: An id, or an id with one text, is hot from this share of all rows (and BUCKET_ROWS rows).
HOT_SHARE = 1 / 256


def sketch(text: Column, k: int = HASHES, shingle: int = SHINGLE) -> Column:
    """The ``k`` smallest distinct shingle hashes of a text, ascending; a text below one shingle is one.

    An empty or null text has an empty sketch.
    """
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    # Let-binding by a one-element array, so that the words are hashed once.
    def shingles(h: Column) -> Column:
        whole = F.transform(
            F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)])
        )
        short = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
        return F.when(F.size(h) >= shingle, whole).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    found = F.flatten(F.transform(F.array(words), shingles))
    return F.slice(F.sort_array(F.array_distinct(found)), 1, k)


def merge(a: Column, b: Column, k: int = HASHES) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _shared(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    """How many hashes of the joint sketch are in both, and how many it has."""
    joint = merge(a, b, k)
    return F.size(F.array_intersect(joint, F.array_intersect(a, b))), F.size(joint)


def resemblance(a: Column, b: Column, k: int = HASHES) -> Column:
    """Estimated Jaccard likeness, 0 to 1; two empty sketches are alike."""
    both, all_ = _shared(a, b, k)
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def distinct_shingles(a: Column, k: int = HASHES) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    place = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(place, F.lit(1e-18)))


def containment(a: Column, b: Column, k: int = HASHES) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; an empty ``a`` is contained."""
    part = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(part, F.lit(1.0)))


def printed(a: Column) -> Column:
    """A sketch as text: sixteen hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _hot_ids(slim: DataFrame, total: int) -> list:
    """Ids of many rows (hid, rows) with the hashes of texts that many of these rows have (hs, ns): at most 256 of either."""
    least = max(BUCKET_ROWS, int(total * HOT_SHARE))
    ids = [(r.doc_id, r["count"]) for r in slim.groupBy("doc_id").count().where(F.col("count") > least).collect()]
    if not ids:
        return []
    wanted = slim.sparkSession.createDataFrame([(i,) for i, _ in ids], "hid long")
    rows = slim.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("hid"))).groupBy("doc_id", "h").count().where(F.col("count") > least)
    texts = sorted((r.h, r["count"], r.doc_id) for r in rows.collect())
    return [(i, n, [h for h, _, j in texts if i == j], [m for _, m, j in texts if i == j]) for i, n in ids]


_PLACE = ("bucket", "zone", "sub")


def _placed(slim: DataFrame, total: int) -> DataFrame:
    """``slim`` (doc_id, text, h) with its place: bucket descending, zone and sub ascending follow the order of the rows.

    Ids fall in buckets of neighbours: percentiles (at most COARSE of them), each cut
    evenly. A hot id has buckets of its own, by ranges of the hash; rows of one hot text in
    them are interchangeable and dealt out at random.
    """
    coarse = max(1, min(COARSE, total // BUCKET_ROWS))
    fine = max(1, min(FINE, total // (BUCKET_ROWS * COARSE)))
    size = max(BUCKET_ROWS, total // (COARSE * FINE))
    low, high = slim.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = []
    if low is not None and coarse > 1:
        shares = F.array(*[F.lit(k / coarse) for k in range(1, coarse)])
        cuts = slim.agg(F.percentile_approx("doc_id", shares, 20_000)).first()[0]
    hot = _hot_ids(slim, total)
    own = [i + d for i, *_ in hot if i is not None for d in (0, 1) if i + d <= (high or 0)]
    cuts = sorted({low or 0, *cuts, *own})
    pieces = [(i, -(-n // size), hs, [-(-m // size) for m in ms]) for i, n, hs, ms in hot]
    span = max([fine, *[p for _, p, *_ in pieces]])
    known = slim.sparkSession.createDataFrame(pieces, "hid long, pieces long, hs array<long>, ms array<long>")
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    nth = F.size(F.filter(edges, lambda c: c <= F.col("doc_id")))
    # The end may lie beyond the largest long, and so may a difference.
    wide = "decimal(20,0)"
    start, end = F.get(edges, F.col("nth") - 1).cast(wide), F.coalesce(F.get(edges, F.col("nth")).cast(wide), F.lit(str((high or 0) + 1)).cast(wide))
    part = F.floor((F.col("doc_id").cast(wide) - start).cast("double") / F.greatest(end - start, F.lit(1).cast(wide)).cast("double") * fine)
    # The smallest hashes of an id come first, so they have the highest bucket of it.
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    piece = F.col("pieces") - 1 - F.least(F.floor(share * F.col("pieces")), F.col("pieces") - 1)
    inside = F.coalesce(piece, F.least(part, F.lit(fine - 1)))
    bucket = F.when(F.col("doc_id").isNull(), F.coalesce(piece - F.col("pieces"), F.lit(-1))).otherwise(F.col("nth") * span + inside)
    nth_text = F.array_position("hs", F.col("h"))
    zone = F.coalesce(2 * F.size(F.filter("hs", lambda x: x < F.col("h"))) + (nth_text > 0).cast("int"), F.lit(0))
    sub = F.when(nth_text > 0, F.floor(F.rand(5) * F.get("ms", (nth_text - 1).cast("int"))))
    return (
        slim.join(F.broadcast(known), F.col("doc_id").eqNullSafe(F.col("hid")), "left")
        .withColumn("nth", nth)
        .withColumns({"bucket": bucket.cast("long"), "zone": zone.cast("int"), "sub": F.coalesce(sub, F.lit(0)).cast("int")})
        .select("doc_id", "text", "h", *_PLACE)
    )


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, next_text and next_sketch, next by descending id; after the last comes the first.

    Missing ids come last; rows with equal ids follow one another by a hash of the text,
    equal rows in any order. A null text is empty; an empty table gives an empty one;
    other columns play no part. A window sees the rows of one place; the first row of the
    place that follows is added to it, and leaves again afterwards. At most some
    COARSE * FINE first rows (id and hash) pass the driver.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    placed = _placed(slim, docs.count())
    first = F.max(F.struct("doc_id", (-F.col("h").cast("decimal(20,0)")).alias("o"), "h")).alias("first")
    firsts = placed.groupBy(*_PLACE).agg(first).orderBy(F.col("bucket").desc(), "zone", "sub").collect()
    follow = [
        (r.bucket, r.zone, r.sub, n.first.doc_id, n.first.h) for r, n in zip(firsts, firsts[1:] + firsts[:1], strict=True)
    ]
    follow = spark.createDataFrame(follow, "bucket long, zone int, sub int, next_id long, next_h long")
    added = slim.join(
        F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("next_id")) & (F.col("h") == F.col("next_h"))
    ).select("doc_id", "text", "h", *_PLACE, F.lit(True).alias("added"))
    # Of equal rows one is enough; combined on the map side.
    added = added.dropDuplicates([*_PLACE])
    rows = placed.withColumn("added", F.lit(False)).unionByName(added).withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy(*_PLACE).orderBy("added", F.col("doc_id").desc_nulls_last(), "h")
    return (
        rows.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
        .where(~F.col("added"))
        .select("doc_id", "text", "sketch", "next_text", "next_sketch")
    )


def edited(text: str, next_text: str) -> Column:
    """``text``, its last half (rounded down) replaced by as many first code points of ``next_text``, or all."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(F.col(text), n - half), F.left(F.col(next_text), half))
