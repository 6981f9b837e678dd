"""A stored inverted index in order of impact: exact top-k that skips most of it.

Under its folder:

    words      term, term_id, in_docs, best (largest impact of the word), first (its first block)
    postings   term_id, place, top, ids, impacts: a block of documents by descending impact
    vectors    a document's terms and impacts, to score the few documents that are left
    corpus     number of documents

The impact of a word in a document is its TF-IDF weight over the norm of the document, so
a score is the sum of query weight times impact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapgrid.operators.similarity import SCORE_DIGITS
from snapgrid.operators.vectors import term_counts, term_frequencies, tf_idf_vectors
from snapgrid.session import stage_table

# Documents of a block.
BLOCK_POSTINGS = 256
# Words of a query whose first blocks are looked at for a first threshold, and documents scored for it.
PROBED_WORDS, PROBED_DOCS = 8, 16
# Scores this far below the threshold can't round to it.
_SLACK = 2 * 10.0**-SCORE_DIGITS
_ROWS = 2_048


@dataclass(frozen=True)
class TextIndex:
    words: DataFrame
    postings: DataFrame
    vectors: DataFrame
    size: int
    doc_id: str


def build_index(corpus: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK_POSTINGS) -> TextIndex:
    """Index a corpus under ``path``; ids are unique. The index stays until it is written anew.

    Postings are dealt by ranges of (word, impact), so a word that most documents have lies
    in many tasks, each of which cuts its own blocks.
    """
    spark = corpus.sparkSession
    counts = stage_table(term_counts(corpus, doc_id, text), "index-terms")
    frequencies = stage_table(term_frequencies(counts, counts), "index-words")
    size = counts.count()
    made = tf_idf_vectors(counts, frequencies, size, doc_id)
    heavy = F.filter(F.arrays_zip("terms", "weights"), lambda x: x["weights"] > 0)
    vectors = made.select(
        doc_id, F.transform(heavy, lambda x: x["terms"]).alias("terms"),
        F.transform(heavy, lambda x: x["weights"] / F.col("norm")).alias("impacts"),
    )
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors = spark.read.parquet(f"{path}/vectors")
    listed = vectors.select(F.explode(F.arrays_zip("terms", "impacts")).alias("x"), F.col(doc_id).alias("id"))
    order = [F.col("term_id"), F.col("impact").desc(), F.col("id")]
    listed = listed.select(F.col("x.terms").alias("term_id"), F.col("x.impacts").alias("impact"), "id")
    id_type = corpus.schema[doc_id].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            term = batch.column(0).to_numpy()
            new = np.append(True, term[1:] != term[:-1])
            begun = np.flatnonzero(new)[np.cumsum(new) - 1]
            starts = np.flatnonzero((np.arange(len(term)) - begun) % block == 0)
            offsets = pa.array(np.append(starts, len(term)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(starts)), pa.array(place + np.arange(len(starts))), batch.column(1).take(pa.array(starts)),
                    pa.ListArray.from_arrays(offsets, batch.column(2)), pa.ListArray.from_arrays(offsets, batch.column(1)),
                ],
                ["term_id", "place", "top", "ids", "impacts"],
            )
            place += len(starts)

    dealt = listed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"term_id long, place long, top double, ids array<{id_type.simpleString()}>, impacts array<double>"
    dealt.mapInArrow(cut, schema).write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    best = postings.groupBy(F.col("term_id").alias("t")).agg(F.max("top").alias("best"), F.min("place").alias("first"))
    frequencies.join(best, F.col("term_id") == F.col("t")).select("term", "term_id", "in_docs", "best", "first").write.mode(
        "overwrite"
    ).parquet(f"{path}/words")
    spark.createDataFrame([(size, doc_id)], "size long, doc_id string").coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    size, doc_id = spark.read.parquet(f"{path}/corpus").first()
    return TextIndex(*[spark.read.parquet(f"{path}/{part}") for part in ("words", "postings", "vectors")], size, doc_id)


def _scored(pairs: DataFrame, queries: DataFrame, index: TextIndex) -> DataFrame:
    """query, id, sim of the given pairs: each meets the two vectors, and numpy adds up a batch of them."""
    both = pairs.join(queries.select("query", F.col("terms").alias("a"), F.col("weights").alias("x")), "query").join(
        index.vectors.select(F.col(index.doc_id).alias("id"), F.col("terms").alias("b"), F.col("impacts").alias("y")), "id"
    )

    def spread(column: pa.Array) -> np.ndarray:
        return np.repeat(np.arange(len(column)), pa.compute.list_value_length(column).to_numpy())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                a, b = batch.column(2), batch.column(4)
                row, terms = spread(a), a.flatten().to_numpy()
                code = np.unique(np.concatenate([terms, b.flatten().to_numpy()]), return_inverse=True)[1]
                keys = spread(b) * (len(code) + 1) + code[len(terms) :]
                order = np.argsort(keys, kind="stable")
                keys, impact = np.append(keys[order], -1), np.append(batch.column(5).flatten().to_numpy()[order], 0.0)
                wanted = row * (len(code) + 1) + code[: len(terms)]
                found = np.searchsorted(keys[:-1], wanted)
                part = np.where(keys[found] == wanted, impact[found], 0.0) * batch.column(3).flatten().to_numpy()
                sims = np.round(np.bincount(row, part, batch.num_rows), SCORE_DIGITS) + 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], ["query", "id", "sim"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    return both.select("query", "id", "a", "x", "b", "y").mapInArrow(add, f"query {kinds['query']}, id {kinds['id']}, sim double")


def _entries(blocks: DataFrame, least: Column) -> DataFrame:
    """query, id, part of the documents of a block whose part of the score is ``least`` or more."""
    listed = blocks.select("query", "weight", least.alias("least"), F.explode(F.arrays_zip("ids", "impacts")).alias("e"))
    part = F.col("weight") * F.col("e.impacts")
    return listed.where(part >= F.col("least")).select("query", F.col("e.ids").alias("id"), part.alias("part"))


def query_vectors(index: TextIndex, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """query, terms, weights (over the norm of all words) of each query."""
    counts = stage_table(term_counts(queries, query_id, text), "index-queries")
    known = index.words.select("term", "term_id", "in_docs", F.lit(True).alias("asked"))
    made = tf_idf_vectors(counts, known, index.size, query_id)
    heavy = F.filter(F.arrays_zip("terms", "weights"), lambda x: x["weights"] > 0)
    return made.select(
        F.col(query_id).alias("query"), F.transform(heavy, lambda x: x["terms"]).alias("terms"),
        F.transform(heavy, lambda x: x["weights"] / F.col("norm")).alias("weights"),
    )


def thresholds(index: TextIndex, vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words of the queries with the least part (``least``) that a document must reach in one of them, scored probes, cuts.

    The first blocks of a query's strongest words give documents that are scored in full;
    the k-th best of them is a score to beat. If a document stays under ``least`` in every
    word, its score is at most the sum of the smaller of ``least`` and the word's bound,
    which ``least`` is chosen to keep under that score.
    """
    listed = vectors.select("query", F.explode(F.arrays_zip("terms", "weights")).alias("x"))
    listed = listed.select("query", F.col("x.terms").alias("t"), F.col("x.weights").alias("weight"))
    bound = F.col("weight") * F.col("best")
    asked = listed.join(index.words.select("term_id", "best", "first"), F.col("t") == F.col("term_id")).withColumn("bound", bound)
    asked = stage_table(asked.drop("t"), "index-asked")
    strongest = Window.partitionBy("query").orderBy(F.col("bound").desc(), "term_id")
    probed = asked.withColumn("nth", F.row_number().over(strongest)).where(F.col("nth") <= PROBED_WORDS)
    first = index.postings.join(
        probed.select("query", "weight", F.col("term_id").alias("t"), "first"), (F.col("term_id") == F.col("t")) & (F.col("place") == F.col("first"))
    )
    sums = _entries(first, F.lit(0.0)).groupBy("query", "id").agg(F.sum("part").alias("part"))
    strongest = Window.partitionBy("query").orderBy(F.col("part").desc(), "id")
    probes = sums.withColumn("nth", F.row_number().over(strongest)).where(F.col("nth") <= max(PROBED_DOCS, 4 * k)).select("query", "id")
    probes = stage_table(_scored(probes, vectors, index), "index-probes")
    best = Window.partitionBy("query").orderBy(F.col("sim").desc(), "id")
    kth = probes.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select(F.col("query").alias("q"), F.col("sim").alias("beat"))
    rising = Window.partitionBy("query").orderBy("bound", "term_id")
    ranked = asked.join(kth, F.col("query") == F.col("q"), "left").drop("q").withColumns(
        {
            "before": F.coalesce(F.sum("bound").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "left": F.count("*").over(Window.partitionBy("query")) - F.row_number().over(rising) + 1,
        }
    )
    share = (F.coalesce("beat", F.lit(0.0)) - _SLACK - F.col("before")) / F.col("left")
    cuts = ranked.groupBy("query").agg(F.greatest(F.max(share), F.lit(0.0)).alias("least"), F.max("beat").alias("beat"))
    cuts = stage_table(cuts, "index-cuts")
    return asked.join(cuts, "query").where(F.col("bound") >= F.col("least")), probes, cuts


def _blocks_to_read(index: TextIndex, asked: DataFrame) -> DataFrame:
    wanted = asked.select("query", "weight", "least", F.col("term_id").alias("t"))
    return index.postings.join(wanted, F.col("term_id") == F.col("t")).where(F.col("weight") * F.col("top") >= F.col("least"))


def search(index: TextIndex, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """``query_id, doc_id, sim, rank``: the k best documents for each query text, exactly.

    The same rows as ``recommend.rank_documents``: a document without a shared word has
    similarity 0, and the smaller id wins a tie.
    """
    vectors = stage_table(query_vectors(index, queries, query_id, text), "index-vectors")
    asked, probes, _ = thresholds(index, vectors, k)
    found = _entries(_blocks_to_read(index, asked), F.col("least")).select("query", "id").distinct()
    rest = _scored(found.join(probes.select("query", "id"), ["query", "id"], "left_anti"), vectors, index)
    hits = probes.unionByName(rest).where("sim > 0")
    order = Window.partitionBy("query").orderBy(F.col("sim").desc(), "id")
    best = stage_table(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "index-best")
    # Where fewer than k documents share a word, the smallest ids come next; k of the first 2 k are free.
    short = vectors.select("query").join(best.where(F.col("rank") == k).select("query"), "query", "left_anti")
    smallest = index.vectors.select(F.col(index.doc_id).alias("id")).orderBy("id").limit(2 * k).collect()
    ids = F.array(*[F.lit(r.id) for r in smallest]) if smallest else F.array().cast("array<long>")
    free = short.select("query", F.explode(ids).alias("id")).join(best.select("query", "id"), ["query", "id"], "left_anti")
    filled = best.select("query", "id", "sim").unionByName(free.select("query", "id", F.lit(0.0).alias("sim")))
    ranked = filled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), F.col("id").alias(index.doc_id), "sim", "rank")


def effort(index: TextIndex, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """``query_id``, the score to beat, blocks read and blocks that the query's words have."""
    vectors = stage_table(query_vectors(index, queries, query_id, text), "index-vectors")
    asked, _, cuts = thresholds(index, vectors, k)
    words = vectors.select("query", F.explode("terms").alias("t"))
    held = index.postings.groupBy(F.col("term_id").alias("t")).agg(F.count("*").alias("n"))
    of = words.join(held, "t").groupBy("query").agg(F.sum("n").alias("blocks"))
    read = _blocks_to_read(index, asked).groupBy("query").agg(F.count("*").alias("read"))
    return (
        cuts.join(of, "query").join(read, "query", "left")
        .select(F.col("query").alias(query_id), "beat", F.coalesce("read", F.lit(0)).alias("read"), "blocks")
    )
