"""Texts to vectors: TF-IDF over exact words, or an encoder of your own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from snapgrid.functions.text import words


# Bytes of a word table that is broadcast.
BROADCAST_BYTES = 32 << 20
_ENTRY_BYTES = 64


# Words that numpy holds at once, with some ten numbers each.
WORDS_AT_ONCE = 500_000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches whose second column lists words, so that each holds less than WORDS_AT_ONCE besides its first row."""
    for batch in batches:
        part = np.cumsum(pa.compute.list_value_length(batch.column(1)).to_numpy(), dtype=np.int64) // WORDS_AT_ONCE
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            yield batch.slice(a, b - a)


# A partition with so many times the average number of rows is dealt anew.
UNEVEN = 2.0


def evenly(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` if its splits leave most tasks without rows; counted on the key column alone.

    A file of one row group is one task, whatever the work on its rows. Tables of many
    row groups are read where they lie.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    held = df.select(key, F.spark_partition_id().alias("_part")).groupBy("_part").count()
    most, total = held.agg(F.max("count"), F.sum("count")).first()
    if not total or most <= UNEVEN * total / slots or total < 2 * slots:
        return df
    return df.repartition(2 * slots, key)


def term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, terms, tf``: the distinct words of each whole text with their counts.

    A text stands in one row, so its words are counted there; the texts are dealt anew only
    where they lie in too few tasks. A batch of texts is counted at once, by row and word.
    """
    dealt = evenly(texts.select(key, F.col(text).alias("_text")), key)
    found = dealt.select(key, F.coalesce(words(F.col("_text")), F.array().cast("array<string>")).alias("_words"))
    schema = StructType(
        [
            StructField(key, texts.schema[key].dataType),
            StructField("terms", ArrayType(StringType())),
            StructField("tf", ArrayType(LongType())),
        ]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            lists = batch.column(1)
            dense = lists.flatten().dictionary_encode()
            size = len(dense.dictionary)
            row = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy())
            code = dense.indices.to_numpy().astype(np.int64)
            # Blank entries stand where a text starts or ends with something else.
            named = pa.compute.not_equal(dense.dictionary, pa.scalar("", dense.dictionary.type)).to_numpy(zero_copy_only=False)[code]
            pairs, tf = np.unique(row[named] * size + code[named], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(len(lists) + 1) * size), pa.int32())
            terms = dense.dictionary.take(pa.array(pairs % max(size, 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(tf))], [key, "terms", "tf"]
            )

    return found.mapInArrow(count, schema)


def term_frequencies(corpus_counts: DataFrame, query_counts: DataFrame) -> DataFrame:
    """``term, term_id, in_docs, asked``: documents per word of the corpus, and is it in a query?

    ``term_id`` numbers the words; stage the table, so that the numbers stay.
    """
    asked = query_counts.select(F.explode("terms").alias("term")).distinct().withColumn("_asked", F.lit(True))
    return (
        corpus_counts.select(F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("in_docs"))
        .join(asked, "term", "left")
        .select(
            "term", F.monotonically_increasing_id().alias("term_id"), "in_docs",
            F.coalesce("_asked", F.lit(False)).alias("asked"),
        )
    )


def tf_idf_vectors(counts: DataFrame, frequencies: DataFrame, corpus_size: int, key: str) -> DataFrame:
    """``key, terms, weights, norm`` with weight tf * ln((n + 1) / (in_docs + 1)).

    The norm is over all words. Listed, by number, are only the words that both a query
    and a document have, since no other can add to a product. The word table is measured:
    up to BROADCAST_BYTES it goes to the texts; beyond that, words meet it in an
    equi-join, where adaptive execution splits a word that is in most texts.
    """
    size = frequencies.agg(F.sum(F.octet_length("term") + _ENTRY_BYTES)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return _vectors_in_place(counts, frequencies, corpus_size, key)
    idf = F.log((F.lit(corpus_size) + 1) / (F.coalesce("in_docs", F.lit(0)) + 1))
    listed = counts.select(key, F.explode_outer(F.arrays_zip("terms", "tf")).alias("_at"))
    listed = listed.select(key, F.col("_at.terms").alias("term"), F.col("_at.tf").alias("tf"))
    weight = F.when(F.col("term").isNotNull(), F.col("tf") * idf)
    weighted = listed.join(frequencies, "term", "left").withColumn("_w", weight)
    shared = F.when(F.col("asked"), F.struct("term_id", F.col("_w").alias("w")))
    return (
        weighted.groupBy(key)
        .agg(
            F.collect_list(shared).alias("_shared"),
            F.sqrt(F.coalesce(F.sum(F.col("_w") * F.col("_w")), F.lit(0.0))).alias("norm"),
        )
        .select(key, F.col("_shared.term_id").alias("terms"), F.col("_shared.w").alias("weights"), "norm")
    )


def _vectors_in_place(counts: DataFrame, frequencies: DataFrame, corpus_size: int, key: str) -> DataFrame:
    """The same with the word table at hand in every task: no shuffle."""
    table = frequencies.select("term", "term_id", "in_docs", "asked").toArrow().combine_chunks()
    listed_id = np.where(table["asked"].to_numpy(), table["term_id"].to_numpy(), -1)
    # A last entry stands for words that the table does not have.
    numbers = np.append(listed_id, -1), np.append(table["in_docs"].to_numpy(), 0)
    shared = counts.sparkSession.sparkContext.broadcast((pa.array(table["term"].to_pylist(), pa.string()), *numbers))
    schema = StructType(
        [
            StructField(key, counts.schema[key].dataType),
            StructField("terms", ArrayType(LongType())),
            StructField("weights", ArrayType(DoubleType())),
            StructField("norm", DoubleType()),
        ]
    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, listed_id, in_docs = shared.value
        for batch in _pieces(batches):
            lists = batch.column(1)
            dense = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy())
            place = pa.compute.index_in(dense.dictionary.cast(pa.string()), value_set=terms)
            place = pa.compute.fill_null(place, len(terms)).to_numpy()[dense.indices.to_numpy()]
            weights = batch.column(2).flatten().to_numpy() * np.log((corpus_size + 1) / (in_docs[place] + 1))
            norms = np.sqrt(np.bincount(row, weights * weights, len(lists)))
            listed = listed_id[place] >= 0
            offsets = pa.array(np.searchsorted(row[listed], np.arange(len(lists) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(listed_id[place[listed]])),
                    pa.ListArray.from_arrays(offsets, pa.array(weights[listed])), pa.array(norms),
                ],
                [key, "terms", "weights", "norm"],
            )

    return counts.select(key, "terms", "tf").mapInArrow(weigh, schema)


def encode(
    texts: DataFrame, key: str, text: str, encoder: Callable[[], Callable[[Sequence[str]], Sequence]]
) -> DataFrame:
    """``key, vector`` from a text encoder run in Arrow batches on the executors.

    ``encoder`` is called once per task and returns the function that turns a
    list of texts into a list of vectors, so a model is loaded once per task.
    """
    schema = StructType(
        [
            StructField(key, texts.schema[key].dataType),
            StructField("vector", ArrayType(DoubleType())),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_vectors = encoder()
        for batch in batches:
            vectors = to_vectors(batch[text].tolist())
            yield pd.DataFrame({key: batch[key], "vector": [list(map(float, v)) for v in vectors]})

    return texts.select(key, text).mapInPandas(run, schema)
