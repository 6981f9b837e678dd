"""Incremental ingestion of landed crash pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snapgrid.operators.clean import clean_crashes, to_integer_key
from snapgrid.sources import schemas


def ingest_pages(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    schema: str = schemas.CRASH_PAGE,
    clean: Callable[[DataFrame], DataFrame] = clean_crashes,
    pages_per_batch: int | None = None,
    multiline: bool = False,
) -> StreamingQuery:
    """Clean the pages that have arrived since the last run and append them.

    Uses the batch cleaning step and stops when nothing is left. The checkpoint
    and the file sink make each page count once, also after a failure.
    ``multiline`` reads pages that are each one JSON array.
    """
    return _append(clean(landed_pages(spark, source, schema, pages_per_batch, multiline)), sink, checkpoint)


def landed_pages(
    spark: SparkSession, source: str, schema: str, pages_per_batch: int | None = None, multiline: bool = False, landed: str | None = None
) -> DataFrame:
    """A stream of the pages under ``source``, oldest first; ``landed`` names a column for when a page landed."""
    reader = spark.readStream.schema(schema).option("multiLine", multiline)
    if pages_per_batch:
        reader = reader.option("maxFilesPerTrigger", pages_per_batch)
    pages = reader.json(source)
    return pages.select("*", F.col("_metadata.file_modification_time").alias(landed)) if landed else pages


def _append(rows: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def record_key(rows: DataFrame, key: str, but: tuple[str, ...] = ()) -> Column:
    """What makes two rows the same record: the whole-number key, else the key as it stands, else the whole row."""
    columns = [F.col(f"`{c}`") for c in rows.columns if c not in but]
    whole = F.concat(F.lit("row "), F.sha2(F.to_json(F.struct(*columns)), 256))
    return F.coalesce(to_integer_key(F.col(key)).cast("string"), F.concat(F.lit("key "), F.col(key).cast("string")), whole)


def ingest_distinct(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    delay: str = "7 days",
    key: str = "collision_id",
    schema: str = schemas.CRASH_PAGE,
    clean: Callable[[DataFrame], DataFrame] = clean_crashes,
    pages_per_batch: int | None = None,
    multiline: bool = False,
) -> StreamingQuery:
    """Like ``ingest_pages``, and a record that lands again within ``delay`` is appended once.

    Pages cut by offset repeat rows when records arrive between two requests. State is a
    key for each record of the last ``delay``, by the time its page landed; what is older
    leaves the state, so it doesn't grow with the table. The first version stays: use
    ``sums.track_sums`` where corrections must count. Rows without a key are the same
    record if they are equal.
    """
    rows = clean(landed_pages(spark, source, schema, pages_per_batch, multiline, landed="_landed"))
    keyed = rows.withColumn("_record", record_key(rows, key, but=("_landed",))).withWatermark("_landed", delay)
    return _append(keyed.dropDuplicatesWithinWatermark(["_record"]).drop("_record", "_landed"), sink, checkpoint)
