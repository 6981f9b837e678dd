"""Readers and sinks over files that Spark splits itself."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType, StructField, StructType

from snapgrid.operators.clean import clean_crashes, to_integer_key, to_number
from snapgrid.sources import schemas


def read_json_pages(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """All landed pages under ``path``; a key that a page lacks is null.

    One record per line is split freely; ``multiline`` reads pages that are each
    one JSON array, a file at a time.
    """
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; every column is text under its own name.

    With a schema its columns are taken by name, whatever their order in the file, and
    typed; text that does not fit the type becomes null, a missing column is an error.
    Quoted fields may contain line breaks only if the writer escaped them, so
    that large files can be split.
    """
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    if schema is None:
        return rows
    held = {c.strip().lower(): c for c in rows.columns}
    fields = StructType.fromDDL(schema).fields
    if missing := [f.name for f in fields if f.name.strip().lower() not in held]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return rows.select(
        *[_typed(F.col(f"`{held[f.name.strip().lower()]}`"), f).alias(f.name) for f in fields]
    )


def _typed(text: Column, field: StructField) -> Column:
    if isinstance(field.dataType, IntegralType):
        return to_integer_key(text).try_cast(field.dataType)
    if isinstance(field.dataType, FractionalType):
        return to_number(text).try_cast(field.dataType)
    return text.try_cast(field.dataType)


def read_crash_pages(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Landed crash pages, cleaned."""
    return clean_crashes(read_json_pages(spark, path, schemas.CRASH_PAGE, multiline))


def read_crash_csv(spark: SparkSession, path: str) -> DataFrame:
    """A crash export in CSV, cleaned. All text first: postal codes keep their zeros."""
    return clean_crashes(read_csv(spark, path))


def read_layer(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A node, street or centerline layer landed as Parquet or as JSON lines."""
    if path.rstrip("/").endswith((".json", ".jsonl", ".geojsonl")):
        return spark.read.schema(schema).json(path)
    return spark.read.schema(schema).parquet(path)


def read_through(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], use_cache: bool = True
) -> DataFrame:
    """Read the Parquet cache at ``path``, or build the table and put it there.

    Only a cache that was written to its end counts. A new one is built beside the old
    one and then takes its place, so a failed build leaves nothing that is read later.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (use_cache and files.exists(hadoop.Path(target, "_SUCCESS"))):
        built = f"{path.rstrip('/')}-building-{uuid.uuid4().hex}"
        write_parquet(build(), built)
        files.delete(target, True)
        files.rename(hadoop.Path(built), target)
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, one file per partition."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
