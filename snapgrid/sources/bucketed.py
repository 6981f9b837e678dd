"""Tables that lie in buckets of a key, so that joins and aggregates on it move nothing.

The files stand under a path; beside it ``<path>.spec`` says how they were cut, so any
session can open the table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Rows aimed at in a bucket, and bounds of the number of buckets; powers of two join without a shuffle
# whatever their number, since one is a multiple of the other.
BUCKET_ROWS, MAX_BUCKETS = 1_000_000, 65_536


def buckets_for(rows: int) -> int:
    n = 1
    while n < MAX_BUCKETS and n * BUCKET_ROWS < rows:
        n *= 2
    return n


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` in buckets of ``key``, a file for each, and open it; what stood there goes.

    Rows are dealt by the same hash that Spark buckets by, so each task writes one bucket.
    A key with most rows makes a large bucket: use it for keys of bounded size.
    """
    spark = df.sparkSession
    n = buckets or buckets_for(df.count())
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(n, key)
    dealt.write.mode("overwrite").format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    # The files stay: the table is external.
    spark.sql(f"DROP TABLE {name}")
    spec = [(key, n, df.schema.json())]
    spark.createDataFrame(spec, "key string, buckets int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}.spec")
    return open_bucketed(spark, path)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table with its buckets known to the optimizer."""
    spec = spark.read.parquet(f"{path}.spec").first()
    schema = StructType.fromJson(json.loads(spec["schema"]))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{spec.key}`) SORTED BY (`{spec.key}`) "
        f"INTO {spec.buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
