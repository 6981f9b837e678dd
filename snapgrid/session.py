"""Session defaults and stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Stage tables of this process stand together, so that they can be dropped together.
_RUN = f"run-{uuid.uuid4().hex}"


def get_spark(app_name: str = "snapgrid", **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    Ambiguous sizes are left to adaptive execution: it picks the join strategy
    from measured shuffle sizes, merges small partitions and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Folder for stage tables: the one named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    machine-local folder would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="snapgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
        return root
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path beside the stage tables, dropped with them."""
    return f"{stage_root(spark)}/snapgrid/{_RUN}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and return a reader of it.

    Spark does not clean these up: ``drop_stage_tables`` does, at the end of a job.
    Cuts the lineage, so that a lost executor costs one scan and not the whole
    plan, and gives the optimizer the real size of the table for its joins.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage_tables(spark: SparkSession) -> None:
    """Delete what this process has staged; call it when its results are written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{stage_root(spark)}/snapgrid/{_RUN}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
