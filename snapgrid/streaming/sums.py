"""Node sums that follow the landed pages: new, re-landed and corrected records.

Under ``root`` every micro-batch writes what it changed, in folders named by its id:

    versions/batch=N/bucket=b   records as the batch left them, by a hash of their key
    sums/batch=N                what the batch adds to and takes from each node
    versions-base, sums-base    the same for all batches up to N

A batch reads only what earlier batches wrote and replaces its own folders, so one that
is run again after a failure changes nothing twice. ``compact`` folds old batches.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snapgrid.operators.clean import LAT_RANGE, LON_RANGE, to_integer_key, typed_crashes
from snapgrid.operators.nearest import nearest_within
from snapgrid.operators.severity import DAYS_PER_YEAR, DECAY_PER_YEAR, INJURED, KILLED, TOP_N, min_max_scale, score_rows, top_n
from snapgrid.operators.targets import point_targets
from snapgrid.plans.ranking import SNAP_RADIUS_M
from snapgrid.session import stage_table
from snapgrid.sources import schemas
from snapgrid.streaming.ingest import landed_pages

BUCKETS = 64
_VALUES = f"latitude double, longitude double, crash_date timestamp, {KILLED} double, {INJURED} double"
VERSIONS = f"collision_id bigint, landed timestamp, digest bigint, {_VALUES}, bucket int"
SUMS = "NODEID bigint, crash_count bigint, total_killed double, total_injured double, severity double, as_of date"
_SUMMED = ("crash_count", "total_killed", "total_injured", "severity")
_NAMES = [f.split()[0] for f in _VALUES.split(", ")]


def _files(spark: SparkSession, folder: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    return hadoop, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _written(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the complete batches under ``folder``."""
    hadoop, files, path = _files(spark, folder)
    if not files.exists(path):
        return []
    names = [(s.getPath(), s.getPath().getName().partition("=")) for s in files.listStatus(path)]
    return sorted(int(n) for at, (kind, _, n) in names if kind == "batch" and files.exists(hadoop.Path(at, "_SUCCESS")))


def _read(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest base and the batches after it, up to but not with ``before``."""
    early = lambda n: before is None or n < before
    base = max(filter(early, _written(spark, f"{folder}-base")), default=-1)
    batches = [b for b in _written(spark, folder) if b > base and early(b)]
    rows = spark.createDataFrame([], schema)
    for top, ids in ((f"{folder}-base", [base] if base >= 0 else []), (folder, batches)):
        if ids:
            reader = spark.read.schema(schema).option("basePath", top)
            rows = rows.unionByName(reader.parquet(*[f"{top}/batch={n}" for n in ids]).select(*rows.columns))
    return rows


def _newest(rows: DataFrame) -> DataFrame:
    """The last version of each record: by when it landed, then by its digest. Combined on the map side."""
    version = F.struct("landed", "digest", *_NAMES)
    return rows.groupBy("collision_id").agg(F.max(version).alias("v")).select("collision_id", "v.*")


def _records(pages: DataFrame) -> DataFrame:
    """Typed records with a key; coordinates that cannot be used are null, so that a correction can take a record out."""
    typed = typed_crashes(pages).withColumn("collision_id", to_integer_key(F.col("collision_id"))).dropna(subset=["collision_id"])
    lat, lon = F.col("latitude"), F.col("longitude")
    usable = lat.between(*LAT_RANGE) & lon.between(*LON_RANGE) & (lat != 0) & (lon != 0)
    placed = typed.withColumns({"latitude": F.when(usable, lat), "longitude": F.when(usable, lon)})
    return placed.select("collision_id", "landed", F.xxhash64(*_NAMES).alias("digest"), *_NAMES)


def _signed(changed: DataFrame, as_of: str) -> DataFrame:
    """What the changes add and take, per coordinate."""
    new = changed.select(F.lit(1).alias("sign"), *[F.col(f"new.{c}").alias(c) for c in _NAMES])
    old = changed.where("old IS NOT NULL").select(F.lit(-1).alias("sign"), *[F.col(f"old.{c}").alias(c) for c in _NAMES])
    scored = score_rows(new.unionByName(old).dropna(subset=["latitude", "longitude"]), as_of)

    def total(value: Column) -> Column:
        return F.sum(F.col("sign") * F.coalesce(value, F.lit(0.0)))

    sums = scored.groupBy(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(
        F.sum("sign").alias("crash_count"), total(F.col(KILLED)).alias("total_killed"), total(F.col(INJURED)).alias("total_injured"),
        total(F.col("weighted_score")).alias("severity"),
    )
    return sums.where(" OR ".join(f"{c} <> 0" for c in _SUMMED))


def apply_batch(batch: DataFrame, batch_id: int, root: str, targets: DataFrame, as_of: str, radius_m: float = SNAP_RADIUS_M) -> None:
    """Write the versions and the node sums of one batch of pages (``landed`` says when each row did)."""
    spark = batch.sparkSession
    fresh = stage_table(_newest(_records(batch)).withColumn("bucket", F.pmod(F.xxhash64("collision_id"), F.lit(BUCKETS)).cast("int")), "sums-fresh")
    # Only buckets that the batch touches are read, and of them only its records.
    stored = _read(spark, f"{root}/versions", VERSIONS, batch_id)
    mine = fresh.select(F.col("collision_id").alias("c"), F.col("bucket").alias("b"))
    stored = stored.join(mine, (F.col("bucket") == F.col("b")) & (F.col("collision_id") == F.col("c")), "left_semi")
    old = _newest(stored).select(F.col("collision_id").alias("id"), F.struct("landed", "digest", *_NAMES).alias("old"))
    new = fresh.select("collision_id", "bucket", F.struct("landed", "digest", *_NAMES).alias("new"))
    changed = new.join(old, F.col("collision_id") == F.col("id"), "left").drop("id")
    changed = stage_table(changed.where("old IS NULL OR new > old"), "sums-changed")
    changed.select("collision_id", "new.*", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/versions/batch={batch_id}")
    near = nearest_within(stage_table(_signed(changed.where("old IS NULL OR new.digest <> old.digest"), as_of), "sums-places"), targets, "NODEID", radius_m)
    summed = near.groupBy(F.col("NODEID").cast("bigint").alias("NODEID")).agg(*[F.sum(c).alias(c) for c in _SUMMED])
    summed.withColumn("as_of", F.lit(as_of).cast("date")).write.mode("overwrite").parquet(f"{root}/sums/batch={batch_id}")


def track_sums(
    spark: SparkSession,
    source: str,
    root: str,
    nodes: DataFrame,
    as_of: str | None = None,
    radius_m: float = SNAP_RADIUS_M,
    schema: str = schemas.CRASH_PAGE,
    pages_per_batch: int | None = None,
    multiline: bool = False,
) -> StreamingQuery:
    """Bring the node sums under ``root`` up to the pages that have landed, and stop.

    A record counts in its last version: it may land again unchanged, with other numbers,
    at another place, or with coordinates that take it out. Rows without a whole-number
    key can't be followed and are left out. ``as_of`` is the day that severities are
    written for; they can be read for any day.
    """
    day, targets = as_of or date.today().isoformat(), point_targets(nodes, "latitude", "longitude", "NODEID")
    pages = landed_pages(spark, source, schema, pages_per_batch, multiline, landed="landed")
    return (
        pages.writeStream.foreachBatch(lambda batch, n: apply_batch(batch, n, root, targets, day, radius_m))
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )


def node_sums(spark: SparkSession, root: str, as_of: str) -> DataFrame:
    """Count, casualties and severity on ``as_of`` of every node with a crash.

    All severities fade at one rate, so sums for one day times a factor are those for another.
    """
    years = F.datediff(F.lit(as_of).cast("date"), F.col("as_of")) / F.lit(DAYS_PER_YEAR)
    faded = F.sum(F.col("severity") * F.exp(-F.lit(DECAY_PER_YEAR) * years))
    sums = _read(spark, f"{root}/sums", SUMS).groupBy("NODEID").agg(
        *[F.sum(c).alias(c) for c in _SUMMED[:3]], faded.alias("severity_score")
    )
    return sums.where("crash_count > 0")


def ranked_sums(spark: SparkSession, root: str, as_of: str, n: int = TOP_N) -> DataFrame:
    """The ranking of ``ranking.rank_nodes`` from the sums, without reading a crash."""
    sums = stage_table(node_sums(spark, root, as_of), "sums-nodes")
    return top_n(min_max_scale(sums, "severity_score", "severity_score_norm"), "severity_score", "NODEID", n=n)


def compact(spark: SparkSession, root: str) -> None:
    """Fold all complete batches into one base; run it between two runs of ``track_sums``.

    Only batches with both parts count. The base is complete before what it replaces goes.
    """
    upto = max(set(_written(spark, f"{root}/sums")) & set(_written(spark, f"{root}/versions")), default=-1)
    if upto < 0:
        return
    versions = _newest(_read(spark, f"{root}/versions", VERSIONS, upto + 1))
    bucket = F.pmod(F.xxhash64("collision_id"), F.lit(BUCKETS)).cast("int")
    versions.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/versions-base/batch={upto}")
    sums = _read(spark, f"{root}/sums", SUMS, upto + 1).groupBy("NODEID", "as_of").agg(*[F.sum(c).alias(c) for c in _SUMMED])
    sums.write.mode("overwrite").parquet(f"{root}/sums-base/batch={upto}")
    hadoop, files, _ = _files(spark, root)
    for part in ("versions", "sums"):
        for folder, first in ((part, upto + 1), (f"{part}-base", upto)):
            for n in _written(spark, f"{root}/{folder}"):
                if n < first:
                    files.delete(hadoop.Path(f"{root}/{folder}/batch={n}"), True)
