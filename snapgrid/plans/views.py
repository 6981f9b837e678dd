"""Tables behind a dashboard, and the look-ups used to check a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgrid.operators.features import frequency
from snapgrid.operators.severity import TIE_DIGITS

# Fixed values.
EVERYTHING = "All"
LEADERBOARD_COLUMNS = [
    "intersection_name",
    "severity_score",
    "crash_count",
    "predicted_cause",
    "Top_Intervention",
]
MAP_COLUMNS = ["latitude", "longitude", *LEADERBOARD_COLUMNS]


def _chosen(master: DataFrame, cause: str | None) -> DataFrame:
    if cause is None or cause == EVERYTHING:
        return master
    return master.where(F.col("predicted_cause") == cause)


def leaderboard(master: DataFrame, cause: str | None = None) -> DataFrame:
    """Most severe first, for one predicted cause or for all."""
    order = [F.round("severity_score", TIE_DIGITS).desc(), "NODEID"]
    return _chosen(master, cause).orderBy(*order).select(*LEADERBOARD_COLUMNS)


def map_feed(master: DataFrame, cause: str | None = None) -> DataFrame:
    """One row per marker: place, colour, size, name and tooltip."""
    return _chosen(master, cause).select(*MAP_COLUMNS)


def filter_values(master: DataFrame) -> DataFrame:
    """The predicted causes to choose from."""
    return master.select("predicted_cause").distinct()


def counts_by(rows: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Rows per key, most first."""
    ordered = frequency(rows.where(F.col(key).isNotNull()), key).orderBy(F.col("n").desc(), key)
    return ordered if top is None else ordered.limit(top)


def year_counts(crashes: DataFrame, key: str, value: object, day: str = "crash_date") -> DataFrame:
    """Crashes per year of one node; those of unknown date are left out."""
    return (
        crashes.where((F.col(key) == value) & F.col(day).isNotNull())
        .groupBy(F.year(day).alias("year"))
        .agg(F.count("*").alias("n"))
        .orderBy("year")
    )


def random_rows(df: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """Random sample of ``n`` rows: the smallest digests of seed and key.

    A top-n and not a full sort; the same rows wherever they are read from.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    return df.withColumn("_digest", digest).orderBy("_digest", key).limit(n).drop("_digest")


def first_row(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys).limit(1)
