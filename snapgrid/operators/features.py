"""Crash-level flags, node-level features and the primary cause of a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.operators.clean import to_time

# Fixed values.
NIGHT_FROM_HOUR, NIGHT_TO_HOUR = 20, 5
RUSH_HOURS = [7, 8, 9, 16, 17, 18]
FIRST_WEEKEND_DAY = 5
SEVERE_INJURED = 2
EPSILON = 1e-6
UNSPECIFIED = "Unspecified"
OTHER = "Other"
USELESS_CAUSES = ["Unspecified", "Other Vehicular", "Following Too Closely"]
TOP_CAUSES = 5
FEATURES = [
    "total_crashes",
    "total_injured",
    "total_killed",
    "ped_injury_count",
    "ped_death_count",
    "bike_injury_count",
    "bike_death_count",
    "night_crash_count",
    "rush_crash_count",
    "weekend_crash_count",
    "fatal_crash_count",
    "avg_injured",
    "night_ratio",
    "rush_ratio",
    "weekend_ratio",
    "ped_proportion",
    "bike_proportion",
    "severe_ratio",
    "has_ped_crashes",
    "has_bike_crashes",
    "has_night_crashes",
    "has_fatal_crashes",
]

_INJURED = "number_of_persons_injured"
_KILLED = "number_of_persons_killed"


def as_flag(condition: Column) -> Column:
    """0/1, with 0 where the condition is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def calendar_columns(df: DataFrame, day: str = "crash_date", time: str = "crash_time") -> DataFrame:
    """Hour, month, year and weekday (Monday is 0)."""
    return df.withColumns(
        {
            "hour": F.hour(to_time(F.col(time), "H:mm")),
            "month": F.month(day),
            "year": F.year(day),
            "dayofweek": F.weekday(day),
        }
    )


def row_features(crashes: DataFrame) -> DataFrame:
    """Calendar columns and the 0/1 flags of each crash."""
    hour = F.col("hour")

    def some(column: str) -> Column:
        return as_flag(F.col(column) > 0)

    return calendar_columns(crashes).withColumns(
        {
            "is_night": as_flag((hour >= NIGHT_FROM_HOUR) | (hour <= NIGHT_TO_HOUR)),
            "is_rush_hour": as_flag(hour.isin(RUSH_HOURS)),
            "is_weekend": as_flag(F.col("dayofweek") >= FIRST_WEEKEND_DAY),
            "is_pedestrian_injury": some("number_of_pedestrians_injured"),
            "is_pedestrian_death": some("number_of_pedestrians_killed"),
            "is_bike_injury": some("number_of_cyclist_injured"),
            "is_bike_death": some("number_of_cyclist_killed"),
            "is_motorist_injury": some("number_of_motorist_injured"),
            "is_fatal": some(_KILLED),
            "is_severe": F.greatest(some(_KILLED), as_flag(F.col(_INJURED) >= SEVERE_INJURED)),
        }
    )


def with_clean_cause(crashes: DataFrame, cause: str) -> DataFrame:
    """Trim the cause; a missing one is "Unspecified"."""
    return crashes.withColumn(cause, F.trim(F.coalesce(F.col(cause), F.lit(UNSPECIFIED))))


def frequency(df: DataFrame, column: str, count: str | None = None) -> DataFrame:
    """Value counts; ``count`` names a column of counts made earlier."""
    n = F.sum(count) if count else F.count("*")
    return df.groupBy(column).agg(n.alias("n"))


def top_labels(df: DataFrame, column: str, n: int, count: str | None = None) -> DataFrame:
    """The ``n`` most frequent values; the smaller value first on a tie."""
    return (
        frequency(df.where(F.col(column).isNotNull()), column, count)
        .orderBy(F.col("n").desc(), column)
        .limit(n)
        .select(column)
    )


def label_causes(
    df: DataFrame,
    cause: str,
    label: str = "cause_label",
    top: int = TOP_CAUSES,
    unspecified: str = UNSPECIFIED,
    useless: list[str] | None = None,
    count: str | None = None,
) -> DataFrame:
    """Keep rows with a usable cause and name it, or "Other" outside the top causes.

    The top causes are counted before the useless ones are taken out, so fewer
    than ``top`` names may remain.
    """
    specified = df.where(F.col(cause) != unspecified)
    kept = specified.where(~F.col(cause).isin(USELESS_CAUSES if useless is None else useless))
    named = top_labels(specified, cause, top, count).withColumn(label, F.col(cause))
    return kept.join(named, cause, "left").withColumn(label, F.coalesce(label, F.lit(OTHER)))


# Node sums and the crash column that each adds up.
_SUMS = {
    "total_injured": _INJURED,
    "total_killed": _KILLED,
    "ped_injury_count": "is_pedestrian_injury",
    "ped_death_count": "is_pedestrian_death",
    "bike_injury_count": "is_bike_injury",
    "bike_death_count": "is_bike_death",
    "night_crash_count": "is_night",
    "rush_crash_count": "is_rush_hour",
    "weekend_crash_count": "is_weekend",
    "fatal_crash_count": "is_fatal",
}


def node_sums(rows: DataFrame, *keys: str, crash_id: str = "collision_id") -> DataFrame:
    """Additive part of the node features, with row and non-null counts."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("row_count"),
        F.count(crash_id).alias("total_crashes"),
        F.count(_INJURED).alias("injured_known"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in _SUMS.items()],
    )


def merge_node_sums(sums: DataFrame, *keys: str) -> DataFrame:
    columns = ["row_count", "total_crashes", "injured_known", *_SUMS]
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def node_features(sums: DataFrame, *keys: str) -> DataFrame:
    """The model features of each node from its sums."""

    def per(count: str, total: str) -> Column:
        return F.col(count) / (F.col(total) + F.lit(EPSILON))

    def present(count: str) -> Column:
        return (F.col(count) > 0).cast("int")

    return sums.withColumns(
        {
            "avg_injured": F.try_divide(F.col("total_injured"), F.col("injured_known")),
            "night_ratio": per("night_crash_count", "total_crashes"),
            "rush_ratio": per("rush_crash_count", "total_crashes"),
            "weekend_ratio": per("weekend_crash_count", "total_crashes"),
            "ped_proportion": per("ped_injury_count", "total_injured"),
            "bike_proportion": per("bike_injury_count", "total_injured"),
            "severe_ratio": per("fatal_crash_count", "total_crashes"),
            "has_ped_crashes": present("ped_injury_count"),
            "has_bike_crashes": present("bike_injury_count"),
            "has_night_crashes": present("night_crash_count"),
            "has_fatal_crashes": present("fatal_crash_count"),
        }
    ).select(*keys, *FEATURES)


def primary_label(
    df: DataFrame, key: str, label: str, out: str = "primary_cause", count: str | None = None
) -> DataFrame:
    """Most frequent label of each key, the smallest on a tie, "Other" if none.

    Counts per (key, label) come first, so a key with very many rows reaches the
    window as a handful.
    """
    n = F.sum(F.when(F.col(label).isNotNull(), F.col(count) if count else F.lit(1)).otherwise(0))
    counts = df.groupBy(key, label).agg(n.alias("_n"))
    order = Window.partitionBy(key).orderBy(F.col("_n").desc(), F.col(label).asc_nulls_last())
    return (
        counts.withColumn("_rank", F.row_number().over(order))
        .where("_rank = 1")
        .select(key, F.coalesce(label, F.lit(OTHER)).alias(out))
    )
