"""Severity with recency decay, node summaries and min-max scaling."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the severity formula.
KILLED_WEIGHT = 10
INJURED_WEIGHT = 3
CRASH_WEIGHT = 1
DECAY_PER_YEAR = 0.3
DAYS_PER_YEAR = 365.25
TOP_N = 500

TIE_DIGITS = 9

KILLED = "number_of_persons_killed"
INJURED = "number_of_persons_injured"


def age_years(day: Column, as_of: date | datetime | str) -> Column:
    """Age in years, from whole days up to ``as_of``."""
    return F.datediff(F.lit(as_of).cast("date"), day.cast("date")) / F.lit(DAYS_PER_YEAR)


def recency_weight(age: Column, decay: float = DECAY_PER_YEAR) -> Column:
    return F.exp(-F.lit(decay) * age)


def base_severity(killed: Column, injured: Column) -> Column:
    return (
        F.coalesce(killed, F.lit(0)) * F.lit(float(KILLED_WEIGHT))
        + F.coalesce(injured, F.lit(0)) * F.lit(float(INJURED_WEIGHT))
        + F.lit(float(CRASH_WEIGHT))
    )


def score_rows(
    crashes: DataFrame, as_of: date | datetime | str, day: str = "crash_date", decay: float = DECAY_PER_YEAR
) -> DataFrame:
    """Add age, recency weight, base severity and weighted score to each row.

    A missing date gives a missing score: the row counts, but adds no severity.
    """
    return (
        crashes.withColumn("age_years", age_years(F.col(day), as_of))
        .withColumn("recency_weight", recency_weight(F.col("age_years"), decay))
        .withColumn("base_severity", base_severity(F.col(KILLED), F.col(INJURED)))
        .withColumn("weighted_score", F.col("base_severity") * F.col("recency_weight"))
    )


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def summarise(scored: DataFrame, *keys: str) -> DataFrame:
    """Count, casualties and severity per key; empty sums are 0."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("crash_count"),
        _total(KILLED).alias("total_killed"),
        _total(INJURED).alias("total_injured"),
        _total("weighted_score").alias("severity_score"),
    )


def merge_summaries(summaries: DataFrame, *keys: str) -> DataFrame:
    """Add up summaries of finer groups."""
    return summaries.groupBy(*keys).agg(
        *[
            F.sum(c).alias(c)
            for c in ("crash_count", "total_killed", "total_injured", "severity_score")
        ]
    )


def min_max_scale(df: DataFrame, column: str, scaled: str) -> DataFrame:
    """Scale to 0-1 over all rows; null where all values are equal.

    The bounds are two scalar subqueries over ``df``, which Spark merges into
    one; hand in a stage table when ``df`` is dear to compute.
    """
    low = df.agg(F.min(column)).scalar()
    high = df.agg(F.max(column)).scalar()
    return df.withColumn(scaled, F.try_divide(F.col(column) - low, high - low))


def top_n(df: DataFrame, column: str, *keys: str, n: int = TOP_N) -> DataFrame:
    """First ``n`` rows by descending ``column``; keys settle ties.

    Sums come out a last bit apart when their terms are added in another order,
    so values are compared to ``TIE_DIGITS`` digits and reruns agree.
    """
    return df.orderBy(F.round(column, TIE_DIGITS).desc(), *keys).limit(n)
