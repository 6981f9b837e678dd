"""Cleaning that says what it did: an error class for each rejected row, counts from the same pass."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from snapgrid.operators.clean import (
    COUNT_PREFIX,
    LAT_RANGE,
    LON_RANGE,
    REQUIRED_COLUMNS,
    ensure_columns,
    normalise_headers,
    number_of,
    to_integer_key,
    to_time,
)

KEPT = "kept"
#: Why a row is rejected, in the order in which the rules are tried.
ERRORS = (
    "latitude missing", "latitude not a number", "longitude missing", "longitude not a number", "zero coordinates", "outside the box",
)
#: What a kept row may lack.
WARNINGS = ("key not a whole number", "date missing", "date not readable")


def _blank(column: str) -> Column:
    text = F.col(column).cast("string")
    return text.isNull() | (F.trim(text) == "")


def classified(
    raw: DataFrame, lat_range: tuple[float, float] = LAT_RANGE, lon_range: tuple[float, float] = LON_RANGE
) -> DataFrame:
    """Rows as ``clean.typed_crashes`` gives them, with ``outcome`` (kept or an error) and ``warnings``.

    Warnings name what could not be read in a row, counts included; it may be kept all the
    same. Rows of outcome ``kept`` are those of ``clean.clean_crashes``.
    """
    tidy = ensure_columns(normalise_headers(raw), REQUIRED_COLUMNS)
    lat, lon = number_of(tidy, "latitude"), number_of(tidy, "longitude")
    rules = [
        _blank("latitude"), lat.isNull(), _blank("longitude"), lon.isNull(), (lat == 0) | (lon == 0),
        ~(lat.between(*lat_range) & lon.between(*lon_range)),
    ]
    outcome = F.coalesce(*[F.when(rule, name) for rule, name in zip(rules, ERRORS, strict=True)], F.lit(KEPT))
    counts = [c for c in tidy.columns if COUNT_PREFIX in c]
    time = to_time(F.col("crash_date"))
    found = {
        WARNINGS[0]: to_integer_key(F.col("collision_id")).isNull(),
        WARNINGS[1]: _blank("crash_date"),
        WARNINGS[2]: ~_blank("crash_date") & time.isNull(),
        **{_not_a_number(c): ~_blank(c) & number_of(tidy, c).isNull() for c in counts},
    }
    warnings = F.array_compact(F.array(*[F.when(rule, name) for name, rule in found.items()]))
    typed = {"latitude": lat, "longitude": lon, "crash_date": time, **{c: number_of(tidy, c) for c in counts}}
    return tidy.withColumns({"outcome": outcome, "warnings": warnings}).withColumns(typed)


def _not_a_number(column: str) -> str:
    return f"{column} not a number"


def observed(rows: DataFrame, name: str = "cleaning") -> tuple[DataFrame, Observation]:
    """``rows`` of ``classified`` with counts that the next action on them fills: no pass of their own.

    Read them with ``report``. On a stream they come with each micro-batch's progress.
    """
    seen = Observation(name)
    warned = [*WARNINGS, *[_not_a_number(c) for c in rows.columns if COUNT_PREFIX in c]]
    kept = F.col("outcome") == KEPT
    counts = [F.count("*").alias("rows"), F.count_if(kept).alias(KEPT), *[F.count_if(F.col("outcome") == e).alias(e) for e in ERRORS]]
    counts += [F.count_if(F.array_contains("warnings", w)).alias(w) for w in warned]
    counts += [F.count_if(kept & (F.size("warnings") > 0)).alias("kept with a warning")]
    return rows.observe(seen, *counts), seen


def clean_and_write(raw: DataFrame, path: str, **ranges: tuple[float, float]) -> dict[str, int]:
    """Write all rows under ``path`` in a folder for each outcome, in one pass, and return the counts.

    ``path/outcome=kept`` holds the clean rows, ``path-report`` the counts as JSON.
    """
    rows, seen = observed(classified(raw, **ranges))
    rows.write.mode("overwrite").partitionBy("outcome").parquet(path)
    counts = dict(seen.get)
    spark = raw.sparkSession
    spark.createDataFrame([(json.dumps(counts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-report")
    return counts


def read_clean(spark, path: str) -> DataFrame:
    """The clean rows that ``clean_and_write`` wrote; the other folders are not opened."""
    return spark.read.parquet(path).where(F.col("outcome") == KEPT).drop("outcome", "warnings")


def report(spark, counts: dict[str, int]) -> DataFrame:
    """metric, n."""
    return spark.createDataFrame(sorted(counts.items()), "metric string, n long")
