"""Quantiles and distinct counts from sketches that are stored once and merged at will.

A table of one sketch for each group and day answers for months, regions or everything
without a look at the rows. Sketches are Spark's own; groups are combined on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of a quantile sketch, and the rank error that it keeps with a probability of 0.99.
KLL_K, KLL_RANK_ERROR = 200, 0.0166
# Logarithms of the sizes of distinct sketches; their relative standard errors are
# 1.04 / sqrt(2^k) and 1 / sqrt(2^k).
HLL_LG, THETA_LG = 12, 12
HLL_ERROR, THETA_ERROR = 1.04 / 2 ** (HLL_LG / 2), 1 / 2 ** (THETA_LG / 2)


def quantile_sketches(rows: DataFrame, value: str, *keys: str, k: int = KLL_K) -> DataFrame:
    """``keys``, n, low, high, sketch of ``value``; nulls and NaN are left out."""
    number = F.col(value).cast("double")
    held = rows.where(number.isNotNull() & ~F.isnan(number)).withColumn("_value", number)
    return held.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("_value").alias("low"), F.max("_value").alias("high"), F.kll_sketch_agg_double("_value", F.lit(k)).alias("sketch")
    )


def merged_quantiles(sketches: DataFrame, *keys: str | Column) -> DataFrame:
    """Stored sketches merged by coarser keys; the result can be stored and merged again."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def with_quantiles(sketches: DataFrame, shares: Sequence[float], prefix: str = "p") -> DataFrame:
    """Replace the sketch by a column for each share, such as p50; within KLL_RANK_ERROR in rank."""
    made = {f"{prefix}{round(100 * s)}": F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))) for s in shares}
    return sketches.withColumns(made).drop("sketch")


def distinct_sketches(rows: DataFrame, value: str, *keys: str, lg: int = HLL_LG, theta_lg: int = THETA_LG) -> DataFrame:
    """``keys``, hll (for unions) and theta (for intersections and differences, too) of the values; nulls do not count."""
    return rows.groupBy(*keys).agg(
        F.hll_sketch_agg(value, F.lit(lg)).alias("hll"), F.theta_sketch_agg(value, F.lit(theta_lg)).alias("theta")
    )


def merged_distinct(sketches: DataFrame, *keys: str | Column) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta").alias("theta"))


def distinct_estimates(sketches: DataFrame, name: str = "distinct") -> DataFrame:
    """Replace the sketches by their estimate: that of the HyperLogLog one."""
    return sketches.withColumn(name, F.hll_sketch_estimate("hll")).drop("hll", "theta")


def in_both(left: Column, right: Column) -> Column:
    """How many distinct values two theta sketches share, as an estimate."""
    return F.theta_sketch_estimate(F.theta_intersection(left, right))


def only_in_first(left: Column, right: Column) -> Column:
    return F.theta_sketch_estimate(F.theta_difference(left, right))
