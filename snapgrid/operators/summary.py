"""Distribution summaries whose state stays bounded at any size."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.operators.clean import number_of

# Fixed values.
QUARTILES = (0.25, 0.5, 0.75)
UPPER_QUANTILES = (0.5, 0.75, 0.9, 0.99)

# Relative accuracy 1 / ACCURACY of the sketch that brackets the ranks.
ACCURACY = 10_000
LEAF_ROWS = 10_000


def exact_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], accuracy: int = ACCURACY, leaf_rows: int = LEAF_ROWS
) -> list[float | None]:
    """Exact quantiles with linear interpolation; nulls, NaN and infinities are left out.

    Spark's own exact percentile keeps every distinct value in one task. Here a sketch
    brackets all wanted ranks, one scan counts the rows below and inside the brackets,
    and one reads off what is inside: three scans, as long as a bracket holds at most
    ``leaf_rows`` distinct values. Fuller brackets are narrowed together, by the sketch
    of their inside and by their middle, so that every round makes them smaller. The
    driver sees counts only, and at most ``leaf_rows`` values for each bracket at the end.
    """
    values = df.select(number_of(df, column).alias("v")).where(F.col("v").isNotNull())
    margin = 2.0 / accuracy
    n, low, high, edges = values.agg(
        F.count("v"), F.min("v"), F.max("v"), F.percentile_approx("v", _around(probs, margin), accuracy)
    ).first()
    if not n:
        return [None for _ in probs]
    places = [(n - 1) * p for p in probs]
    ranks = sorted({f(x) for x in places for f in (floor, ceil)})
    found: dict[int, float] = {}
    # Each with its ends, the rows below it, the ranks looked for inside, and where to cut it.
    open_ = [(low, high, 0, ranks, edges)]
    while open_:
        leaves = []
        rows = _histogram(values, [(r[0], r[1], r[4]) for r in open_])
        narrowed = []
        for k, (_, _, before, wanted, _) in enumerate(open_):
            for row in sorted((r for r in rows if r.range == k), key=lambda r: r.low):
                inside = [r for r in wanted if before <= r < before + row.n]
                if inside and row.low == row.high:
                    found.update({r: row.low for r in inside})
                elif inside and row.n <= leaf_rows:
                    leaves.append((row.low, row.high, before, inside))
                elif inside:
                    narrowed.append((row.low, row.high, before, inside, row.n))
                before += row.n
        _read_off(values, leaves, found)
        sketches = _sketches(values, narrowed, margin, accuracy)
        open_ = [(*r[:4], cuts) for r, cuts in zip(narrowed, sketches)]
    return [
        found[floor(x)] + (found[ceil(x)] - found[floor(x)]) * (x - floor(x)) for x in places
    ]


def _around(shares: Sequence[float], margin: float) -> list[float]:
    """Points a little below and above each share."""
    return sorted({min(max(s + d, 0.0), 1.0) for s in shares for d in (-margin, margin)})


def _within(low: float, high: float) -> Column:
    return F.col("v").between(F.lit(low), F.lit(high))


def _histogram(values: DataFrame, ranges: Sequence[tuple[float, float, Sequence[float]]]) -> list:
    """Rows, smallest and largest value of each part that the cuts and the middle make of each range."""
    name, part = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (low, high, cuts) in enumerate(ranges):
        edges = sorted({low, *cuts, low / 2 + high / 2})
        above = sum((F.col("v") > F.lit(e)).cast("int") for e in edges)
        # A cut's own value is a part by itself, as a value may have most of the rows.
        above = above * 2 + F.col("v").isin(edges).cast("int")
        name = F.when(_within(low, high), F.lit(k)).otherwise(name)
        part = F.when(_within(low, high), above).otherwise(part)
    counted = values.select("v", name.alias("range"), part.alias("part")).where(F.col("range").isNotNull())
    return (
        counted.groupBy("range", "part")
        .agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .collect()
    )


def _sketches(values: DataFrame, ranges: Sequence[tuple], margin: float, accuracy: int) -> list[list[float]]:
    """Where to cut each range around its ranks: one scan for all ranges."""
    if not ranges:
        return []
    inner = [
        F.percentile_approx(
            F.when(_within(low, high), F.col("v")),
            _around([(r - before) / n for r in wanted], margin),
            accuracy,
        )
        for low, high, before, wanted, n in ranges
    ]
    return list(values.agg(*[c.alias(f"c{k}") for k, c in enumerate(inner)]).first())


def _read_off(values: DataFrame, leaves: Sequence[tuple], found: dict[int, float]) -> None:
    """Find the ranks inside the leaves among their values."""
    if not leaves:
        return
    in_leaf = F.lit(False)
    for low, high, _, _ in leaves:
        in_leaf = in_leaf | _within(low, high)
    counted = values.where(in_leaf).groupBy("v").count().orderBy("v").collect()
    for low, high, before, ranks in leaves:
        for value, count in counted:
            if low <= value <= high:
                found.update({r: value for r in ranks if before <= r < before + count})
                before += count


def quantile_table(df: DataFrame, column: str, probs: Sequence[float] = UPPER_QUANTILES) -> DataFrame:
    """``prob, value`` rows."""
    rows = list(zip([float(p) for p in probs], exact_quantiles(df, column, probs)))
    return df.sparkSession.createDataFrame(rows, "prob double, value double")


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of a column: one row."""
    quartiles = exact_quantiles(df, column, QUARTILES)
    v = number_of(df, column)
    named = [F.lit(q).cast("double").alias(name) for q, name in zip(quartiles, ("p25", "p50", "p75"))]
    return df.agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        *named,
        F.max(v).alias("max"),
    )
