"""Class weights and quality measures as aggregates over small count tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.session import stage_table

# Fixed values.
KS = (1, 3, 5)
MACRO_AVERAGE = "Macro-Average"
BROADCAST_CLASSES = 10_000


def class_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Balanced class weights softened by a square root: one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count("*")).scalar()
    return counts.select(label, F.sqrt(total / (classes * F.col("n"))).alias(weight))


def with_class_weight(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Give each row the weight of its class.

    The classes are counted first; up to ``BROADCAST_CLASSES`` of them are broadcast, so
    that rows of a common class need not meet in one task.
    """
    weights = stage_table(class_weights(df, label, weight), "class_weights")
    few = weights.count() <= BROADCAST_CLASSES
    return df.join(F.broadcast(weights) if few else weights, label, "left")


def outcome_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows per pair of actual and predicted class: at most classes squared."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(
    df: DataFrame, actual: str, predicted: str, labels: Sequence, prefix: str = "predicted_"
) -> DataFrame:
    """One row per label, one column per predicted label, 0 where nothing fell."""
    spark = df.sparkSession
    rows = spark.createDataFrame([(label,) for label in labels], ["actual"]).select(
        F.col("actual").cast(df.schema[actual].dataType).alias("actual")
    )
    cells = {f"{prefix}{label}": F.col("predicted") == F.lit(label) for label in labels}
    counted = (
        outcome_counts(df, actual, predicted)
        .groupBy("actual")
        .agg(*[F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(c) for c, hit in cells.items()])
    )
    filled = [F.coalesce(F.col(f"`{c}`"), F.lit(0).cast("bigint")).alias(c) for c in cells]
    return rows.join(counted, "actual", "left").select("actual", *filled).orderBy("actual")


def weighted_f1_and_mae(
    df: DataFrame, actual: str, predicted: str, to_index: Column | None = None
) -> DataFrame:
    """One row with the support-weighted F1 and the mean absolute label error.

    ``actual`` and ``predicted`` hold label indices. A class without any actual
    or predicted row scores 0.
    """
    n, hit = F.col("n"), F.col("actual") == F.col("predicted")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("actual").alias("cls"), n.alias("support"), zero.alias("chosen"),
            F.when(hit, n).otherwise(0).alias("right"),
            (F.abs(F.col("actual") - F.col("predicted")) * n).alias("error"),
        ),
        F.struct(
            F.col("predicted").alias("cls"), zero.alias("support"), n.alias("chosen"),
            zero.alias("right"), (zero * F.col("actual")).alias("error"),
        ),
    )
    by_class = (
        outcome_counts(df, actual, predicted)
        .select(F.inline(sides))
        .groupBy("cls")
        .agg(*[F.sum(c).alias(c) for c in ("support", "chosen", "right", "error")])
    )
    f1 = F.coalesce(
        F.try_divide(2 * F.col("right"), F.col("support") + F.col("chosen")), F.lit(0.0)
    )
    return by_class.agg(
        F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.try_divide(F.sum("error"), F.sum("support")).alias("mae"),
    )


def mark_hits(
    ranked: DataFrame, truth: DataFrame, query: str, title: str
) -> DataFrame:
    """Mark the ranked titles that the truth table lists for their query.

    Queries that the truth table does not know are left out. Titles are compared
    without surrounding blanks. ``truth`` has the columns ``query`` and ``title``.
    """
    known = truth.select(
        F.col(query).alias("_query"), F.trim(title).alias("_title"), F.lit(True).alias("_listed")
    ).dropDuplicates()
    asked = known.select(F.col("_query").alias(query)).dropDuplicates()
    return (
        ranked.join(asked, query, "left_semi")
        .join(
            known,
            (F.col(query) == F.col("_query")) & (F.trim(F.col(title)) == F.col("_title")),
            "left",
        )
        .withColumn("hit", F.coalesce("_listed", F.lit(False)))
        .drop("_query", "_title", "_listed")
    )


def precision_at_k(
    ranked: DataFrame, query: str, rank: str = "rank", hit: str = "hit", ks: Sequence[int] = KS
) -> DataFrame:
    """Precision at each k per query, with a last row for the macro average."""
    per_query = ranked.groupBy(F.col(query).cast("string").alias("query")).agg(
        *[
            (F.sum(F.when((F.col(rank) <= k) & F.col(hit), 1).otherwise(0)) / k).alias(f"p_at_{k}")
            for k in ks
        ]
    )
    macro = per_query.agg(*[F.avg(f"p_at_{k}").alias(f"p_at_{k}") for k in ks]).select(
        F.lit(MACRO_AVERAGE).alias("query"), *[f"p_at_{k}" for k in ks]
    )
    return per_query.unionByName(macro)
