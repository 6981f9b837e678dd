"""Settings of the cause model compared on the same folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.operators.evaluation import weighted_f1_and_mae
from snapgrid.operators.features import top_labels
from snapgrid.operators.model import TreeSettings, fit_cause_model, index_labels
from snapgrid.session import stage_table

SCORES = (
    "setting int, kind string, trees int, depth int, rate double, fold int, n_fitted long, n_scored long, weighted_f1 double, mae double, "
    "commonest_f1 double"
)


def fold_of(key: str, folds: int, seed: int = 42) -> Column:
    """The fold of a row by a digest of its key: the same wherever and whenever it is read."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(folds))


def score_settings(table: DataFrame, settings: Sequence[TreeSettings], folds: int = 3, node: str = "NODEID", label: str = "primary_cause") -> DataFrame:
    """One row for each setting and fold: quality on the fold of a model that was fitted on the others.

    The table is indexed and written once, all fits read that. Folds follow the digest of the
    node, so every setting is scored on the same nodes, and each label has its share of a
    fold up to chance. ``commonest_f1`` is what the commonest cause of the fitted rows
    would reach. A fold without rows gives no row.
    """
    labelled, labels = index_labels(stage_table(table, "sweep_table"))
    rows = stage_table(labelled.withColumn("_fold", fold_of(node, folds)), "sweep_rows")
    scores = []
    for fold in range(folds):
        train, test = rows.where(F.col("_fold") != fold).drop("_fold"), rows.where(F.col("_fold") == fold).drop("_fold")
        fitted, scored = train.count(), test.count()
        if not fitted or not scored:
            continue
        commonest = labels.index(top_labels(train, label, 1).first()[0])
        guess = weighted_f1_and_mae(test.withColumn("_guess", F.lit(float(commonest))), "label", "_guess").first().weighted_f1
        for k, setting in enumerate(settings):
            found = stage_table(fit_cause_model(train, labels, setting).predict(test).select("label", "prediction"), "sweep_scored")
            quality = weighted_f1_and_mae(found, "label", "prediction").first()
            scores.append((k, setting.kind, setting.trees, setting.depth, setting.rate, fold, fitted, scored, quality.weighted_f1, float(quality.mae), guess))
    return table.sparkSession.createDataFrame(scores, SCORES)


def best_first(scores: DataFrame) -> DataFrame:
    """Settings with their mean quality over the folds, weighted by rows; the best F1 first, fewer trees on a tie."""
    keys = ["setting", "kind", "trees", "depth", "rate"]
    mean = lambda c: (F.sum(F.col(c) * F.col("n_scored")) / F.sum("n_scored")).alias(c)
    table = scores.groupBy(*keys).agg(F.sum("n_scored").alias("n_scored"), mean("weighted_f1"), mean("mae"), mean("commonest_f1"))
    return table.orderBy(F.round("weighted_f1", 9).desc(), "trees", "depth", "setting")
