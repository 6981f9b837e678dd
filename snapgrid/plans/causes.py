"""From crashes and the node map to predicted causes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgrid.operators.clean import keyed_crashes
from snapgrid.operators.evaluation import confusion_matrix, weighted_f1_and_mae
from snapgrid.operators.features import (
    TOP_CAUSES,
    UNSPECIFIED,
    USELESS_CAUSES,
    label_causes,
    merge_node_sums,
    node_features,
    node_sums,
    primary_label,
    row_features,
    with_clean_cause,
)
from snapgrid.operators.model import CauseModel, TreeSettings, fit_cause_model, index_labels, split
from snapgrid.session import stage_table

CAUSE = "contributing_factor_vehicle_1"


def crashes_at_nodes(crashes: DataFrame, node_map: DataFrame) -> DataFrame:
    """Crash rows with the node they belong to; twice where two nodes tie."""
    keyed_map = keyed_crashes(node_map.select("collision_id", "NODEID"))
    return keyed_crashes(crashes).join(keyed_map, "collision_id")


def training_table(
    crashes_with_node: DataFrame,
    cause: str = CAUSE,
    top: int = TOP_CAUSES,
    unspecified: str = UNSPECIFIED,
    useless: list[str] | None = None,
    node: str = "NODEID",
) -> DataFrame:
    """Features and primary cause of each node.

    The crash rows are read once and summed per (node, cause) on the map side.
    That small table gives the top causes, the features and the primary causes.
    """
    useless = USELESS_CAUSES if useless is None else useless
    rows = with_clean_cause(row_features(crashes_with_node), cause)
    sums = stage_table(node_sums(rows.where(F.col(node).isNotNull()), node, cause), "node_cause_sums")
    labelled = label_causes(sums, cause, "cause_label", top, unspecified, useless, count="row_count")
    features = node_features(merge_node_sums(labelled, node), node)
    return features.join(primary_label(labelled, node, "cause_label", count="row_count"), node)


@dataclass(frozen=True)
class CauseRun:
    predictions: DataFrame
    labels: list[str]
    model: CauseModel | None = None

    def quality(self) -> DataFrame:
        """Weighted F1 and mean absolute error of the label index."""
        return weighted_f1_and_mae(self.predictions.dropna(subset=["label"]), "label", "prediction")

    def confusion(self) -> DataFrame:
        return confusion_matrix(self.predictions, "primary_cause", "predicted_cause", self.labels)


def run_model(
    table: DataFrame, settings: TreeSettings | None = None, node: str = "NODEID", held_out: bool = False
) -> CauseRun:
    """Fit and predict. In-sample as a rule; ``held_out`` scores unseen nodes only."""
    settings = settings or TreeSettings()
    table = stage_table(table, "training_table")
    labelled, labels = index_labels(table)
    train, test = split(labelled, node, "label") if held_out else (labelled, labelled)
    model = fit_cause_model(train, labels, settings)
    return CauseRun(stage_table(_scored(model, test, node), "predictions"), labels, model)


def _scored(model: CauseModel, labelled: DataFrame, node: str) -> DataFrame:
    return model.predict(labelled).select(node, "label", "prediction", "primary_cause", "predicted_cause")


def score_table(model: CauseModel, table: DataFrame, node: str = "NODEID") -> CauseRun:
    """Predictions of a stored model for a table that it need not have seen.

    A cause that the model does not know has no label; such nodes are predicted and play no
    part in the quality.
    """
    known = F.array(*[F.lit(c) for c in model.labels])
    place = F.array_position(known, F.col("primary_cause"))
    labelled = table.withColumn("label", F.when(place > 0, place - 1).cast("double"))
    return CauseRun(stage_table(_scored(model, labelled, node), "predictions"), model.labels, model)


def ranked_predictions(predictions: DataFrame, rankings: DataFrame) -> DataFrame:
    """Predictions of the ranked nodes, with the key and name of the ranking."""
    names = rankings.select(F.col("NODEID").alias("ranked_node"), "intersection_name")
    return (
        predictions.join(rankings.select("NODEID"), "NODEID", "left_semi")
        .join(names, F.col("NODEID") == F.col("ranked_node"), "left")
        .select(
            "NODEID",
            "predicted_cause",
            F.col("primary_cause").alias("actual_cause"),
            "ranked_node",
            "intersection_name",
        )
    )
