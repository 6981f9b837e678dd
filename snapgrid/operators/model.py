"""Multiclass cause model on node features with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import ceil

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapgrid.operators.boosting import BoostedTrees, fit_boosted
from snapgrid.operators.evaluation import BROADCAST_CLASSES, with_class_weight
from snapgrid.operators.features import FEATURES
from snapgrid.session import stage_table

# Fixed value: share of rows held out.
HOLD_OUT = 0.2
ROWS_A_PARTITION = 50_000


@dataclass(frozen=True)
class TreeSettings:
    """Defaults are the fixed values of the cause model."""

    trees: int = 300
    depth: int = 6
    rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    min_rows: int = 3
    # Least gain of a split. Its scale is that of Spark's impurity, so it stands for the
    # split penalty of other libraries but does not equal it; 0 sets no limit.
    min_gain: float = 0.0
    seed: int = 42
    # "boosted": one-versus-rest gradient boosting; "forest": one random forest,
    # whose trees grow together and which therefore needs far fewer passes.
    kind: str = "boosted"
    features: tuple[str, ...] = field(default=tuple(FEATURES))


def scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, nulls as 0: one aggregate row.

    Twelve digits are kept, so that the order in which sums were added changes no fit.
    """
    stats = df.na.fill(0, list(columns)).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    ).first()
    digits = lambda x: float(f"{x or 0.0:.12g}")
    return {c: (digits(stats[f"avg_{c}"]), digits(stats[f"std_{c}"]) or 1.0) for c in columns}


def scaled(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Columns as deviations from the mean in population deviations; a constant one becomes 0."""
    filled = df.na.fill(0, list(stats))
    return filled.withColumns({c: (F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in stats.items()})


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled by their own statistics."""
    return scaled(df, scaling(df, columns))


def cause_pipeline(settings: TreeSettings, classes: int) -> Pipeline:
    """Assemble and classify by a forest. Expects scaled features, the numeric ``label`` and the row weight.

    With one cause there is nothing to learn: a single tree predicts it, whatever the kind.
    """
    assembler = VectorAssembler(
        inputCols=list(settings.features), outputCol="features", handleInvalid="error"
    )
    shared = dict(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxDepth=settings.depth,
        minInstancesPerNode=settings.min_rows,
        minInfoGain=settings.min_gain,
        subsamplingRate=settings.row_share,
        featureSubsetStrategy=str(settings.column_share),
        seed=settings.seed,
    )
    classifier = RandomForestClassifier(numTrees=settings.trees if classes > 1 else 1, **shared)
    return Pipeline(stages=[assembler, classifier])


@dataclass(frozen=True)
class CauseModel:
    model: PipelineModel | BoostedTrees
    labels: list[str]
    stats: Mapping[str, tuple[float, float]]

    def predict(self, nodes: DataFrame, settings: TreeSettings | None = None) -> DataFrame:
        """Add ``prediction`` and ``predicted_cause``."""
        scored = self.model.transform(scaled(nodes, self.stats))
        named = IndexToString(
            inputCol="prediction", outputCol="predicted_cause", labels=self.labels
        )
        return named.transform(scored)

    def save(self, path: str) -> None:
        """Write the fitted trees, the labels in order and the scaling under ``path``; what was there goes."""
        spark = SparkSession.getActiveSession()
        kind = "boosted" if isinstance(self.model, BoostedTrees) else "forest"
        if kind == "boosted":
            self.model.save(spark, f"{path}/boosted")
        else:
            self.model.write().overwrite().save(f"{path}/trees")
        labels = spark.createDataFrame(list(enumerate(self.labels)), "label int, cause string")
        labels.coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")
        scales = [(k, c, mean, std, kind) for k, (c, (mean, std)) in enumerate(self.stats.items())]
        # Last, so that a folder with it is a whole model.
        spark.createDataFrame(scales, "nth int, feature string, mean double, deviation double, kind string").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/scaling"
        )


def load_cause_model(spark: SparkSession, path: str) -> CauseModel:
    """The model that ``CauseModel.save`` wrote: it predicts what the saved one did."""
    labels = [r.cause for r in spark.read.parquet(f"{path}/labels").orderBy("label").collect()]
    scales = spark.read.parquet(f"{path}/scaling").orderBy("nth").collect()
    # Models stored before trees had a kind are pipelines, boosted ones too.
    boosted = "kind" in scales[0] and scales[0].kind == "boosted"
    model = BoostedTrees.load(spark, f"{path}/boosted") if boosted else PipelineModel.load(f"{path}/trees")
    return CauseModel(model, labels, {r.feature: (r.mean, r.deviation) for r in scales})


def index_labels(nodes: DataFrame, cause: str = "primary_cause") -> tuple[DataFrame, list[str]]:
    """Add ``label``: the position of the cause in alphabetical order."""
    indexer = StringIndexer(inputCol=cause, outputCol="label", stringOrderType="alphabetAsc")
    model = indexer.fit(nodes)
    return model.transform(nodes), list(model.labels)


def fit_cause_model(labelled: DataFrame, labels: list[str], settings: TreeSettings) -> CauseModel:
    """Fit on rows with ``label``; rare classes weigh more (see ``class_weights``)."""
    if settings.kind not in ("boosted", "forest"):
        raise ValueError("kind must be 'boosted' or 'forest'")
    stats = scaling(labelled, settings.features)
    keyed = labelled.withColumn("drawn", F.xxhash64(*[F.col(f"`{c}`") for c in labelled.columns]))
    weighted = with_class_weight(scaled(keyed, stats), "label").select("label", "weight", "drawn", *settings.features)
    if settings.kind == "boosted" and len(labels) > 1:
        rows = stage_table(weighted, "model_rows")
        weights = {int(r.label): r.weight for r in rows.groupBy("label").agg(F.max("weight").alias("weight")).collect()}
        return CauseModel(fit_boosted(rows, len(labels), weights, settings), labels, stats)
    # Every level reads the rows again: they are written once, in no
    # more partitions than their number asks for, and held while the model grows.
    parts = max(1, ceil(labelled.count() / ROWS_A_PARTITION))
    rows = stage_table(weighted.drop("drawn").coalesce(parts), "model_rows").cache()
    try:
        return CauseModel(cause_pipeline(settings, len(labels)).fit(rows), labels, stats)
    finally:
        rows.unpersist()


def split(
    df: DataFrame, key: str, label: str, share: float = HOLD_OUT, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(rest, held out): of each label the given share of rows, rounded, by a digest of the key.

    The side of a row does not depend on where it is read. Rows are counted by label and the
    first digits of the digest; only those that share the digits at which a label's
    quota ends are ranked, so no label has to pass through one task.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    rows = df.withColumn("_digest", digest).withColumn(
        "_part", F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int")
    )
    ordered = Window.partitionBy("_label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.floor(F.lit(share) * F.sum("n").over(Window.partitionBy("_label")) + 0.5)
    parts = (
        rows.groupBy(F.col(label).alias("_label"), "_part").agg(F.count("*").alias("n"))
        .withColumns({"_before": F.coalesce(F.sum("n").over(ordered), F.lit(0)), "_quota": quota})
        .where((F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("n") >= F.col("_quota")))
    )
    ends = stage_table(
        parts.select("_label", F.col("_part").alias("_end"), (F.col("_quota") - F.col("_before")).alias("_left")),
        "hold_out",
    )
    if ends.count() <= BROADCAST_CLASSES:
        ends = F.broadcast(ends)
    marked = rows.join(ends, F.col(label).eqNullSafe(F.col("_label")), "left")
    at_end = F.coalesce(F.col("_part") == F.col("_end"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_digest", key))
    held = marked.where(~at_end).withColumn("_held", F.coalesce(F.col("_part") < F.col("_end"), F.lit(False)))
    edge = marked.where(at_end).withColumn("_held", rank <= F.col("_left"))
    both = stage_table(held.unionByName(edge).select(*df.columns, "_held"), "hold_out_rows")
    return both.where("NOT _held").drop("_held"), both.where("_held").drop("_held")
