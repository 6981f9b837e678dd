"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.llm.common import fresh, one_text, slices
from snapgrid.session import stage_table

#: Documented bounds of the rows that the weights are fitted on, and of the model; counts and the cut cover all rows.
POSITIVES, UNLABELLED, FEATURES = 4_000, 8_000, 1_024
#: The model is also fitted on the features that tell most: rare words of copied texts do not crowd them there.
FEW = 128
#: Losses that the weights are fitted with, and their rates. The sigmoid loss forgives wrong marks, but it hardly pulls at
#: texts that it has far on the wrong side; the logistic loss does.
LOSSES = {"sigmoid": 0.1, "logistic": 0.03}
#: Width of the steps of raw scores between which the cut is sought.
STEP = 0.001
#: Distinct features that a task counts before it hands them on; words whose known features a task remembers.
HELD = 200_000
#: Characters of the beginnings. The short ones of an insult may be those of harmless words too, the long ones are not.
PREFIXES = (4, 5, 6, 8)
#: Standard deviations by which a feature must be commoner among positives to be used.
SURPRISE = 4.0
#: The score that stands for the cut between the classes.
TOXIC = 0.7
_WORDS = re.compile(r"\w+")


def _forms(word: str) -> list[str]:
    return [word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n)]


def _words(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def features(text: str | None) -> set[str]:
    """Words of a text and the beginnings of its longer words, each once.

    Beginnings let the model know an inflected or compounded word it has not seen.
    """
    return {f for w in _words(text) for f in _forms(w)}


def finder(known: Iterable[str]) -> Callable[[str | None], list[str]]:
    """A function that gives the ``known`` features of a text, sorted; it remembers what it found for a word."""
    known, seen = frozenset(known), {}

    def find(text: str | None) -> list[str]:
        found = set()
        for word in _words(text):
            hits = seen.get(word)
            if hits is None:
                hits = tuple(f for f in _forms(word) if f in known)
                if len(seen) >= HELD:
                    seen.clear()
                if len(word) <= 64:
                    seen[word] = hits
            if hits:
                found.update(hits)
        return sorted(found)

    return find


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def raws(self) -> Callable[[str | None], float]:
        """The raw score of a text, as a function for many texts."""
        find = finder(self.weights)
        return lambda text: float(np.clip(self.bias + sum(self.weights[f] for f in find(text)), -35, 35))

    def scores(self) -> Callable[[str | None], float]:
        raw = self.raws()
        return lambda text: float(1 / (1 + np.exp(-raw(text))))

    def raw(self, text: str | None) -> float:
        return self.raws()(text)

    def score(self, text: str | None) -> float:
        return self.scores()(text)


def _side(raw: np.ndarray, x: np.ndarray, sign: int, loss: str) -> tuple[float, np.ndarray]:
    """Mean loss of rows taken as class ``sign``, and its gradient."""
    wrong = 1 / (1 + np.exp(np.clip(sign * raw, -35, 35)))
    pull = -sign * wrong / len(raw)
    if loss == "sigmoid":
        mean, pull = wrong.mean(), pull * (1 - wrong)
    else:
        mean = np.logaddexp(0, -sign * raw).mean()
    return float(mean), np.append(pull.astype(x.dtype) @ x, pull.sum()).astype(float)


def fit_nnpu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-3, loss: str = "sigmoid"
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the ``sigmoid`` or ``logistic`` loss.

    The risk of negatives is that of unlabelled rows less ``prior`` times that of
    positives seen as negatives. It cannot be below zero in truth; where the estimate is,
    the step goes against that part, which keeps the model from learning the sample by heart.
    """
    w = np.zeros(positive.shape[1] + 1)
    mean, spread = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        at_positive, at_unlabelled = (x @ w[:-1].astype(x.dtype) + w[-1] for x in (positive, unlabelled))
        _, up = _side(at_positive, positive, 1, loss)
        seen_negative, up_negative = _side(at_positive, positive, -1, loss)
        loss_unlabelled, up_unlabelled = _side(at_unlabelled, unlabelled, -1, loss)
        rest, up_rest = loss_unlabelled - prior * seen_negative, up_unlabelled - prior * up_negative
        slope = prior * up + up_rest if rest >= 0 else -up_rest
        slope[:-1] += decay * w[:-1]
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.999 * spread + 0.001 * slope**2
        w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def threshold(seen: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The cut of raw scores with the least non-negative risk of wrong decisions; the highest of equals.

    ``positive`` and ``unlabelled`` count the rows at each of the distinct scores ``seen``, which ascend.
    """
    cuts = (seen[1:] + seen[:-1]) / 2
    if not len(cuts):
        return float(seen[0]) + 1.0
    above = [1 - np.cumsum(x)[:-1] / np.sum(x) for x in (positive, unlabelled)]
    risk = prior * (1 - above[0]) + np.maximum(0, above[1] - prior * above[0])
    return float(cuts[np.flatnonzero(risk <= risk.min() + 1e-12)[-1]])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash ``drawn``, one row for each id; rows without an id are told apart by their texts.

    Ids may repeat without bound: the text with the least hash stays. Only texts whose id is
    missing or repeats are shuffled.
    """
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(7))).otherwise(F.xxhash64("doc_id", F.lit(7)))
    slim = docs.select("doc_id", "text").withColumn("drawn", drawn)
    known = slim.where("doc_id IS NOT NULL")
    repeats = stage_table(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "toxicity-repeats")
    shared = known.join(repeats, "doc_id", "left_semi").unionByName(slim.where("doc_id IS NULL"))
    shared = stage_table(one_text(shared, "doc_id", "drawn"), "toxicity-shared")
    return known.join(repeats, "doc_id", "left_anti").unionByName(shared)


def _counts(texts: DataFrame, positives: DataFrame) -> DataFrame:
    """(feature, p, u): positives and texts that have a feature which three positives have; "" stands for all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())
        for batch in slices(batches, "text"):
            for text, confirmed in zip(batch.column("text").to_pylist(), batch.column("confirmed").to_pylist(), strict=True):
                both[not confirmed].update(features(text))
                both[not confirmed][""] += 1
                if len(both[0]) + len(both[1]) > HELD:
                    yield made(both)
                    both = (Counter(), Counter())
        yield made(both)

    def made(both: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(both[0] | both[1])
        arrays = [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in both)]
        return pa.RecordBatch.from_arrays(arrays, ["feature", "p", "u"])

    confirmed = texts.join(positives, "doc_id", "left_semi").select("text", F.lit(True).alias("confirmed"))
    rows = confirmed.unionByName(texts.select("text", F.lit(False).alias("confirmed")))
    return stage_table(
        rows.mapInArrow(count, "feature string, p long, u long")
        .groupBy("feature")
        .agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        .where("p >= 3 OR feature = ''"),
        "toxicity-features",
    )


def _doubt(cut: float, seen: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """What speaks against the decisions at ``cut``: positives missed, and marks that are not ``prior`` times theirs.

    Fewer marks than that count too: then the model has learnt its positives by heart.
    """
    above = [float(np.sum(x[seen > cut]) / np.sum(x)) for x in (positive, unlabelled)]
    return prior * (1 - above[0]) + abs(above[1] - prior * above[0])


def _best(texts: DataFrame, positives: DataFrame, models: list[Model], prior: float) -> tuple[Model, float]:
    """The model with the least ``_doubt`` over all texts, the first of equals, and its ``threshold``.

    Raw scores are counted to one STEP: at most 70,001 steps of each model come to the driver.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Models share their features: one search a text serves all.
        find = finder(set().union(*(m.weights for m in models)))

        def steps(text: str | None) -> list[int]:
            found = find(text)
            raws = (np.clip(m.bias + sum(m.weights.get(f, 0.0) for f in found), -35, 35) for m in models)
            return [int(np.floor(float(r) / STEP)) for r in raws]

        for batch in slices(batches, "text"):
            made = [steps(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "steps"])

    scored = stage_table(texts.select("doc_id", "text").mapInArrow(add, f"doc_id {kind}, steps array<long>"), "toxicity-steps")
    confirmed = scored.join(positives, "doc_id", "left_semi").select("steps", F.lit(1).alias("p"), F.lit(0).alias("u"))
    rows = confirmed.unionByName(scored.select("steps", F.lit(0).alias("p"), F.lit(1).alias("u")))
    rows = rows.select(F.posexplode("steps").alias("model", "step"), "p", "u")
    found = rows.groupBy("model", "step").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow().sort_by("step")
    tried = []
    for k, model in enumerate(models):
        its = found.filter(pa.compute.equal(found.column("model"), k))
        step, p, u = (its.column(c).to_numpy() for c in ("step", "p", "u"))
        seen = (step + 0.5) * STEP
        cut = threshold(seen, p, u, prior)
        tried.append((round(_doubt(cut, seen, p, u, prior), 9), k, model, cut))
    return min(tried)[2:]


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic") -> Model:
    """Fit on confirmed positives and unlabelled text among the ``usable`` rows.

    ``usable`` is a condition on doc_id; an id that repeats in ``docs`` gives one text. Features are chosen by
    counts over all usable positives and texts. The weights are fitted
    on at most POSITIVES positives (by hash of the id) and about UNLABELLED texts (a hash range), with each of LOSSES on
    the FEW first features and on all of them; the scores of all usable texts decide which fit is taken, and the cut. The class
    prior comes from all usable labels. Without a positive, every score is zero. Null texts and ids are allowed.
    """
    marked = labels.where(usable).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    prior = marked.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0] or 0.0
    if not prior:
        return Model(-35.0, {})
    positives = stage_table(marked.where(F.col(label) == 1).select("doc_id").distinct(), "toxicity-positives")
    texts = _texts(docs.where(usable))
    counts = _counts(texts, positives)
    totals = counts.where("feature = ''").first()
    if not totals or not totals.p:
        return Model(-35.0, {})
    # How many more positives have the feature than all texts would suggest.
    expected = totals.p * (F.col("u") + 0.5) / totals.u
    surprise = (F.col("p") - expected) / F.sqrt(expected + 1)
    chosen = counts.where((F.col("feature") != "") & (surprise >= SURPRISE)).orderBy(surprise.desc(), "feature").limit(FEATURES)
    names = [r.feature for r in chosen.collect()]
    if not names:
        return Model(-35.0, {})
    place = {n: k for k, n in enumerate(names)}
    ids = [r.doc_id for r in positives.orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES).collect()]
    share = min(1.0, UNLABELLED / totals.u)
    marks = {
        "positive": F.coalesce(F.col("doc_id").isin(ids), F.lit(False)),
        "unlabelled": F.pmod("drawn", F.lit(1_000_000_000)) < round(share * 1_000_000_000),
    }

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(place)
        for batch in slices(batches, "text"):
            found = [sorted(place[f] for f in find(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.int32()))], ["positive", "unlabelled", "found"])

    sample = texts.withColumns(marks).where("positive OR unlabelled").select("text", *marks)
    coded = sample.mapInArrow(encode, "positive boolean, unlabelled boolean, found array<int>").toArrow()

    def matrix(kind: str) -> np.ndarray:
        rows = [r for r in coded.filter(coded.column(kind)).column("found").to_pylist()]
        rows.sort()
        x = np.zeros((len(rows), len(names)), dtype=np.float32)
        for k, r in enumerate(rows):
            x[k, r] = 1
        return x

    x, u, prior = matrix("positive"), matrix("unlabelled"), min(prior, 0.99)
    if not len(x) or not len(u):
        return Model(-35.0, {})
    models = []
    for n in sorted({min(FEW, len(names)), len(names)}):
        for loss, rate in LOSSES.items():
            w, bias = fit_nnpu(x[:, :n], u[:, :n], prior, rate=rate, loss=loss)
            models.append(Model(round(float(bias), 6), {f: round(float(v), 6) for f, v in zip(names[:n], w, strict=True)}))
    model, cut = _best(texts, positives, models, prior)
    return replace(model, bias=round(float(model.bias + np.log(TOXIC / (1 - TOXIC)) - cut), 6))


def with_scores(docs: DataFrame, model: Model, score: str, columns: Iterable[str]) -> DataFrame:
    """Columns ``columns`` of every row and its score (double); a null text is an empty one."""
    columns = list(columns)
    text = fresh(docs.select(*columns), "text_scored")
    slim = docs.select(F.col("text").alias(text), *[F.col(f"`{c}`") for c in columns])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = model.scores()
        for batch in slices(batches, text):
            made = pa.array([score_of(t) for t in batch.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], [*columns, score])

    return slim.mapInArrow(add, f"{kept}, `{score}` double")


def drop_toxic(docs: DataFrame, model: Model, at_least: float = TOXIC) -> DataFrame:
    """``docs``, all columns, without the rows whose score is ``at_least`` or more."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = model.scores()
        for batch in slices(batches, "text"):
            keep = [score_of(t) < at_least for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
