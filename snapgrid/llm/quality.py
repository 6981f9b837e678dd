"""Quality scores by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.llm.common import one_text, slices
from snapgrid.operators.summary import exact_quantiles
from snapgrid.session import stage_table

#: Documented bounds: labelled rows of each class (by hash of the id), preference pairs.
ROWS_A_CLASS, PAIRS = 5_000, 200_000
#: Cuts of each feature; a document has one indicator for each cut it is above.
CUTS = 12
#: The score from which a document counts as good.
GOOD = 0.7

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = {
    "upper": np.array([65 <= b <= 90 for b in range(256)]),
    "lower": np.array([97 <= b <= 122 or b >= 128 for b in range(256)]),
    "digit": np.array([48 <= b <= 57 for b in range(256)]),
    "stop": np.isin(np.arange(256), list(b".,;:?'\"-")),
}
_KIND["symbol"] = ~(_SPACE | np.logical_or.reduce(list(_KIND.values())))
#: Names of the features, in their order.
FEATURES = (
    "words", "word_length", "distinct_words", "commonest_word", "ten_commonest", "repeated_word", "distinct_pairs",
    "capital_words", "symbol_words", "longest_word", "lines", "distinct_lines", "line_words", "entropy", "squeeze",
    *(f"share_{k}" for k in _KIND), "exclamations", "pipes", "sentences", "worst_window",
)
WINDOW = 40


def _odd(words: list[str]) -> float:
    """How odd a stretch of words is: the most of repetition, capitals and symbols, 0 to 1."""
    n = len(words)
    repeated = 1 - len(set(words)) / n
    capital = sum(map(str.isupper, words)) / n
    symbols = sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\")" for w in words) / n
    return max(repeated, capital, symbols)


def features(text: str | None) -> np.ndarray:
    """Measures of the whole text that tell prose from repetition, shouting, markup and lists."""
    out = np.zeros(len(FEATURES))
    words = (text or "").split()
    if not words:
        return out
    raw, n = text.encode(), len(words)
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    ink = max(1, int(bytes_of[~_SPACE].sum()))
    share = bytes_of[bytes_of > 0] / len(raw)
    common = Counter(words)
    top = [c for _, c in common.most_common(10)]
    lines = [x for x in text.split("\n") if x.strip()]
    windows = [words[a : a + WINDOW] for a in range(0, n, WINDOW)]
    windows = [w for w in windows if len(w) >= WINDOW // 2] or [words]
    out[:] = (
        np.log1p(n), ink / n, len(common) / n, top[0] / n, sum(top) / n, sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], strict=False))) / n, sum(map(str.isupper, words)) / n,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\")" for w in words) / n, np.log1p(max(map(len, words))),
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(n / len(lines)), -(share * np.log2(share)).sum(),
        len(zlib.compress(raw, 1)) / len(raw), *(bytes_of[k].sum() / ink for k in _KIND.values()),
        bytes_of[33] / n, bytes_of[124] / n, len(re.findall(r"[.?]\s", text)) / n, max(map(_odd, windows)),
    )
    return out


@dataclass(frozen=True)
class Model:
    cuts: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        # To nine digits: the order in which a sum was added decides nothing.
        return np.round(_indicators(rows, self.cuts) @ self.weights, 9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; GOOD at the threshold."""
        at = (self.raw(rows) - self.threshold) / self.spread + np.log(GOOD / (1 - GOOD))
        return np.where(at >= np.log(GOOD / (1 - GOOD)), np.maximum(1 / (1 + np.exp(-np.clip(at, -35, 35))), GOOD), 1 / (1 + np.exp(-np.clip(at, -35, 35))))


def _indicators(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return (rows[:, :, None] > cuts[None]).reshape(len(rows), -1).astype(np.float64)


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights w such that sigmoid(w . (x_better - x_worse)) tells which row of a pair is preferred."""
    w, mean, spread = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, steps + 1):
        s = x @ w
        pull = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -35, 35))) / len(better)
        each = np.bincount(worse, pull, len(x)) - np.bincount(better, pull, len(x))
        slope = each @ x + decay * w
        mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return w


def _threshold(docs: DataFrame, marked: DataFrame, model: Model, poor: float) -> float:
    """Between the raw scores of all ``marked`` documents that have a share ``poor`` of them below it.

    Each id counts once, by the text with the least hash. Texts are not shuffled.
    """
    slim = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            made = model.raw(np.array([features(t) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(made)], ["doc_id", "h", "raw"])

    scored = slim.withColumn("h", F.xxhash64("text")).mapInArrow(add, f"doc_id {kind}, h long, raw double")
    once = scored.groupBy("doc_id").agg(F.min_by("raw", F.struct("h", "raw")).alias("raw"))
    once = stage_table(once.join(marked.select("doc_id"), "doc_id", "left_semi").select("raw"), "quality-raw")
    n = once.count()
    k = max(0, min(math.ceil(round(poor * n, 6)) - 1, n - 2))
    # Scores have nine digits, and the middle of two of them has ten.
    return round(float(np.mean(exact_quantiles(once, "raw", [i / max(n - 1, 1) for i in (k, min(k + 1, n - 1))]))), 10)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> Model | None:
    """Learn scores from pairs of a good and a bad document among the ``usable`` labels.

    ``usable`` is a condition on doc_id. At most ROWS_A_CLASS rows of each class, taken by a hash of the
    id, give at most PAIRS pairs; an id that repeats in ``docs`` gives one text. The threshold is the quantile of the scores of all usable documents that has
    the labels' share of bad rows below it. None if a class is missing.
    """
    marked = labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg((F.min(label) == 1).alias("good"))
    sizes = {r.good: r["count"] for r in marked.groupBy("good").count().collect()}
    picked = [
        marked.where(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS_A_CLASS).collect()
        for good in (True, False)
    ]
    if not all(picked):
        return None
    good = {r.doc_id for r in picked[0]}
    ids = sorted(good | {r.doc_id for r in picked[1]})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    # Ids may repeat in docs, without bound: each gives one text.
    sample = one_text(docs.select("doc_id", "text").where(F.col("doc_id").isin(ids)), "doc_id")
    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(measure, f"doc_id {kind}, x array<double>").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    rows = np.array(found.column("x").to_pylist())
    is_good = np.array([d in good for d in found.column("doc_id").to_pylist()])
    if is_good.all() or not is_good.any():
        return None
    cuts = np.stack([np.quantile(rows, q, axis=0) for q in np.linspace(0.01, 0.99, CUTS)], axis=1)
    x = _indicators(rows, cuts)
    rng = np.random.default_rng(17)
    better = rng.choice(np.flatnonzero(is_good), PAIRS)
    worse = rng.choice(np.flatnonzero(~is_good), PAIRS)
    w = fit_pairs(x, better, worse)
    raw = x @ w
    model = Model(cuts, w, 0.0, float(raw.std()) / 2 or 1.0)
    return replace(model, threshold=_threshold(docs.where(usable), marked, model, sizes[False] / (sizes[True] + sizes[False])))


def with_scores(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column`` and score (double) of every row; without a model every score is GOOD. A null text is empty."""
    slim = docs.select(F.col(text).alias("text"), F.col(id_column).alias("id"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(0).to_pylist()
            made = np.full(len(texts), GOOD)
            if model is not None and texts:
                made = model.score(np.array([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made)], ["id", "score"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(add, f"id {kind}, score double").withColumnRenamed("id", id_column)
