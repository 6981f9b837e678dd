"""A training corpus from ``documents``: filter, deduplicate, mask secrets, mix, tokenize."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.llm import mixing, secrets, sentencepiece, simhash, toxicity
from snapgrid.llm.common import read_table
from snapgrid.session import stage_table

#: A public model file; only the driver opens it.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from the labels of what is in ``docs``."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (three-word shingles, three bits)."""
    return simhash.drop_near_duplicates(docs, distance=3, shingle=3)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each pass over a document, the last one cut where the share ends."""
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of each row."""
    return sentencepiece.encode(docs, sentencepiece.load_model(PIECES), keep=("doc_id", "source"))


STAGES = [
    ("toxicity", clean),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", masked),
    ("mixing sources", mixed),
    ("sentencepiece encoding", tokenized),
]

#: Trained models and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole table, each written before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
