"""Matching causes and flag descriptions to a corpus of interventions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgrid.functions.text import FLAG_PHRASES, document_text, flag_text
from snapgrid.operators import text_index
from snapgrid.operators.evaluation import KS, mark_hits, precision_at_k
from snapgrid.operators.similarity import top_k_dense, top_k_sparse
from snapgrid.operators.vectors import encode, term_counts, term_frequencies, tf_idf_vectors
from snapgrid.session import stage_table

Encoder = Callable[[], Callable[[Sequence[str]], Sequence]]


def corpus_texts(
    corpus: DataFrame, doc_id: str = "Doc ID", title: str = "Title", keywords: str = "Keywords"
) -> DataFrame:
    """``doc_id, title, text`` of an intervention corpus."""
    return corpus.select(
        F.col(doc_id).try_cast("bigint").alias("doc_id"),
        F.trim(title).alias("title"),
        document_text(F.trim(title), F.trim(keywords)).alias("text"),
    )


def rank_documents(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    text: str = "text",
    encoder: Encoder | None = None,
    index: text_index.TextIndex | None = None,
) -> DataFrame:
    """``query_id, doc_id, sim, rank``: the k best documents for each query text.

    Without an encoder both sides become TF-IDF vectors with the document
    frequencies of the corpus. Each side is turned into vectors once and written.
    With an ``index`` of the corpus only what it cannot rule out is read, and the
    same rows come out.
    """
    if index is not None:
        return text_index.search(index, queries, k, query_id, text).withColumnRenamed(index.doc_id, doc_id)
    if encoder is not None:
        q = stage_table(encode(queries, query_id, text, encoder), "query_vectors")
        d = stage_table(encode(corpus, doc_id, text, encoder), "corpus_vectors")
        return top_k_dense(q, d, query_id, doc_id, "vector", "vector", k)
    corpus_counts = stage_table(term_counts(corpus, doc_id, text), "corpus_terms")
    query_counts = stage_table(term_counts(queries, query_id, text), "query_terms")
    frequencies = stage_table(term_frequencies(corpus_counts, query_counts), "frequencies")
    size = corpus.count()
    d = stage_table(tf_idf_vectors(corpus_counts, frequencies, size, doc_id), "corpus_vectors")
    q = stage_table(tf_idf_vectors(query_counts, frequencies, size, query_id), "query_vectors")
    return top_k_sparse(q, d, query_id, doc_id, k)


def best_documents(
    rows: DataFrame,
    text: str,
    corpus: DataFrame,
    out: str = "Top_Intervention",
    doc_id: str = "doc_id",
    title: str = "title",
    encoder: Encoder | None = None,
    index: text_index.TextIndex | None = None,
) -> DataFrame:
    """Add the title of the best document for the text of each row, and its score.

    Each distinct text is ranked once, under a digest that stands for it in the
    shuffles, and brought back to its rows.
    """
    keyed = rows.withColumn("_query", F.sha2(F.col(text), 256))
    queries = (
        rows.select(F.col(text).alias("text"))
        .dropna()
        .distinct()
        .withColumn("_query", F.sha2("text", 256))
    )
    best = (
        rank_documents(queries, corpus, 1, "_query", doc_id, "text", encoder, index)
        .join(corpus.select(doc_id, F.col(title).alias(out)), doc_id)
        .select("_query", out, "sim")
    )
    return keyed.join(best, "_query", "left").drop("_query")


def recommend_for_causes(
    predictions: DataFrame, corpus: DataFrame, encoder: Encoder | None = None, index: text_index.TextIndex | None = None
) -> DataFrame:
    """Predictions with the best intervention for the predicted cause."""
    return best_documents(predictions, "predicted_cause", corpus, encoder=encoder, index=index).drop("sim")


def master_table(rankings: DataFrame, recommended: DataFrame) -> DataFrame:
    """Ranking with the predicted cause and the intervention of each node."""
    chosen = recommended.select("NODEID", "predicted_cause", "Top_Intervention")
    return rankings.join(chosen, "NODEID", "left")


def flag_fixes(
    flagged: DataFrame,
    predictions: DataFrame,
    corpus: DataFrame,
    encoder: Encoder | None = None,
    out: str = "Predicted_Fix",
    index: text_index.TextIndex | None = None,
) -> DataFrame:
    """Flag table with the best intervention for each node's flags and cause."""
    causes = predictions.select("NODEID", "predicted_cause")
    described = flagged.join(causes, "NODEID", "left").withColumn(
        "_text", flag_text(F.col("predicted_cause"))
    )
    kept = [c for c in flagged.columns if c not in FLAG_PHRASES] + list(FLAG_PHRASES)
    return best_documents(described, "_text", corpus, out, encoder=encoder, index=index).select(*kept, out)


def evaluate_causes(
    predictions: DataFrame,
    corpus: DataFrame,
    truth: DataFrame,
    ks: Sequence[int] = KS,
    encoder: Encoder | None = None,
    index: text_index.TextIndex | None = None,
) -> DataFrame:
    """Precision at k of the interventions for each distinct predicted cause.

    ``truth`` has one row per ``predicted_cause`` and accepted ``title``.
    """
    queries = (
        predictions.select(F.col("predicted_cause").alias("query_id"))
        .dropna()
        .dropDuplicates()
        .withColumn("text", F.col("query_id"))
    )
    ranked = rank_documents(queries, corpus, max(ks), encoder=encoder, index=index)
    titled = ranked.join(corpus.select("doc_id", "title"), "doc_id").withColumnRenamed(
        "query_id", "predicted_cause"
    )
    return precision_at_k(
        mark_hits(titled, truth, "predicted_cause", "title"), "predicted_cause", ks=ks
    )
