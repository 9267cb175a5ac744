"""Corpus and term statistics behind the lexical index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagedex.functions import text as X


def with_length(passages: DataFrame) -> DataFrame:
    return passages.withColumn("doc_len", F.size(X.tokens(F.col("text"))))


def corpus_totals(passages: DataFrame) -> DataFrame:
    """One row; empty passages count, as they do in the average length."""
    sized = passages if "doc_len" in passages.columns else with_length(passages)
    return sized.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("doc_len"), F.lit(0)).cast("bigint").alias("total_len"),
        F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"),
    )


def index_statistics(passages: DataFrame) -> DataFrame:
    return corpus_totals(passages).select(
        F.col("n_docs").alias("document_count"),
        (F.col("n_docs") > 0).alias("has_index"),
        F.col("avgdl").alias("average_document_length"),
    )


def term_frequencies(passages: DataFrame) -> DataFrame:
    """Postings. Counted inside each row, so no shuffle however common a term is."""
    sized = passages if "doc_len" in passages.columns else with_length(passages)
    counts = F.explode(X.term_counts(X.tokens(F.col("text")))).alias("entry")
    return sized.select("doc_key", "doc_len", counts).select(
        "entry.term", "doc_key", "entry.tf", "doc_len"
    )


# Postings that one task joins with their terms' statistics.
POSTINGS_PER_TASK = 2_000_000


def document_frequencies(postings: DataFrame) -> DataFrame:
    """Postings are distinct per passage; map-side counts absorb common terms."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def hot_terms(term_stats: DataFrame, n_postings: int, share: int = 1000) -> DataFrame:
    """Terms owning more than 1/share of all postings: always fewer than `share` rows."""
    return term_stats.where(F.col("df") > F.lit(n_postings / share))


def join_term_stats(postings: DataFrame, term_stats: DataFrame, n_postings: int) -> DataFrame:
    """Postings with their term's statistics, safe for very common terms.

    Common terms are provably few and are joined by broadcast, never gathered;
    what is left has no heavy key and is shuffled by term, to more tasks the
    more postings there are.
    """
    hot = hot_terms(term_stats, n_postings)
    common = postings.join(F.broadcast(hot), "term")
    rest = postings.join(F.broadcast(hot.select("term")), "term", "left_anti")
    shuffled = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_tasks = max(shuffled, -(-n_postings // POSTINGS_PER_TASK))
    dealt = [side.repartition(n_tasks, "term") for side in (rest, term_stats)]
    return common.unionByName(dealt[0].join(dealt[1], "term"))
