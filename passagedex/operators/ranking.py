"""Query terms, scores and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagedex.functions import text as X


def require_positive(k: int) -> None:
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")


def one_query(spark: SparkSession, query: str | list[str]) -> DataFrame:
    """A single query, text or list of words, as a table of queries."""
    if isinstance(query, str):
        return spark.createDataFrame([("q", query)], "query_id string, text string")
    schema = "query_id string, tokens array<string>, text string"
    return spark.createDataFrame([("q", list(query), " ".join(query))], schema)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) from a `text` column or a ready `tokens` column."""
    words = F.col("tokens") if "tokens" in queries.columns else X.query_tokens(F.col("text"))
    exploded = queries.select("query_id", F.explode(words).alias("term"))
    return exploded.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def top_k(scored: DataFrame, k: int, best: Column, tie: str = "doc_key") -> DataFrame:
    """First k rows per query. Partitions cut to k rows each before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(best, F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
