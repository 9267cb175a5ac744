"""Test tables as articles and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Give a table stored in very few row groups a partition per core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def articles(docs: DataFrame) -> DataFrame:
    """First line is the title, every other line a paragraph of sentences."""
    lines = F.split("text", "\n")
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return docs.select(
        F.lit("documents").alias("rel_path"),
        F.col("doc_id").cast("string").alias("id"),
        F.get(lines, F.lit(0)).alias("title"),
        F.transform(body, lambda line: F.split(line, r"\. ")).alias("text"),
        *[column for column in ("lang", "source") if column in docs.columns],
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return table.select(F.col("item_id").alias("query_id"), "text")
