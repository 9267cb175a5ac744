"""The vector index: embeddings with their passage records, searched exactly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagedex.functions.text import formatted_passage
from passagedex.operators.embedding import Encoder, embed
from passagedex.operators.neighbours import nearest
from passagedex.operators.ranking import one_query
from passagedex.schemas import RECORD_FIELDS
from passagedex.session import cut_lineage
from passagedex.sources import storage

PUSHDOWN_VALUES = 1000


class VectorIndex:
    """Parquet folders `vectors` (doc_key, embedding) and `records`.

    With an encoder the index answers texts by itself.
    """

    def __init__(
        self, spark: SparkSession, path: str, encoder: Callable[[], Encoder] | None = None
    ):
        self.encoder = encoder
        self.spark = spark
        self.path = path.rstrip("/")
        settings = storage.load_json(spark, f"{self.path}/settings.json")
        self.dimension: int = settings["dimension"]
        self.n_vectors: int = settings["n_vectors"]

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records")

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Nearest vectors for (query_id, embedding) rows."""
        return nearest(self.vectors(), queries, k)

    def document_count(self) -> int:
        return self.n_vectors

    def retrieve(
        self, queries: DataFrame, k: int = 5, encoder: Callable[[], Encoder] | None = None
    ) -> DataFrame:
        """Nearest passages for (query_id, text) rows, as display text."""
        encoder = encoder or self.encoder
        if encoder is None:
            raise ValueError("texts need an encoder; open the index with one")
        # Written once: the search reads the queries more than once.
        encoded = cut_lineage(embed(queries, "query_id", "text", encoder))
        return self.formatted(self.search(encoded, k))

    def retrieve_one(self, query: str | list[str], k: int = 5) -> DataFrame:
        """Nearest passages for a single query given as text or as a list of words."""
        return self.retrieve(one_query(self.spark, query), k)

    def formatted(self, hits: DataFrame) -> DataFrame:
        fixed = cut_lineage(hits)
        records = self.records()
        keys = [r[0] for r in fixed.select("doc_key").distinct().take(PUSHDOWN_VALUES + 1)]
        if len(keys) <= PUSHDOWN_VALUES:
            records = records.where(F.col("doc_key").isin(keys))
        shown = formatted_passage(
            F.col("type"), F.col("title"), F.col("text"), F.struct(*RECORD_FIELDS)
        )
        return fixed.join(records, "doc_key").select(
            "query_id", "rank", "distance", "doc_key", shown.alias("result")
        )


def save_vectors(
    vectors: DataFrame,
    records: DataFrame,
    path: str,
    encoder: Callable[[], Encoder] | None = None,
) -> VectorIndex:
    """Store embeddings and records; all vectors must have one dimension."""
    spark = vectors.sparkSession
    root = path.rstrip("/")
    vectors.select("doc_key", "embedding").write.parquet(f"{root}/vectors")
    (
        records.select("doc_key", *RECORD_FIELDS)
        .repartitionByRange("doc_key")
        .sortWithinPartitions("doc_key")
        .write.parquet(f"{root}/records")
    )
    size = F.size("embedding")
    found = (
        spark.read.parquet(f"{root}/vectors")
        .agg(F.min(size), F.max(size), F.count(F.lit(1)), F.count("embedding"))
        .first()
    )
    if found[0] != found[1] or found[2] != found[3]:
        raise ValueError(f"vectors of different dimensions: {found[0]} to {found[1]}")
    settings = {"dimension": found[1] or 0, "n_vectors": found[2]}
    storage.save_json(spark, f"{root}/settings.json", settings)
    return VectorIndex(spark, root, encoder)


def build_vector_index(
    spark: SparkSession, passages: DataFrame, path: str, encoder: Callable[[], Encoder]
) -> VectorIndex:
    return save_vectors(embed(passages, "doc_key", "text", encoder), passages, path, encoder)


def open_vector_index(
    spark: SparkSession, path: str, encoder: Callable[[], Encoder] | None = None
) -> VectorIndex:
    storage.require(spark, f"{path.rstrip('/')}/settings.json", "vector index")
    return VectorIndex(spark, path, encoder)
