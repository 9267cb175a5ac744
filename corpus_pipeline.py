"""From raw documents to the shards of a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagedex.llm.common import column, unused
from passagedex.llm.decontaminate import drop_contaminated
from passagedex.llm.line_quality import clean_lines
from passagedex.llm.mixing import mix_sources
from passagedex.llm.near_dedup import keep_one_each
from passagedex.llm.sharding import shard_documents
from passagedex.sources.storage import fresh_folder

N_SHARDS = 8


def _recounted(docs: DataFrame) -> DataFrame:
    """The documents with n_chars as their texts now are."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are cut; documents that the rules reject go."""
    return _recounted(clean_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights; repeated documents are repeated rows."""
    shard = unused(docs, "mix_shard")
    return _recounted(mix_sources(docs, shard=shard).drop(shard))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard, of eight of nearly equal bytes, and its slot there.

    Where documents have a column of such a name already, it stays, and the new
    one has a number after its name.
    """
    place = unused(docs, "place")
    placed = shard_documents(docs, n_shards=N_SHARDS, place=place)
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        numbered = (f"{name}_{i}" for i in range(1, len(taken) + 2))
        return next(n for n in (name, *numbered) if n not in taken)

    made = [F.col(place)[c].alias(free(c)) for c in ("size", "shard", "slot")]
    return placed.select(*[column(docs, c) for c in docs.columns], *made)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# Near-duplicate components and bin packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table; each reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
