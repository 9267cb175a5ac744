"""Named queries over the test tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagedex import adapters
from passagedex.functions import bm25
from passagedex.functions import text as X
from passagedex.functions import vectors as V
from passagedex.functions.encoders import HashedWords, pooled
from passagedex.operators import embedding, passages, ranking, statistics
from passagedex.operators.neighbours import Sizes, nearest
from passagedex.plans.dense import build_vector_index, open_vector_index, save_vectors
from passagedex.plans.lexical import (
    LexicalIndex,
    build_index,
    detokenized,
    open_index,
    rebuild_from_passages,
)
from passagedex.sources import articles as A
from passagedex.sources import storage
from passagedex.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

ONE_QUERY = "What is the name and the place of that?"

_shared: dict[tuple[str, str, str], str] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _once(spark: SparkSession, sf_dir: str, label: str, make: Callable[[str], object]) -> str:
    """A folder made once per application and test table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    path = _shared.get(key)
    if path is None or not storage.exists(spark, path):
        path = storage.fresh_folder(spark, label)
        make(path)
        _shared[key] = path
    return path


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.articles(adapters.documents(spark, sf_dir))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.flatten_articles(_articles(spark, sf_dir))


def _index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    path = _once(
        spark, sf_dir, "index", lambda p: build_index(spark, _passages(spark, sf_dir), p)
    )
    return open_index(spark, path)


def _rounded(column: str) -> Column:
    return F.round(column, 4).alias(column)


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", _rounded("score"), "doc_key")


# ---------------------------------------------------------------- text


@registered
def normalize_text(spark, sf_dir):
    return adapters.documents(spark, sf_dir).select(
        "doc_id", X.normalize(F.col("text")).alias("text")
    )


@registered
def tokenize(spark, sf_dir):
    return adapters.documents(spark, sf_dir).select(
        "doc_id", F.posexplode(X.tokens(F.col("text"))).alias("pos", "token")
    )


@registered
def detokenize(spark, sf_dir):
    return adapters.documents(spark, sf_dir).select(
        "doc_id", X.detokenize(X.tokens(F.col("text"))).alias("text")
    )


@registered
def preview(spark, sf_dir):
    return adapters.documents(spark, sf_dir).select(
        "doc_id", X.preview(F.col("text")).alias("preview")
    )


@registered
def strip_anchors(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", X.strip_links(F.col("html")).alias("text"))


# ---------------------------------------------------------------- passages


@registered
def title_passages(spark, sf_dir):
    return passages.title_rows(_articles(spark, sf_dir)).drop("rel_path")


@registered
def paragraph_passages(spark, sf_dir):
    return passages.paragraph_rows(_articles(spark, sf_dir)).drop("rel_path")


@registered
def flatten_passages(spark, sf_dir):
    return _passages(spark, sf_dir).drop("rel_path")


@registered
def format_passage(spark, sf_dir):
    record = F.struct("id", "type", "text", "title")
    shown = X.formatted_passage(F.col("type"), F.col("title"), F.col("text"), record)
    return _passages(spark, sf_dir).select("doc_key", shown.alias("result"))


# ---------------------------------------------------------------- statistics


@registered
def doc_lengths(spark, sf_dir):
    return statistics.with_length(_passages(spark, sf_dir)).select("doc_key", "doc_len")


@registered
def corpus_stats(spark, sf_dir):
    totals = statistics.corpus_totals(_passages(spark, sf_dir))
    return totals.select("n_docs", "total_len", F.round("avgdl", 6).alias("avgdl"))


@registered
def term_frequencies(spark, sf_dir):
    return statistics.term_frequencies(_passages(spark, sf_dir))


@registered
def document_frequencies(spark, sf_dir):
    return statistics.document_frequencies(
        statistics.term_frequencies(_passages(spark, sf_dir))
    )


@registered
def bm25_idf(spark, sf_dir):
    stats = _index(spark, sf_dir).term_stats()
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@registered
def bm25_weights(spark, sf_dir):
    weights = _index(spark, sf_dir).weights()
    return weights.select("term", "doc_key", F.round("weight", 6).alias("weight"))


@registered
def index_statistics(spark, sf_dir):
    stats = _index(spark, sf_dir).statistics()
    return stats.withColumn(
        "average_document_length", F.round("average_document_length", 6)
    )


# ---------------------------------------------------------------- search


@registered
def query_terms(spark, sf_dir):
    return ranking.query_terms(adapters.queries(spark, sf_dir))


@registered
def bm25_scores(spark, sf_dir):
    scored = _index(spark, sf_dir).scores(adapters.queries(spark, sf_dir))
    score = bm25.rounded_units(F.col("units"))
    return scored.select("query_id", "doc_key", score.alias("score"))


@registered
def bm25_top1query(spark, sf_dir):
    hits = _index(spark, sf_dir).search_one(ONE_QUERY, 10)
    return _hits(hits).drop("query_id")


@registered
def bm25_topk(spark, sf_dir):
    return _hits(_index(spark, sf_dir).search(adapters.queries(spark, sf_dir), 10))


@registered
def bm25_topk_records(spark, sf_dir):
    index = _index(spark, sf_dir)
    found = index.records(index.search(adapters.queries(spark, sf_dir), 5))
    return found.select(
        "query_id",
        "rank",
        _rounded("score"),
        detokenized(F.col("document")).alias("document"),
        "metadata.*",
    )


@registered
def bm25_formatted(spark, sf_dir):
    found = _index(spark, sf_dir).retrieve(adapters.queries(spark, sf_dir), 5)
    return found.withColumn("score", _rounded("score"))


@registered
def bm25_topk_padded(spark, sf_dir):
    """Benchmark texts, plus page addresses: words no passage contains."""
    asked = adapters.queries(spark, sf_dir).select(
        F.concat(F.lit("text-"), F.col("query_id")).alias("query_id"), "text"
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.concat(F.lit("page-"), F.col("page_id")).alias("query_id"), F.col("url").alias("text")
    )
    return _hits(_index(spark, sf_dir).search(asked.unionByName(pages), 10))


@registered
def bm25_topk_pruned(spark, sf_dir):
    """Score floors and passage candidates, as for batches over very many postings."""
    index = _index(spark, sf_dir)
    index.direct_postings, index.worth_pruning = 0, 1.0
    return _hits(index.search(adapters.queries(spark, sf_dir), 10))


@registered
def bm25_topk_blocks(spark, sf_dir):
    """Queries in blocks, as when their terms are too many for one broadcast."""
    index = _index(spark, sf_dir)
    index.broadcast_rows = 100
    return _hits(index.search(adapters.queries(spark, sf_dir), 10))


@registered
def bm25_topk_negative_mean(spark, sf_dir):
    """Every document described by words most of them share, asked for by parts of that."""
    docs = adapters.documents(spark, sf_dir)
    long = F.when(F.col("n_chars") > 1000, " of length").otherwise("")
    described = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("document in language "), "lang", long).alias("title"),
        F.array().cast("array<array<string>>").alias("text"),
        F.lit("documents").alias("rel_path"),
    )
    path = _once(
        spark,
        sf_dir,
        "described",
        lambda p: build_index(spark, passages.flatten_articles(described), p),
    )
    languages = docs.select("lang").distinct()
    asked = languages.select(
        F.explode(
            F.array(
                *[
                    F.concat(F.lit(words), "lang")
                    for words in ("", "length ", "document ", "documents written in ", "no-")
                ]
            )
        ).alias("text")
    )
    asked = asked.select(F.col("text").alias("query_id"), "text")
    return _hits(open_index(spark, path).search(asked, 10))


# ---------------------------------------------------------------- persistence


@registered
def index_roundtrip(spark, sf_dir):
    path = storage.fresh_folder(spark, "roundtrip")
    build_index(spark, _passages(spark, sf_dir), path)
    return _hits(open_index(spark, path).search(adapters.queries(spark, sf_dir), 10))


@registered
def index_rebuild_from_passages(spark, sf_dir):
    stored = _once(
        spark, sf_dir, "index", lambda p: build_index(spark, _passages(spark, sf_dir), p)
    )
    index = rebuild_from_passages(spark, stored, storage.fresh_folder(spark, "rebuilt"))
    stats = index.term_stats()
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@registered
def index_append(spark, sf_dir):
    """English articles first, the others appended."""
    docs = adapters.documents(spark, sf_dir)
    english = F.col("lang") == "en"
    path = storage.fresh_folder(spark, "append")
    for mode, part in (("rebuild", docs.where(english)), ("append", docs.where(~english))):
        build_index(spark, passages.flatten_articles(adapters.articles(part)), path, mode)
    index = open_index(spark, path)
    found = index.records(index.search(adapters.queries(spark, sf_dir), 10))
    return found.select("query_id", "rank", _rounded("score"), "metadata.id", "metadata.text")


# ---------------------------------------------------------------- sources


def _write_lines(docs: DataFrame, folder: str) -> None:
    rows = adapters.articles(docs).select("id", "title", "text", "source")
    rows.write.partitionBy("source").option("compression", "bzip2").json(folder)


def _dump(spark: SparkSession, sf_dir: str) -> str:
    return _once(
        spark, sf_dir, "dump", lambda p: _write_lines(adapters.documents(spark, sf_dir), p)
    )


def _joined_text() -> Column:
    return F.array_join(F.transform("text", lambda par: F.array_join(par, "|")), "\n")


@registered
def scan_bz2_jsonl(spark, sf_dir):
    rows = A.read_article_lines(spark, _dump(spark, sf_dir))
    return rows.select("rel_dir", "id", "title", _joined_text().alias("text"))


@registered
def scan_json_arrays(spark, sf_dir):
    """Arrays of some 64 articles, one per file."""

    def write(folder: str) -> None:
        rows = _articles(spark, sf_dir)
        n_files = max(1, -(-rows.count() // 64))
        line = F.to_json(F.struct("id", "title", "text"))
        (
            rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_files)).alias("file"))
            .agg(F.array_join(F.collect_list(line), ",\n").alias("items"))
            .select(F.concat(F.lit("[\n"), "items", F.lit("\n]")).alias("value"))
            .write.option("maxRecordsPerFile", 1)
            .text(folder)
        )

    folder = _once(spark, sf_dir, "arrays", write)
    rows = A.read_article_arrays(spark, folder, "*.txt")
    return rows.select("id", "title", _joined_text().alias("text"))


@registered
def scan_indented_arrays(spark, sf_dir):
    """Arrays of some 500 articles, elements indented by two: read in splits."""

    def write(folder: str) -> None:
        rows = _articles(spark, sf_dir)
        n_files = max(1, -(-rows.count() // 500))
        pairs = []
        for name in ("id", "title", "text"):
            pair = F.to_json(F.struct(name))
            pairs.append(F.substring(pair, F.lit(2), F.length(pair) - 2))
        inside = F.concat_ws(",\n    ", *pairs)
        element = F.concat(F.lit("  {\n    "), inside, F.lit("\n  }"))
        (
            rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_files)).alias("file"))
            .agg(F.array_join(F.collect_list(element), ",\n").alias("items"))
            .select(F.concat(F.lit("[\n"), "items", F.lit("\n]")).alias("value"))
            .write.option("maxRecordsPerFile", 1)
            .text(folder)
        )

    folder = _once(spark, sf_dir, "indented", write)
    rows = A.read_article_arrays(spark, folder, "*.txt")
    return rows.select("id", "title", _joined_text().alias("text"))


@registered
def quarantine_malformed(spark, sf_dir):
    """German articles cut short, French ones with bare strings as paragraphs."""

    def write(folder: str) -> None:
        rows = adapters.articles(adapters.documents(spark, sf_dir))
        whole = F.to_json(F.struct("id", "title", "text"))
        cut = F.expr("substring(whole, 1, length(whole) - 2)")
        flat = F.to_json(F.struct("id", "title", F.array(F.col("title")).alias("text")))
        value = F.when(F.col("lang") == "de", cut).when(F.col("lang") == "fr", flat)
        (
            rows.withColumn("whole", whole)
            .select(value.otherwise(F.col("whole")).alias("value"), "source")
            .write.partitionBy("source")
            .option("compression", "bzip2")
            .text(folder)
        )

    folder = _once(spark, sf_dir, "malformed", write)
    saved = storage.fresh_folder(spark, "parsed")
    A.save_articles(A.read_article_lines(spark, folder), saved)
    rows = A.load_articles(spark, saved)
    good = A.usable(rows).select("rel_dir", F.lit("usable").alias("state"), F.col("id"))
    bad = A.quarantined(rows).select(
        "rel_dir", F.lit("quarantined").alias("state"), F.lit(None).cast("string").alias("id")
    )
    return (
        good.unionByName(bad)
        .groupBy("rel_dir", "state")
        .agg(
            F.count(F.lit(1)).alias("n_articles"),
            F.coalesce(F.sum(F.col("id").cast("bigint")), F.lit(0)).alias("id_sum"),
        )
    )


@registered
def ingest_by_source_dir(spark, sf_dir):
    saved = storage.fresh_folder(spark, "saved")
    A.save_articles(A.read_article_lines(spark, _dump(spark, sf_dir)), saved)
    return A.usable(A.load_articles(spark, saved)).select("rel_dir", "id", "title")


@registered
def passages_per_file(spark, sf_dir):
    """Summed up to folders; the row without a folder is the total."""
    rows = A.read_article_lines(spark, _dump(spark, sf_dir))
    per_file = passages.passages_per_file(passages.flatten_articles(rows))
    folder = F.regexp_replace("rel_path", r"/?[^/]*$", "")
    return per_file.groupBy(folder.alias("rel_dir")).agg(F.sum("n_passages").alias("n_passages"))


# ---------------------------------------------------------------- stream


def _two_rounds(spark: SparkSession, sf_dir: str, between: Callable[[str], None]) -> str:
    """A folder filled in two rounds: English articles, then the others."""
    docs = adapters.documents(spark, sf_dir)
    english = F.col("lang") == "en"
    folder = storage.fresh_folder(spark, "rounds")
    _write_lines(docs.where(english), f"{folder}/first")
    between(folder)
    _write_lines(docs.where(~english), f"{folder}/second")
    return folder


@registered
def incremental_files(spark, sf_dir):
    """Ingest after each round, and once more with nothing new."""
    path = storage.fresh_folder(spark, "streamed")
    folder = _two_rounds(spark, sf_dir, lambda f: ingest.ingest_folder(spark, f, path))
    ingest.ingest_folder(spark, folder, path)
    index = ingest.ingest_folder(spark, folder, path)
    return ingest.progress(index)


@registered
def quarantine_damaged_files(spark, sf_dir):
    """A dump whose French file is cut in half, and a restart once a whole one is there."""
    docs = adapters.documents(spark, sf_dir)
    french = F.col("lang") == "fr"
    folder, path = storage.fresh_folder(spark, "damaged"), storage.fresh_folder(spark, "streamed")
    apart = storage.fresh_folder(spark, "whole")
    _write_lines(docs.where(french), apart)
    _write_lines(docs.where(~french), f"{folder}/sound")
    # One task's file of one source; no other content is read.
    longest = A.list_files(spark, apart, A.LINES_GLOB).orderBy(F.desc("length"), "rel_path").first()
    compressed = A.file_bytes(spark, f"{apart}/{longest['rel_path']}")
    storage.save_bytes(spark, f"{folder}/french.bz2", compressed[: len(compressed) // 2])
    ingest.ingest_folder(spark, folder, path)
    _write_lines(docs.where(french), f"{folder}/french")
    index = ingest.ingest_folder(spark, folder, path)
    broken = ingest.damaged(index).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_damaged"))
    return (
        ingest.progress(index)
        .join(broken, "batch_id", "left")
        .select("batch_id", "n_passages", F.coalesce("n_damaged", F.lit(0)).alias("n_damaged"))
    )


@registered
def new_files_anti(spark, sf_dir):
    seen: dict[str, DataFrame] = {}
    saved = storage.fresh_folder(spark, "ledger")

    def remember(folder: str) -> None:
        A.list_files(spark, folder, A.LINES_GLOB).write.parquet(saved)
        seen["files"] = spark.read.parquet(saved)

    folder = _two_rounds(spark, sf_dir, remember)
    fresh = A.files_not_in(A.list_files(spark, folder, A.LINES_GLOB), seen["files"])
    return fresh.select("rel_dir").distinct()


# ---------------------------------------------------------------- vectors


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _value_rows(df: DataFrame, key: str) -> DataFrame:
    values = df.select(key, F.posexplode("embedding").alias("pos", "value"))
    return values.withColumn("value", F.round(F.col("value").cast("double"), 6))


@registered
def l2_distance(spark, sf_dir):
    """Each vector against the next one in number."""
    table = _embeddings(spark, sf_dir)
    left = table.select("vec_id", "embedding")
    right = table.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    gap = V.l2_distance(F.col("embedding"), F.col("other"))
    return left.join(right, "vec_id").select("vec_id", F.round(gap, 6).alias("distance"))


@registered
def knn_l2_topk(spark, sf_dir):
    """Every vector asks for its five nearest, itself included."""
    table = _embeddings(spark, sf_dir)
    vectors = table.select(F.col("vec_id").alias("doc_key"), "embedding")
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(vectors, asked, 5).withColumn("distance", F.round("distance", 4))


@registered
def knn_blocks(spark, sf_dir):
    """The same cell by cell, as for more queries than a broadcast holds."""
    table = _embeddings(spark, sf_dir)
    vectors = table.select(F.col("vec_id").alias("doc_key"), "embedding")
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding")
    sizes = Sizes(broadcast=0, block=1 << 16, slice=1 << 16)
    return nearest(vectors, asked, 5, sizes).withColumn("distance", F.round("distance", 4))


@registered
def knn_formatted(spark, sf_dir):
    """Benchmark texts encoded and answered from encoded passages."""
    path = _once(
        spark,
        sf_dir,
        "dense",
        lambda p: build_vector_index(spark, _passages(spark, sf_dir), p, HashedWords),
    )
    index = open_vector_index(spark, path, HashedWords)
    found = index.retrieve(adapters.queries(spark, sf_dir), 5)
    return found.withColumn("distance", F.round("distance", 4))


@registered
def vectors_roundtrip(spark, sf_dir):
    table = _embeddings(spark, sf_dir).withColumn("doc_key", F.col("vec_id"))
    records = table.select(
        "doc_key",
        F.col("vec_id").cast("string").alias("id"),
        F.lit("vector").alias("type"),
        F.col("label").cast("string").alias("text"),
        F.lit(None).cast("string").alias("title"),
    )
    path = storage.fresh_folder(spark, "vectors")
    save_vectors(table, records, path)
    index = open_vector_index(spark, path)
    rows = _value_rows(index.vectors(), "doc_key")
    return rows.join(index.records().select("doc_key", "text"), "doc_key").withColumn(
        "dimension", F.lit(index.dimension)
    )


@registered
def mean_pool(spark, sf_dir):
    return _value_rows(embedding.mean_pool(_embeddings(spark, sf_dir), "label"), "label")


@registered
def embed_corpus(spark, sf_dir):
    docs = adapters.documents(spark, sf_dir)
    return _value_rows(embedding.embed(docs, "doc_id", "text", HashedWords), "doc_id")


def _word_vectors():
    """A model whose tokens are lower-case words; rows are padded to the longest."""
    words = HashedWords()

    def tokens_of(texts: list[str], max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
        split = [text.lower().split(None, max_tokens)[:max_tokens] for text in texts]
        width = max(1, *map(len, split))
        hidden = np.zeros((len(texts), width, words.dimension))
        mask = np.zeros((len(texts), width), dtype=int)
        for row, found in enumerate(split):
            mask[row, : len(found)] = 1
            for place, word in enumerate(found):
                hidden[row, place] = words([word])[0]
        return hidden, mask

    return tokens_of


@registered
def embed_pooled(spark, sf_dir):
    """Documents as the mean of their first 32 token vectors."""
    docs = adapters.documents(spark, sf_dir)
    return _value_rows(embedding.embed(docs, "doc_id", "text", pooled(_word_vectors, 32)), "doc_id")
