"""Folder to index, file by file, as a restartable stream.

The stream is one of files, and its checkpoint is the list of those already
taken. A file that cannot be read is set aside by its path and ends nothing.
Every batch is parsed once into `articles/batch_id=N` and indexed from there; a batch that is
retried after a failure overwrites its own folders.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagedex.operators.passages import flatten_articles
from passagedex.plans.lexical import LexicalIndex, create_index, open_index, shards_for
from passagedex.sources import articles as A
from passagedex.sources import storage

FILE = T.StructType(
    [
        T.StructField("rel_path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


def ingest_folder(
    spark: SparkSession,
    source: str,
    index_path: str,
    mode: str = "append",
    glob: str = A.LINES_GLOB,
    multi_line: bool = False,
    max_files_per_batch: int | None = 1000,
    publish_each_batch: bool = False,
) -> LexicalIndex:
    """Index all files not seen before, then publish; run again for new files.

    A batch takes 1,000 files at most unless told otherwise, so a failure costs
    no more than one batch. Publishing each batch makes it searchable at once, at the price of merging
    the vocabulary every time.

    `rebuild` starts a new generation, forgetting both the index and the list
    of processed files. A shard count is fixed when a generation starts.
    """
    storage.require(spark, source, "article folder")
    try:
        index = None if mode == "rebuild" else open_index(spark, index_path)
    except FileNotFoundError:
        index = None
    if index is None:
        size = storage.total_bytes(spark, source)
        index = create_index(spark, index_path, shards_for(size))

    def take(batch: DataFrame, batch_id: int) -> None:
        number = index.claim_batch(f"stream-{batch_id}")
        if number in index.corpus["batches"]:
            return
        folder = f"{index.root}/articles/batch_id={number}"
        # One row per file, and files per batch are limited.
        rows = batch.select("path", "rel_path").collect()
        paths = {r["rel_path"]: r["path"] for r in rows}
        faults = _save_sound(spark, source, list(paths.values()), glob, multi_line, folder)
        # Some damage gives no error, only no records.
        saved = A.load_articles(spark, folder).select("rel_path").distinct()
        silent = batch.select("rel_path").join(saved, "rel_path", "left_anti").collect()
        unread = [p for p in (paths[r["rel_path"]] for r in silent) if p not in faults]
        if unread:
            faults |= {r["path"]: r["error"] for r in A.damaged_files(spark, unread).collect()}
        errors = spark.createDataFrame(list(faults.items()), "path string, error string")
        files = batch.join(F.broadcast(errors), "path", "left").select(*FILE.names)
        files.write.mode("overwrite").parquet(f"{index.root}/files/batch_id={number}")
        good = A.usable(A.load_articles(spark, folder))
        index.write_batch(flatten_articles(good), number)
        if publish_each_batch:
            index.publish()

    stream = A.stream_files(spark, source, glob, max_files_per_batch)
    query = (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{index.root}/ledger")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return index.publish()


def _save_sound(
    spark: SparkSession, source: str, paths: list[str], glob: str, multi_line: bool, folder: str
) -> dict[str, str]:
    """Save the articles of all files that can be read; the others with their errors.

    Files are probed only when reading them failed. Nothing is taken from such a
    file, so that a sound copy can come later under another name.
    """
    rows = A.read_articles_of(spark, source, paths, glob, multi_line)
    try:
        A.save_articles(rows, folder, by_source_dir=False)
        return {}
    except (PySparkException, Py4JJavaError):
        faults = {r["path"]: r["error"] for r in A.damaged_files(spark, paths).collect()}
        if not faults:
            raise
    sound = [p for p in paths if p not in faults]
    rows = A.read_articles_of(spark, source, sound, glob, multi_line)
    A.save_articles(rows, folder, by_source_dir=False)
    return faults


def ingested_articles(index: LexicalIndex) -> DataFrame:
    """Everything parsed so far, usable or not."""
    folder = f"{index.root}/articles"
    storage.require(index.spark, folder, "ingested articles")
    return A.load_articles(index.spark, folder)


def quarantine(index: LexicalIndex) -> DataFrame:
    """Records that could not be used, with the raw line where parsing failed."""
    return A.quarantined(ingested_articles(index))


def taken_files(index: LexicalIndex) -> DataFrame:
    """(rel_path, length, error, batch_id) of every file taken, with or without records.

    `error` tells why nothing was read from a damaged file; it is null for the others.
    """
    folder = f"{index.root}/files"
    storage.require(index.spark, folder, "taken files")
    return index.spark.read.schema(T.StructType([*FILE.fields, T.StructField("batch_id", T.IntegerType())])).parquet(folder)


def processed_files(index: LexicalIndex) -> DataFrame:
    """Relative paths of all files taken so far."""
    return taken_files(index).select("rel_path").distinct()


def damaged(index: LexicalIndex) -> DataFrame:
    """Files set aside because they could not be read, with the error."""
    return taken_files(index).where("error IS NOT NULL")


def progress(index: LexicalIndex) -> DataFrame:
    """Passages per batch, in the order batches were indexed."""
    return index.batches().select("batch_id", F.col("n_passages"))
