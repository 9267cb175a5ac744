"""Session settings the jobs are tuned for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets a list of query terms or passage keys reach the Parquet page index
    # as equality tests; the default of 10 degrades longer lists to min/max.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "passagedex", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def file_splits(spark: SparkSession, n_bytes: int) -> AbstractContextManager[None]:
    """What is planned inside reads at most so many bytes of files in a task."""
    return _setting(spark, "spark.sql.files.maxPartitionBytes", str(n_bytes))


def open_files(spark: SparkSession, n_files: int) -> AbstractContextManager[None]:
    """What is written inside keeps its order: a task has the files of so many buckets open.

    Rows of further buckets are ordered by bucket first.
    """
    return _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(n_files))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder; survives lost executors."""
    from passagedex.sources.storage import shared_root

    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
