"""Paths on whatever file system the cluster shares (local disk in tests)."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Spark's stand-in for the size of data it knows nothing about.
UNKNOWN_BYTES = 2**60


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate data.

    Without one, a scratch folder in local mode, as in tests, and an error on a
    cluster, where executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return tempfile.mkdtemp(prefix="passagedex-")


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _locate(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, location


def exists(spark: SparkSession, path: str) -> bool:
    system, location = _locate(spark, path)
    return system.exists(location)


def require(spark: SparkSession, path: str, what: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(f"{what} not found: {path}")


def children(spark: SparkSession, path: str) -> list[str]:
    system, location = _locate(spark, path)
    if not system.exists(location):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(location))


def make_folder(spark: SparkSession, path: str) -> None:
    system, location = _locate(spark, path)
    system.mkdirs(location)


def save_json(spark: SparkSession, path: str, values: dict) -> None:
    """A small file of settings, in place only once it is complete."""
    system, target = _locate(spark, path)
    _, draft = _locate(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp")
    stream = system.create(draft, True)
    stream.write(bytearray(json.dumps(values).encode()))
    stream.close()
    system.delete(target, False)
    system.rename(draft, target)


def create_json(spark: SparkSession, path: str, values: dict) -> bool:
    """Create a small file unless there is one; False if another writer was first."""
    system, target = _locate(spark, path)
    system.mkdirs(target.getParent())
    try:
        stream = system.create(target, False)
    except Py4JJavaError as error:
        if exists(spark, path):
            return False
        raise error
    stream.write(bytearray(json.dumps(values).encode()))
    stream.close()
    return True


def load_json(spark: SparkSession, path: str) -> dict:
    """A small file of settings; one that is being created is waited for."""
    system, location = _locate(spark, path)
    for attempt in range(50):
        stream = system.open(location)
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if text:
            break
        time.sleep(0.02 * (attempt + 1))
    return json.loads(text)


def save_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file of given bytes."""
    system, target = _locate(spark, path)
    stream = system.create(target, True)
    stream.write(bytearray(content))
    stream.close()


def total_bytes(spark: SparkSession, path: str) -> int:
    system, location = _locate(spark, path)
    return system.getContentSummary(location).getLength()


def input_bytes(df: DataFrame) -> int | None:
    """Size of the files behind a DataFrame as the optimizer knows it, or None."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(size >= UNKNOWN_BYTES for size in sizes) else sum(sizes)


def plain_path(spark: SparkSession, path: str) -> str:
    """Absolute path without scheme and host, as it appears inside a file URI."""
    system, location = _locate(spark, path)
    return system.makeQualified(location).toUri().getPath().rstrip("/")
