"""Text to vectors, and averages of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagedex.functions.text import as_text

ENCODE_BATCH = 64

# Rows whose texts a task holds as Python strings, and sorts by length, at a time.
ROWS_AT_ONCE = 1024

Encoder = Callable[[list[str]], np.ndarray]


def embed(
    df: DataFrame,
    key: str,
    column: str,
    encoder: Callable[[], Encoder],
    batch_size: int = ENCODE_BATCH,
) -> DataFrame:
    """(key, embedding) for a column of texts or word lists.

    The encoder is made once per task and fed `batch_size` whole texts at a time,
    texts of like length together, so that a model pads little.
    """
    schema = T.StructType(
        [df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                texts = batch.column(1).to_pylist()
                by_length = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
                rows: list = [None] * len(texts)
                for at in range(0, len(texts), batch_size):
                    places = by_length[at : at + batch_size]
                    made = np.asarray(encode([texts[i] for i in places]), dtype="float32")
                    for place, row in zip(places, made, strict=True):
                        rows[place] = row
                vectors = pa.array(rows, type=pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), vectors], names=[key, "embedding"]
                )

    return df.select(key, as_text(df, column).alias("text")).mapInArrow(run, schema)


def mean_pool(df: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """Element-wise mean of all vectors of a key, in position order.

    Sums are combined before the shuffle, so a key owning a third of all
    vectors costs one partial row per position and task.
    """
    means = (
        df.select(key, F.posexplode(column).alias("pos", "value"))
        .groupBy(key, "pos")
        .agg(F.avg(F.col("value").cast("double")).alias("value"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return means.groupBy(key).agg(F.transform(ordered, lambda p: p["value"]).alias(column))
