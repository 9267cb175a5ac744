"""Small helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagedex.sources.storage import fresh_folder

# White space that separates words, and the characters of a word.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def unused(df: DataFrame, label: str) -> str:
    """A column name that no column of the table has, whatever its case."""
    taken = {name.lower() for name in df.columns}
    name, n = f"_{label}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{label}_{n}"
    return name


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def whole(text: Column) -> Column:
    """A text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def word_list(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(word_list(text)).cast("long")


class Scratch:
    """Compressed tables of one job in the shared folder; each is removed when it is done with.

    A kept table is read again and never computed again, so lost executors cost
    nothing that was kept. A table may be dropped once all that reads it is kept.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self._spark, self._folder = spark, fresh_folder(spark, label)
        # The tables are held as well, so that no other object gets the id of one.
        self._kept: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{len(self._kept)}"
        df.write.option("compression", "zstd").parquet(path)
        table = self._spark.read.schema(df.schema).parquet(path)
        self._kept[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(self._kept[id(table)][1])
            system = path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
            system.delete(path, True)
