"""Article dumps: bz2 JSON lines or JSON arrays, bad records set aside."""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagedex.schemas import ARTICLE_FILE, CORRUPT, SAVED_ARTICLE
from passagedex.sources.storage import plain_path, require

LINES_GLOB = "*.bz2"
ARRAY_GLOB = "*.json"

# An element of an array indented by two, where it opens and where it closes.
ELEMENT_OPENS = "\n  {"
ELEMENT_CLOSES = "\n  }"

# Compressed bytes that the probe of a file reads at a time.
PROBE_BYTES = 1 << 16


def _configure(reader, glob: str, multi_line: bool):
    return (
        reader.schema(ARTICLE_FILE)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("multiLine", multi_line)
    )


def _relative_path(root: str) -> Column:
    # The metadata column holds an encoded URI; '+' is literal there.
    uri = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.substring(decoded, F.lit(len(root) + 2), F.length(decoded))


def _parent(rel_path: Column | str) -> Column:
    return F.regexp_replace(rel_path, r"/?[^/]*$", "")


def _with_source(raw: DataFrame, root: str) -> DataFrame:
    rel_path = _relative_path(root)
    return raw.select(
        rel_path.alias("rel_path"),
        _parent(rel_path).alias("rel_dir"),
        *ARTICLE_FILE.names,
    )


def read_article_lines(spark: SparkSession, folder: str, glob: str = LINES_GLOB) -> DataFrame:
    """One article per line, files found recursively; bz2 is split across tasks."""
    require(spark, folder, "article folder")
    raw = _configure(spark.read, glob, False).json(folder)
    return _with_source(raw, plain_path(spark, folder))


def read_article_arrays(spark: SparkSession, folder: str, glob: str = ARRAY_GLOB) -> DataFrame:
    """One JSON array per file, however big a file is.

    A file whose elements stand indented by two, one after another, is cut where
    an element opens and read by as many tasks as any text. Line ends inside
    strings are escaped in JSON, so nothing else looks like that. Every other
    file, with one broken element too, is read whole by one task. A first pass
    tells the files apart; only the names of those to be read whole are collected.
    """
    require(spark, folder, "article folder")
    root = plain_path(spark, folder)
    pieces = _pieces(spark, folder, root, glob)
    states = pieces.groupBy("path").agg(
        F.count_if(F.col("state") == "open").alias("n_open"),
        F.count_if(F.col("state") == "last").alias("n_last"),
        F.count_if(F.col("state") == "other").alias("n_other"),
    )
    regular = (F.col("n_open") == 1) & (F.col("n_last") == 1) & (F.col("n_other") == 0)
    odd = [r["path"] for r in states.where(~regular).select("path").collect()]
    whole = read_articles_of(spark, folder, odd, glob, True)
    split = pieces.where(F.col("state").isin("last", "element"))
    if odd:
        names = spark.createDataFrame([(path,) for path in odd], "path string")
        split = split.join(names, "path", "left_anti")
    return split.select(*whole.columns).unionByName(whole)


def _pieces(spark: SparkSession, folder: str, root: str, glob: str) -> DataFrame:
    """Text from one opening brace of an element to the next, parsed, with its state.

    `open` is what precedes the first element, `last` the element before the closing
    bracket; `other` is what no regular file holds.
    """
    raw = (
        spark.read.option("lineSep", ELEMENT_OPENS)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(folder)
    )
    closes = F.locate(ELEMENT_CLOSES, F.col("body"))
    at_end = closes == F.length("body") - (len(ELEMENT_CLOSES) - 1)
    closed = (F.col("body") == "{}") | ((closes > 0) & at_end)
    fields = F.struct(*[F.col("parsed")[name].alias(name) for name in ARTICLE_FILE.names])
    parsed = F.from_json(
        "body", ARTICLE_FILE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    rel_path = _relative_path(root)
    piece = F.col("value")
    return (
        raw.select(
            rel_path.alias("rel_path"),
            F.trim(piece).rlike(r"^\s*\[\s*$").alias("opens"),
            piece.rlike(r"\}\s*\]\s*$").alias("ends"),
            F.concat(F.lit("{"), F.regexp_replace(piece, r"(?:,|(?<=\})\s*\])\s*$", "")).alias("body"),
        )
        .withColumn("parsed", parsed)
        .select(
            F.concat(F.lit(f"{folder.rstrip('/')}/"), "rel_path").alias("path"),
            "rel_path",
            _parent(F.col("rel_path")).alias("rel_dir"),
            fields.alias("fields"),
            F.when(F.col("opens"), "open")
            .when(~closed | F.col("parsed")[CORRUPT].isNotNull(), "other")
            .when(F.col("ends"), "last")
            .otherwise("element")
            .alias("state"),
        )
        .select("path", "rel_path", "rel_dir", "fields.*", "state")
    )


def stream_articles(
    spark: SparkSession,
    folder: str,
    glob: str = LINES_GLOB,
    multi_line: bool = False,
    max_files_per_batch: int | None = None,
) -> DataFrame:
    """The same rows as a stream of newly arrived files; a damaged file ends it."""
    require(spark, folder, "article folder")
    reader = _configure(spark.readStream, glob, multi_line)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return _with_source(reader.json(folder), plain_path(spark, folder))


def read_articles_of(
    spark: SparkSession, folder: str, paths: list[str], glob: str, multi_line: bool
) -> DataFrame:
    """The articles of some files of a folder; no files give no rows."""
    if not paths:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ARTICLE_FILE)
        return spark.createDataFrame([], f"rel_path string, rel_dir string, {columns}")
    raw = _configure(spark.read, glob, multi_line).json([_literal(p) for p in paths])
    return _with_source(raw, plain_path(spark, folder))


def _literal(path: str) -> str:
    """A path none of whose characters is taken for a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def stream_files(
    spark: SparkSession,
    folder: str,
    glob: str = LINES_GLOB,
    max_files_per_batch: int | None = None,
) -> DataFrame:
    """(path, rel_path, length) of newly arrived files as a stream; contents are not read."""
    require(spark, folder, "article folder")
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
    )
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    rel_path = _relative_path(plain_path(spark, folder))
    return reader.load(folder).select("path", rel_path.alias("rel_path"), "length")


def damaged_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, error) of the files that cannot be decompressed to their end.

    Each file is decompressed by one task, part by part, and nothing is kept.
    """
    found = spark.read.format("binaryFile").load([_literal(p) for p in paths])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [
                _fault(path, content.as_py())
                for path, content in zip(
                    batch["path"].to_pylist(), batch["content"], strict=True
                )
            ]
            named = pa.RecordBatch.from_arrays(
                [batch["path"], pa.array(errors, pa.string())], names=["path", "error"]
            )
            yield named.filter(named["error"].is_valid())

    return found.select("path", "content").mapInArrow(probe, "path string, error string")


def _fault(path: str, content: bytes) -> str | None:
    """What is wrong with a compressed file, if anything."""
    if not path.endswith(".bz2"):
        return None
    at, stream = 0, None
    try:
        while at < len(content):
            stream = stream or bz2.BZ2Decompressor()
            part = content[at : at + PROBE_BYTES]
            stream.decompress(part)
            at += len(part)
            if stream.eof:
                # Another stream may follow, from what this one has left unused.
                at -= len(stream.unused_data)
                stream = None
    except OSError as error:
        return str(error)
    return None if stream is None else "the file ends within its data"


def list_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Paths and sizes of matching files; contents are not read."""
    require(spark, folder, "article folder")
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(folder)
    )
    rel_path = _relative_path(plain_path(spark, folder))
    return found.select(
        rel_path.alias("rel_path"),
        _parent(rel_path).alias("rel_dir"),
        "length",
    )


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """The content of one file."""
    return spark.read.format("binaryFile").load(_literal(path)).select("content").first()[0]


def files_not_in(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose relative path the ledger does not hold yet."""
    return files.join(ledger.select("rel_path").distinct(), "rel_path", "left_anti")


def is_usable() -> Column:
    """A complete article: parsed, nothing missing, no null sentence."""
    null_sentence = F.exists(
        "text", lambda par: F.coalesce(F.exists(par, lambda s: s.isNull()), F.lit(False))
    )
    whole = F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("text").isNotNull()
    return F.col(CORRUPT).isNull() & whole & ~F.coalesce(null_sentence, F.lit(False))


def save_articles(articles: DataFrame, folder: str, by_source_dir: bool = True) -> None:
    """Write parsed articles once as Parquet, keeping each source's folder.

    Everything downstream reads this table, so a dump is decompressed and
    parsed a single time. `row_no` tells articles with equal ids apart.
    """
    rows = articles.withColumn("row_no", F.monotonically_increasing_id())
    writer = rows.write.mode("overwrite")
    if by_source_dir:
        writer = writer.partitionBy("rel_dir")
    writer.parquet(folder)


def load_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Saved articles; the folder column comes from the path, never from type guessing."""
    saved = spark.read.schema(SAVED_ARTICLE).parquet(folder)
    return saved.withColumn("rel_dir", _parent("rel_path"))


def usable(saved: DataFrame) -> DataFrame:
    return saved.where(is_usable()).drop(CORRUPT)


def quarantined(saved: DataFrame) -> DataFrame:
    return saved.where(~is_usable())
