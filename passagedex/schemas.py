"""Fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

ARTICLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)

CORRUPT = "_corrupt_record"

ARTICLE_FILE = T.StructType(ARTICLE.fields + [T.StructField(CORRUPT, T.StringType())])

SAVED_ARTICLE = T.StructType(
    [T.StructField("rel_path", T.StringType())]
    + ARTICLE_FILE.fields
    + [T.StructField("row_no", T.LongType())]
)

PASSAGE = T.StructType(
    [
        T.StructField("doc_key", T.StringType()),
        T.StructField("rel_path", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("passage_pos", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)

STORED_PASSAGE = T.StructType(PASSAGE.fields + [T.StructField("doc_len", T.IntegerType())])

POSTING = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("doc_key", T.StringType()),
        T.StructField("tf", T.IntegerType()),
        T.StructField("doc_len", T.IntegerType()),
    ]
)

LEXICAL_HIT = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("doc_key", T.StringType()),
    ]
)

RECORD_FIELDS = ["id", "type", "text", "title"]
