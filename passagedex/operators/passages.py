"""Articles to passages: one title row and one row per non-blank paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagedex.functions import text as X


def _doc_key(articles: DataFrame, position: Column) -> Column:
    """rel_path//id#position, plus the row number of articles read from files.

    A relative path has no '//' and the position is digits, so keys of two
    different passages never meet. Ordering by it orders by file, article and
    place in the article. Articles without `row_no` must differ in path or id.
    """
    key = F.format_string("%s//%s#%06d", F.col("rel_path"), F.col("id"), position)
    if "row_no" in articles.columns:
        key = F.concat(key, F.lit("~"), F.col("row_no").cast("string"))
    return key


def title_rows(articles: DataFrame) -> DataFrame:
    """The lower-cased title, otherwise untouched, even if empty."""
    position = F.lit(0)
    return articles.select(
        _doc_key(articles, position).alias("doc_key"),
        "rel_path",
        "id",
        position.alias("passage_pos"),
        F.lit("title").alias("type"),
        F.lower("title").alias("text"),
        F.lit(None).cast("string").alias("title"),
    )


def paragraph_rows(articles: DataFrame) -> DataFrame:
    """Cleaned paragraphs, numbered from 1 by their place in the article."""
    return flatten_articles(articles).where(F.col("passage_pos") > 0)


def flatten_articles(articles: DataFrame) -> DataFrame:
    """Title and paragraph rows of every article in one pass over the source.

    The title travels as element 0 of the paragraph array, so the union of
    both kinds of row needs neither a second scan nor a shuffle.
    """
    carried = [c for c in ("rel_path", "id", "row_no") if c in articles.columns]
    # An article without text still has its title.
    none = F.array().cast("array<array<string>>")
    parts = F.concat(F.array(F.array("title")), F.coalesce(F.col("text"), none))
    exploded = articles.select(
        *carried,
        F.lower("title").alias("lower_title"),
        F.posexplode(parts).alias("passage_pos", "sentences"),
    )
    is_title = F.col("passage_pos") == 0
    kept = exploded.where(is_title | X.has_words(X.joined_sentences(F.col("sentences"))))
    return kept.select(
        _doc_key(kept, F.col("passage_pos")).alias("doc_key"),
        "rel_path",
        "id",
        "passage_pos",
        F.when(is_title, F.lit("title")).otherwise(F.lit("paragraph")).alias("type"),
        F.when(is_title, F.col("lower_title"))
        .otherwise(X.clean_paragraph(F.col("sentences")))
        .alias("text"),
        F.when(~is_title, F.col("lower_title")).alias("title"),
    )


def passages_per_file(passages: DataFrame) -> DataFrame:
    """Passages of each file, and their total in the row whose path is NULL."""
    per_file = passages.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.rollup("rel_path").agg(F.sum("n").alias("n_passages"))
