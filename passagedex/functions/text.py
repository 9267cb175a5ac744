"""Text cleaning, tokenising and display, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every code point Python's str.split() treats as whitespace.
# Single Latin-1 characters compile to one table look-up; the class for the
# rest is only consulted above U+167F.
_ODD = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
ODD_SPACE = f"[{_ODD}]"
WHITESPACE = f"[ {_ODD}]"
WORD_START = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Link mark-up, deleted or blanked literally and in this order.
LINK_OPEN = '<a href="'
LINK_TARGET_END = '">'
LINK_CLOSE = "</a>"

PREVIEW_CHARS = 200


def tokens(text: Column) -> Column:
    """Whitespace-separated words; never contains an empty string.

    Text whose only whitespace is the plain space skips the regular expression.
    """
    split = F.when(F.rlike(text, F.lit(ODD_SPACE)), F.split(text, f"{WHITESPACE}+"))
    return F.array_remove(split.otherwise(F.split(text, " ")), "")


def fold_spaces(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def normalize(text: Column) -> Column:
    return fold_spaces(F.lower(text))


def query_tokens(text: Column) -> Column:
    return tokens(F.lower(text))


def strip_links(text: Column) -> Column:
    """Drop anchor tags but keep the link target in the text."""
    no_open = F.replace(text, F.lit(LINK_OPEN), F.lit(""))
    no_target = F.replace(no_open, F.lit(LINK_TARGET_END), F.lit(" "))
    return F.replace(no_target, F.lit(LINK_CLOSE), F.lit(""))


def joined_sentences(sentences: Column) -> Column:
    return strip_links(F.array_join(sentences, " "))


def clean_paragraph(sentences: Column) -> Column:
    return normalize(joined_sentences(sentences))


def has_words(text: Column) -> Column:
    """True when cleaning would leave something; stops at the first word."""
    return F.rlike(text, F.lit(WORD_START))


def detokenize(words: Column) -> Column:
    return F.array_join(words, " ")


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    short = F.concat(F.substring(text, 1, chars), F.lit("..."))
    return F.when(F.length(text) > chars, short).otherwise(text)


def formatted_passage(kind: Column, title: Column, text: Column, record: Column) -> Column:
    """Display form of a hit: title line, title plus content, or the raw record."""
    return (
        F.when(kind == "title", F.concat(F.lit("Title: "), text))
        .when(kind == "paragraph", F.concat(F.lit("Title: "), title, F.lit("\nContent: "), text))
        .otherwise(F.to_json(record))
    )


def as_text(df: DataFrame, column: str) -> Column:
    """The column as one string, whether it holds text or a list of words."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return detokenize(F.col(column))
    return F.col(column)


def term_counts(words: Column) -> Column:
    """Distinct words of one passage with their counts, without a shuffle.

    The words are sorted in place; each run of equal words becomes one
    (term, tf) entry. The one-element arrays bind the sorted words and the
    run starts to lambda variables, so both are computed once per row.
    """

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), size),
            lambda i: (i < size)
            & ((i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))),
        )
        return F.flatten(
            F.transform(
                F.array(starts),
                lambda begin: F.transform(
                    begin,
                    lambda at, n: F.struct(
                        F.get(ordered, at).alias("term"),
                        (F.coalesce(F.get(begin, n + 1), size) - at).alias("tf"),
                    ),
                ),
            )
        )

    return F.flatten(F.transform(F.array(F.sort_array(words)), runs))
