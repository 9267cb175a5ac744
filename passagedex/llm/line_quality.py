"""Line-first cleaning with DataFrame functions only.

Every line is judged by itself: navigation, boilerplate, symbols, missing or
shouted punctuation. Failing lines are removed, and a document that loses more
than `max_loss` of its word characters is rejected. Documents that are too short
or repeat themselves are rejected whatever their lines are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagedex.llm.common import BLANKS, WORD, column, unused, whole, word_list

SYMBOLS = "#*$%&|<>"

# Phrases of page furniture, matched without regard to case.
BOILERPLATE = (
    "all rights reserved|cookie policy|privacy policy|terms of service|terms of use|"
    "enable javascript|click here|subscribe to our|sign up for|log in to|skip to content|"
    "powered by|follow us on|share this page"
)

# Marks that end sentences or clauses, by script: Latin, full-width and ideographic,
# Arabic and Urdu, Devanagari, Armenian, Ethiopic, Myanmar, Khmer, Tibetan. Fixed values.
SENTENCE_ENDS = ".!?:;…" "。！？：；｡" "؟؛۔" "।॥" "։" "።፣፤፥፧፨" "၊။" "។៕" "།༎"


# The same as patterns that are cheap to refuse: phrases are looked for at their first space
# only, and marks of Latin script, which most lines have, by themselves first.
_FURNITURE = " (?:" + "|".join(
    f"{phrase.split(' ', 1)[1]}(?<={phrase})" for phrase in BOILERPLATE.split("|")
) + ")"
_LATIN_ENDS = "[" + "".join(c for c in SENTENCE_ENDS if c <= "\xff") + "]"
_OTHER_ENDS = "[" + "".join(c for c in SENTENCE_ENDS if c > "\xff") + "]"
_SYMBOL = f"[{SYMBOLS}]"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line and document rules."""

    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    max_separators: int = 2
    max_symbol_percent: int = 10
    max_shouted_percent: int = 20
    unpunctuated_words: int = 25
    boilerplate_words: int = 25
    max_loss_percent: int = 50


def _letters(text: Column) -> Column:
    """Characters outside white space."""
    return F.char_length(F.translate(text, BLANKS, ""))


def _has_word(text: Column) -> Column:
    return text.rlike(WORD)


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def _pairs(text: Column, mark: str) -> Column:
    """Places where `mark` stands, not overlapping."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))) / F.lit(
        len(mark)
    )


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line is navigation, boilerplate, symbols, shouting or an endless list.

    Lines without a word never fail. A phrase of page furniture counts in lines of
    fewer than `boilerplate_words` words only: longer ones are prose that mentions it.
    """
    # Conditions are worked out one by one, nothing is remembered between them: those
    # that need a count come after those that settle most lines without.
    letters = _letters(line)
    blanks = _count(line, BLANKS)
    navigation = sum(
        (_pairs(line, mark) for mark in (" | ", " > ", " » ", " · ")), start=F.lit(0)
    ) >= F.lit(rules.max_separators)
    symbols = _count(line, SYMBOLS) * 100 >= letters * rules.max_symbol_percent
    if rules.max_symbol_percent > 0:
        symbols = line.rlike(_SYMBOL) & symbols
    shouted = (_pairs(line, "!!") >= 3) & (
        _pairs(line, "!!") * 100 >= (blanks + 1) * rules.max_shouted_percent
    )
    ended = line.rlike(_LATIN_ENDS) | line.rlike(_OTHER_ENDS)
    unpunctuated = ~ended & (blanks + 1 >= rules.unpunctuated_words)
    boilerplate = F.lower(line).rlike(_FURNITURE) & (blanks + 1 < rules.boilerplate_words)
    return _has_word(line) & (navigation | symbols | shouted | unpunctuated | boilerplate)


def _repeated_words(words: Column, n_words: Column, window: int) -> Column:
    """Hashes of all word windows, in order."""
    starts = F.sequence(F.lit(1), n_words - window + 1)
    return F.when(
        n_words >= window, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(places: Column, window: int) -> Column:
    """Words under at least one of the windows that start at these ascending places."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).cast("long").alias("last"))
    return F.aggregate(
        places,
        start,
        lambda acc, place: F.struct(
            (acc["n"] + F.least(F.lit(window).cast("long"), place - acc["last"])).alias("n"),
            place.alias("last"),
        ),
        lambda acc: acc["n"],
    )


def measure_lines(docs: DataFrame, text: str = "text", rules: LineRules | None = None) -> DataFrame:
    """The table with one more column `quality`, a struct of all measures and the verdict.

    n_words, word_chars, n_symbols, n_dup_lines (lines with a word equal to an
    earlier one), n_repeat_words (words in windows found twice in the document),
    base_failed, n_lines, n_failed_lines, clean_text, clean_chars, kept; and
    partition, the number of the partition that was measured.

    A null text counts as empty: no words, base_failed, not kept. Repeated rows
    are judged one by one. A column `quality` of the input is replaced. Windows
    are told apart by 64-bit hashes within one document.
    """
    rules = rules or LineRules()
    width = rules.repeat_window
    kept_columns = [c for c in docs.columns if c.lower() != "quality"]
    names = {k: unused(docs, k) for k in ("text", "words", "n", "hashes", "sorted", "lines", "bad")}
    t, w, n, h, s, ln, bad = (F.col(names[k]) for k in names)

    steps = docs.withColumn(names["text"], whole(column(docs, text)))
    steps = steps.withColumn(names["words"], word_list(t))
    steps = steps.withColumn(names["n"], F.size(w))
    steps = steps.withColumn(names["hashes"], _repeated_words(w, n, width))
    # Only documents in which some window comes back have their windows sorted.
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:bigint>>")
    steps = steps.withColumn(
        names["sorted"],
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(pairs)).otherwise(none),
    )
    twice = F.filter(
        s,
        lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
    )
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    steps = steps.withColumn(names["lines"], F.split(t, "\n"))
    steps = steps.withColumn(names["bad"], F.filter(ln, lambda x: line_fails(x, rules)))
    clean = F.when(
        F.size(bad) > 0, F.array_join(F.filter(ln, lambda x: ~line_fails(x, rules)), "\n")
    ).otherwise(t)

    measures = steps.select(
        *[column(steps, c) for c in kept_columns],
        F.struct(
            n.cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(t.rlike(_SYMBOL), _count(t, SYMBOLS))
            .otherwise(0)
            .cast("long")
            .alias("n_symbols"),
            _duplicate_lines(ln).alias("n_dup_lines"),
            _covered(places, width).alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"),
            F.size(bad).cast("long").alias("n_failed_lines"),
            clean.alias("clean_text"),
            # Not deterministic, so that conditions on the measures stay above
            # them. Below, each would be worked out again wherever it is used.
            F.spark_partition_id().alias("partition"),
        ).alias("quality"),
    )
    q = F.col("quality")
    failed = (q["n_words"] < rules.min_words) | (
        q["n_repeat_words"] * 100 > q["n_words"] * rules.max_repeat_percent
    )
    clean_chars = F.when(q["n_failed_lines"] == 0, q["word_chars"]).otherwise(
        _letters(q["clean_text"]).cast("long")
    )
    lost = (q["word_chars"] - clean_chars) * 100 > q["word_chars"] * rules.max_loss_percent
    return measures.withColumn(
        "quality",
        q.withField("base_failed", failed)
        .withField("clean_chars", clean_chars)
        .withField("kept", ~failed & ~lost),
    )


def _duplicate_lines(lines: Column) -> Column:
    worded = F.filter(lines, _has_word)
    return (F.size(worded) - F.size(F.array_distinct(worded))).cast("long")


def clean_lines(docs: DataFrame, text: str = "text", rules: LineRules | None = None) -> DataFrame:
    """The kept documents, with failing lines removed from their text; same columns.

    A document without failing lines keeps its text byte for byte.
    """
    marked = unused(docs, "quality")
    kept = measure_lines(docs.withColumnRenamed("quality", marked), text, rules)
    kept = kept.where(F.col("quality.kept"))
    name = marked if text == "quality" else text
    kept = kept.withColumn(name, F.col("quality.clean_text")).drop("quality")
    return kept.withColumnRenamed(marked, "quality") if marked in kept.columns else kept
