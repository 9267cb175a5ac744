import random
import sys
from collections import Counter

from pyspark.sql import functions as F

from passagedex.functions import text as X

SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, v string")
    rows = df.select("n", expression(F.col("v")).alias("out")).collect()
    return [row["out"] for row in sorted(rows, key=lambda row: row["n"])]


def noisy_texts(n=400):
    dice = random.Random(7)
    letters = SPACES + list("abABéİΣ​﻿᠎‐.<>\"/[]^&-") + [" "] * 20
    return ["".join(dice.choices(letters, k=dice.randint(0, 30))) for _ in range(n)]


def test_tokens_split_where_python_does(spark):
    values = [f"a{space}b" for space in SPACES] + noisy_texts() + ["", " ", "　"]
    assert column(spark, values, X.tokens) == [v.split() for v in values]


def test_has_words_means_something_is_left(spark):
    values = SPACES + noisy_texts() + ["", "  "]
    assert column(spark, values, X.has_words) == [bool(v.split()) for v in values]


def test_normalize_is_stable(spark):
    once = column(spark, noisy_texts(), X.normalize)
    assert column(spark, once, X.fold_spaces) == once


def test_links_are_literal(spark):
    values = ['see <a href="X%20Y">x y</a> end', '<A HREF="Q">z</A>', 'no">link', "a</a></a>b"]
    want = ["see X%20Y x y end", '<A HREF="Q z</A>', "no link", "ab"]
    assert column(spark, values, X.strip_links) == want


def test_preview_cuts_after_200(spark):
    values = ["a" * 200, "b" * 201, "", "é" * 300]
    want = ["a" * 200, "b" * 200 + "...", "", "é" * 200 + "..."]
    assert column(spark, values, X.preview) == want


def test_term_counts_match_a_counter(spark):
    values = noisy_texts() + ["b a b a b", "", "x"]
    got = column(spark, values, lambda v: X.term_counts(X.tokens(v)))
    for value, entries in zip(values, got):
        assert {e["term"]: e["tf"] for e in entries} == Counter(value.split())
        assert len(entries) == len(set(value.split()))


def test_words_or_text_become_text(spark):
    words = spark.createDataFrame([(["a", "b"],)], "v array<string>")
    text = spark.createDataFrame([("a b",)], "v string")
    for df in (words, text):
        assert df.select(X.as_text(df, "v")).first()[0] == "a b"


def test_formatted_passage(spark):
    rows = [("title", "t", None), ("paragraph", "p", "t"), ("note", "n", "t")]
    df = spark.createDataFrame(rows, "type string, text string, title string")
    shown = X.formatted_passage(F.col("type"), F.col("title"), F.col("text"), F.struct("text"))
    assert [r[0] for r in df.select(shown).collect()] == [
        "Title: t",
        "Title: t\nContent: p",
        '{"text":"n"}',
    ]
