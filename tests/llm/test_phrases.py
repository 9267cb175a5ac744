"""Phrase mining against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from passagedex.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, max_words):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for j in range(i + 1, min(i + max_words, len(words)) + 1):
                    counts[lang][tuple(words[i:j])] += 1
    return counts, totals


def plain_phrases(rows, max_words, min_count, percent, top):
    counts, totals = plain_counts(rows, max_words)
    listed = []
    for lang, found in counts.items():
        frequent = {p: a for p, a in found.items() if a >= min_count}
        covered = Counter()
        for p, a in frequent.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        covered[p[i:j]] = max(covered[p[i:j]], a)
        ranked = []
        for p, a in frequent.items():
            if len(p) < 2 or (p in covered and 100 * covered[p] >= percent * a):
                continue
            n = totals[lang]
            score, k = min(
                (1000 * a * n // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))
            )
            ranked.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            listed.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(listed)


def texts():
    chance = random.Random(8)
    words = ["the", "The", "a", "über", "x\x00y", "x", "x\x01", "\x01", "b", "c\x1cd", "of"]

    def prose(n):
        marks = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "!"]
        return "".join(chance.choice(words) + chance.choice(marks) for _ in range(n))

    made = [(None, "en"), ("", "en"), (" \t", None), ("one", ""), ("the", "und")]
    made += [(prose(chance.randint(1, 80)), chance.choice(["en", "en", "de", None, "und", ""])) for _ in range(90)]
    made += [("the same five words again here", "en")] * 15 + [("a " * 400, "fr"), (prose(3000), "en")]
    return [(i, t, lang, "p", 1) for i, (t, lang) in enumerate(made)]


def mined(spark, rows, **settings):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return phrases.mine_phrases(docs, **settings)


@pytest.mark.parametrize(
    ("max_words", "min_count", "percent", "top", "group"),
    [(5, 6, 100, 2000, 1 << 17), (5, 3, 80, 7, 3), (2, 4, 100, 2000, 1), (3, 1, 100, 2000, 20)],
)
def test_phrases_equal_a_plain_count(spark, monkeypatch, max_words, min_count, percent, top, group):
    monkeypatch.setattr(phrases, "GROUP_ROWS", group)
    rows = texts()
    settings = {"max_words": max_words, "min_count": min_count, "top": top}
    made = mined(spark, rows, covered_percent=percent, **settings)
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(r) for r in made.collect())
    assert got == plain_phrases(rows, max_words, min_count, percent, top)


def test_empty_tables_and_tables_without_words(spark):
    assert mined(spark, []).collect() == []
    assert mined(spark, [(1, None, None, "", 0), (2, " . ", "en", "", 0)]).collect() == []


def test_settings_out_of_range_are_errors(spark):
    for wrong in ({"covered_percent": 101}, {"max_words": 1}, {"min_count": 0}, {"top": 0}):
        with pytest.raises(ValueError, match="covered_percent"):
            mined(spark, [], **wrong)


def test_chunks_keep_all_words_and_cut_long_texts_at_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 50)
    rows = texts()
    batch = pa.RecordBatch.from_pydict(
        {"lang": [r[2] or "und" for r in rows], "text": [r[1] for r in rows]}
    )
    found = defaultdict(Counter)
    for chunk in phrases.chunks(iter([batch])):
        everything = np.full(1024, 2**64 - 1, dtype=np.uint64)
        made = phrases._suffixes(chunk, everything, 2)
        for phrase, n in zip(made["phrase"].to_pylist(), made["n"].to_pylist(), strict=True):
            found[chunk.lang][phrase] += n
    counts, _ = plain_counts([(0, r[1], r[2] or "und") for r in rows], 2)
    for lang, phrase_counts in counts.items():
        pairs = {p: n for p, n in phrase_counts.items() if len(p) == 2}
        escaped = {
            b"\x00".join(phrases._escaped(w.encode()) for w in p).decode(): n
            for p, n in pairs.items()
        }
        assert found[lang] == escaped


def test_a_node_split_between_groups_is_given_on_both_sides():
    trees = phrases._Subtrees(min_count=5, max_words=3)
    for group, phrase, n in [
        (0, "a", 1), (0, "a\x00b", 2), (0, "a\x00b\x00c", 2), (0, "a\x00c", 1),
        (1, "a\x00c", 3), (1, "a\x00d", 1), (1, "b\x00c", 6), (1, "c", 1),
    ]:
        trees.add(group, "en", phrase, n)
    trees.end()
    totals = Counter()
    for row in trees.taken().to_pylist():
        totals[row["phrase"]] += row["n"]
    assert {p: n for p, n in totals.items() if n >= 4} == {"a\x00b": 4, "a\x00c": 4, "b\x00c": 6}
