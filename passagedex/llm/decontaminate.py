"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Items and texts are normalised alike: A-Z lower-cased, and everything in ASCII
that is neither a letter nor a digit separates words. Every window of ten
consecutive item words is one string of the automaton, with a space at both
ends; a text is scanned once, and hits are mapped back to its words and to their
places in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagedex.llm.common import column, unused
from passagedex.session import cut_lineage

WINDOW = 10

# Item text that one automaton is built from; about half a gigabyte of nodes in a
# worker. More items have several automata.
MAX_ITEM_BYTES = 1 << 20

# A-Z to a-z, other ASCII but letters and digits to space, bytes of longer
# characters as they are.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
SPACE = 32

FOUND = (
    "n_words bigint, hits array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>, "
    "items array<string>"
)


def normal_bytes(text: str | None) -> bytes:
    """UTF-8 of a text, each byte normalised in place, so offsets stay."""
    return text.encode().translate(NORMAL) if text else b""


def _joined(words: list[bytes]) -> str:
    """Words with single spaces between and around them, one letter per byte."""
    return " " + b" ".join(words).decode("latin-1") + " "


def windows(text: str | None, width: int = WINDOW) -> list[str]:
    """The windows of an item: `width` consecutive words each, or all of fewer words."""
    words = normal_bytes(text).split()
    if not words:
        return []
    return [_joined(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def build_automaton(items: list[tuple[str, str | None]], width: int = WINDOW):
    """Automaton of the windows of (id, text) items; None if they have no word.

    The value of a window is its number of words and the ids of its items.
    """
    owners: dict[str, set[str]] = {}
    for item_id, text in items:
        for window in windows(text, width):
            owners.setdefault(window, set()).add(item_id)
    automaton = ahocorasick.Automaton()
    for window, ids in owners.items():
        automaton.add_word(window, (window.count(" ") - 1, tuple(sorted(ids))))
    if not owners:
        return None
    automaton.make_automaton()
    return automaton


def scan(automaton, text: str | None) -> tuple[int, list, list]:
    """(n_words, runs of hit words, items) of one text.

    Runs are (first, last, start, end): word numbers, `last` included, and the
    characters of the original text they cover, `end` excluded. Runs neither
    touch nor overlap.
    """
    plain = normal_bytes(text)
    words = plain.split()
    if automaton is None or not words:
        return len(words), [], []
    found = list(automaton.iter(_joined(words)))
    if not found:
        return len(words), [], []
    # A match ends on the space after its last word.
    ends = np.cumsum([len(w) + 1 for w in words])
    last = np.searchsorted(ends, [end for end, _ in found])
    size = np.array([n for _, (n, _) in found])
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, last - size + 1, 1)
    np.add.at(cover, last + 1, -1)
    hit = np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]))
    edges = np.diff(hit)
    firsts, lasts = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    letters = np.frombuffer(plain, dtype=np.uint8)
    inside = np.concatenate(([False], letters != SPACE, [False]))
    begins = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    stops = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    # Characters before a byte: the bytes before it that begin a character.
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    characters = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    ends_at = (firsts, lasts, characters[begins[firsts]], characters[stops[lasts]])
    runs = [
        dict(zip(("first", "last", "start", "end"), run, strict=True))
        for run in zip(*(x.tolist() for x in ends_at), strict=True)
    ]
    return len(words), runs, sorted({i for _, (_, ids) in found for i in ids})


def _item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list]:
    """The items in blocks whose texts stay below the bound; one block on the driver at a time.

    Null texts have no words; a null id is written as the empty string.
    """
    items = benchmark.select(
        F.coalesce(column(benchmark, item_id).cast("string"), F.lit("")).alias("id"),
        column(benchmark, text).alias("text"),
    ).dropna(subset=["text"])
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row.text) > MAX_ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((row.id, row.text))
        size += len(row.text)
    yield block


def _scanner(docs: DataFrame, items: list, width: int):
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf(FOUND)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = build_automaton(shared.value, width)
        for texts in batches:
            rows = [scan(automaton, text) for text in texts]
            yield pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    return scanned


def _text_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _found_by(docs: DataFrame, texts: Column, items: list, width: int) -> DataFrame:
    """(key, found) of the different texts that hold a window of these items."""
    # Not deterministic: else the filter would scan every text a second time.
    scanner = _scanner(docs, items, width).asNondeterministic()
    scanned = docs.select(_text_key(texts).alias("key"), scanner(texts).alias("found"))
    return cut_lineage(scanned.where(F.size("found.hits") > 0).dropDuplicates(["key"]))


def _of_all_blocks(parts: list[DataFrame]) -> DataFrame:
    """What several automata found in a text, a row for each text; runs are still apart."""
    every = reduce(DataFrame.unionByName, parts).groupBy("key")
    return every.agg(
        F.struct(
            F.flatten(F.collect_list("found.hits")).alias("hits"),
            F.flatten(F.collect_list("found.items")).alias("items"),
        ).alias("found")
    )


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """The table with one more column `leaks`: what it shares with the benchmark items.

    leaks is a struct of n_words, n_hit (words inside any occurrence of a window),
    hits (runs of hit words: first, last, and start, end in characters of the
    original text) and items (ids as strings, sorted, each once). Null and empty texts have no
    words and no hits. Items without words match nothing; an item with fewer
    words than the window is one window. Repeated rows are scanned one by one.
    An input column `leaks` is replaced.

    Benchmarks above the bound of one automaton have one automaton for every megabyte.
    Each scans the table; what the later ones find, and nothing else, is written, by a
    hash of the text, and joined to the rows at the end.
    """
    docs = docs.drop("leaks")
    found, key = unused(docs, "found"), unused(docs, "text_key")
    found_later, key_later = unused(docs, "found_later"), unused(docs, "key_later")
    texts = column(docs, text)
    blocks = _item_blocks(benchmark, item_id, item_text)
    scanned = docs.withColumn(found, _scanner(docs, next(blocks), width)(texts))
    later = [_found_by(docs, texts, block, width) for block in blocks]
    if later:
        other = _of_all_blocks(later).withColumnsRenamed({"key": key_later, "found": found_later})
        scanned = scanned.withColumn(key, _text_key(column(scanned, text)))
        scanned = scanned.join(other, F.col(key) == F.col(key_later), "left").withColumn(
            found,
            F.when(F.col(key_later).isNull(), F.col(found)).otherwise(
                _merged(F.col(found), F.col(found_later))
            ),
        )
    f = F.col(found)
    n_hit = F.aggregate(
        f["hits"], F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"] + 1
    )
    leaks = F.struct(f["n_words"], n_hit.alias("n_hit"), f["hits"], f["items"])
    return scanned.select(*[column(scanned, c) for c in docs.columns], leaks.alias("leaks"))


def _merged(one: Column, two: Column) -> Column:
    """What automata found in the same text; runs that touch or overlap become one."""

    def joined(acc: Column, run: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = last.withField("last", F.greatest(last["last"], run["last"])).withField(
            "end", F.greatest(last["end"], run["end"])
        )
        rest = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        touches = (F.size(acc) > 0) & (run["first"] <= F.get(acc, F.size(acc) - 1)["last"] + 1)
        return F.when(touches, F.concat(rest, F.array(longer))).otherwise(
            F.concat(acc, F.array(run))
        )

    runs = F.sort_array(F.concat(one["hits"], two["hits"]))
    return F.struct(
        one["n_words"].alias("n_words"),
        F.aggregate(runs, F.slice(runs, 1, 0), joined).alias("hits"),
        F.array_sort(F.array_union(one["items"], two["items"])).alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows that hold no window of a benchmark item, with their columns."""
    marked = unused(docs, "leaks")
    found = find_benchmark(docs.withColumnRenamed("leaks", marked), benchmark, **settings)
    clean = found.where(F.col("leaks.n_hit") == 0).drop("leaks")
    return clean.withColumnRenamed(marked, "leaks") if marked in clean.columns else clean
