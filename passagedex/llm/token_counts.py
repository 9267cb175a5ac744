"""Token counts of a byte-level BPE vocabulary without tokenising most words.

Almost every pre-token of ordinary text is one token. Which vocabulary strings
are reached whole is proved once, on the driver: a string counts as proved if
the library's own merges turn it, as a pre-token of its own, into exactly one
token. On the executors a proved pre-token costs one dictionary look-up; all
others go through the library's merges, each distinct one once while it is
remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import nan

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Counts a worker remembers, of pre-tokens and of stretches between spaces, and
# the longest text it remembers; they bound memory and change no result.
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


LETTERS = str.maketrans({chr(b): letter for b, letter in byte_letters().items()})


def as_letters(pre_token: str) -> str:
    """A pre-token in the letters of the vocabulary."""
    return pre_token.encode().decode("latin-1").translate(LETTERS)


def checked_vocabulary(path: str) -> tuple[str, list[str]]:
    """The vocabulary file's text and its added strings, if it is of the kind handled here."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    parts = json.loads(text)
    split = parts.get("pre_tokenizer") or {}
    if (
        parts["model"]["type"] != "BPE"
        or split.get("type") != "ByteLevel"
        or split.get("add_prefix_space")
        or not split.get("use_regex", True)
        or parts.get("normalizer")
    ):
        raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
    added = parts.get("added_tokens") or []
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens that take context are not handled: {path}")
    return text, [t["content"] for t in added]


def prove_whole_tokens(vocabulary: str) -> frozenset[str]:
    """The pre-tokens that the vocabulary encodes as one token, proved one by one.

    A vocabulary string is in the set if it is valid UTF-8, is one pre-token of
    the pattern, and the library's merges give exactly the one token that it is.
    """
    tokenizer = Tokenizer.from_str(vocabulary)
    letter_bytes = {letter: b for b, letter in byte_letters().items()}
    pattern, proved = regex.compile(PRE_TOKEN), set()
    for letters, token_id in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(letter_bytes[c] for c in letters).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if not pattern.fullmatch(text) or pattern.findall(text) != [text]:
            continue
        if [t.id for t in tokenizer.model.tokenize(letters)] == [token_id]:
            proved.add(text)
    return frozenset(proved)


class PreTokens(dict):
    """Tokens of a pre-token: 1 where proved, else by the library's merges."""

    def __init__(self, vocabulary: str, proved: frozenset[str]) -> None:
        super().__init__(dict.fromkeys(proved, 1))
        self._model = Tokenizer.from_str(vocabulary).model
        self._proved = proved

    def __missing__(self, pre_token: str) -> int:
        n = len(self._model.tokenize(as_letters(pre_token)))
        if len(pre_token) <= LONGEST_REMEMBERED:
            if len(self) >= len(self._proved) + REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self._proved, 1))
            self[pre_token] = n
        return n


class Counter(dict):
    """Tokens of texts; as a dictionary, those of the text between two spaces.

    No pre-token goes on past a space that follows a character other than white
    space, so such a stretch, taken with the space before it, is counted by
    itself. A stretch that is empty or begins with white space is part of a
    longer run of white space; it counts as not-a-number, and a text with one is
    matched against the pattern as a whole.
    """

    def __init__(self, vocabulary: str, added: Sequence[str], proved: frozenset[str]) -> None:
        self._pre_tokens = PreTokens(vocabulary, proved)
        self._pattern = regex.compile(PRE_TOKEN)
        longest_first = sorted(added, key=len, reverse=True)
        self._added = regex.compile("|".join(map(regex.escape, longest_first))) if added else None

    def __missing__(self, stretch: str) -> float:
        regular = stretch and not stretch[0].isspace()
        n = self._by_pattern(" " + stretch) if regular else nan
        if len(stretch) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; an added string inside it is one token."""
        if not text:
            return 0
        if self._added and self._added.search(text):
            pieces = self._added.split(text)
            return len(pieces) - 1 + sum(map(self._count_plain, pieces))
        return self._count_plain(text)

    def _count_plain(self, text: str) -> int:
        first, *others = text.split(" ")
        n = sum(map(self.__getitem__, others))
        return self._by_pattern(text) if n != n else n + self._by_pattern(first)

    def _by_pattern(self, text: str) -> int:
        return sum(map(self._pre_tokens.__getitem__, self._pattern.findall(text)))


@lru_cache(maxsize=2)
def _counter(vocabulary: str, added: tuple[str, ...], proved: frozenset[str]) -> Counter:
    """One counter per worker process, kept from task to task."""
    return Counter(vocabulary, added, proved)


def token_count(spark: SparkSession, text: Column, path: str) -> Column:
    """Tokens of each text as a long, without begin, end or added special tokens.

    Strings of special tokens inside a text are taken as the library takes them
    by default: each is its one token. Null and empty texts have 0 tokens; texts
    are never cut. The vocabulary file is read on the driver only.
    """
    vocabulary, added = checked_vocabulary(path)
    shared = spark.sparkContext.broadcast((vocabulary, tuple(added), prove_whole_tokens(vocabulary)))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(*shared.value)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return counted(text)
