"""Encoding and decoding with a word-end BPE vocabulary, merged in batched numpy rounds.

The symbols of all new words of a chunk of texts lie in one flat array. In a
round every word finds its lowest-ranked pair, by binary search over the sorted
keys of all mergeable pairs, and merges it wherever it occurs; words without a
mergeable pair leave the array. Only pairs next to a merge are searched again.
Decoding gathers the bytes of many tokens at once from one flat array.

No pre-token of such a vocabulary crosses ASCII white space and no character is
composed across it, so texts are cut there and each stretch between is encoded
once while it is remembered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passagedex.llm.token_counts import byte_letters

# Bytes of texts that are encoded together, how many stretches and words a worker
# remembers between chunks, and the longest it remembers. They bound memory only.
CHUNK_BYTES = 1 << 20
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64

UNRANKED = np.int32(np.iinfo(np.int32).max)


def checked_vocabulary(path: str) -> str:
    """The text of a vocabulary file, if it is of the kind handled here."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    parts = json.loads(text)
    model, added = parts["model"], parts.get("added_tokens") or []
    unfit = (
        model["type"] != "BPE"
        or model.get("dropout")
        or model.get("continuing_subword_prefix")
        or model.get("byte_fallback")
        or model.get("ignore_merges")
        or model.get("unk_token") is not None
        or parts.get("post_processor")
        or parts.get("decoder")
        or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        or _normalizers(parts) != ["NFC", "Replace", "Lowercase"]
        or _splitters(parts) != ["Split", "ByteLevel"]
    )
    if unfit:
        raise ValueError(f"not a word-end BPE vocabulary of the kind handled here: {path}")
    return text


def _normalizers(parts: dict) -> list[str]:
    return [n["type"] for n in (parts.get("normalizer") or {}).get("normalizers", [])]


def _splitters(parts: dict) -> list[str]:
    return [s["type"] for s in (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])]


class Merger:
    """The merge table as sorted pair keys, and batched merging of words."""

    def __init__(self, model: dict) -> None:
        vocabulary: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self._inner, self._final = (
            np.array([vocabulary.get(letters[b] + end, -1) for b in range(256)], dtype=np.int64)
            for end in ("", suffix)
        )
        self._base = np.int64(max(vocabulary.values()) + 1)
        left = np.array([vocabulary[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self._base + right
        # Of a pair listed twice, the later rank holds.
        order = np.lexsort((np.arange(len(keys)), keys))
        last = np.append(keys[order][1:] != keys[order][:-1], True) if len(keys) else order
        self._rank = order[last].astype(np.int32)
        self._keys, self._made = keys[self._rank], made[self._rank]
        self.ordered = self._is_ordered(left, right, made)

    def _is_ordered(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> bool:
        """Whether every token is made before any pair that holds it.

        Then a merge never gives rise to a pair of lower rank, and all places of
        a word's lowest pair may be merged in one round.
        """
        made_last = np.full(int(self._base), -1, dtype=np.int64)
        np.maximum.at(made_last, made, np.arange(len(made)))
        ranks = np.arange(len(made))
        return bool((made_last[left] < ranks).all() and (made_last[right] < ranks).all())

    def _search(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of pairs; UNRANKED where the pair is not mergeable."""
        if not len(self._keys):
            return np.full(len(left), UNRANKED), np.zeros(len(left), dtype=np.int64)
        keys = left * self._base + right
        place = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        hit = self._keys[place] == keys
        return np.where(hit, self._rank[place], UNRANKED), self._made[place]

    def _symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all words in one array, and how many each word has.

        Letters that are not in the vocabulary are dropped.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        letters = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbol = self._inner[letters]
        last = np.cumsum(sizes)[sizes > 0] - 1
        symbol[last] = self._final[letters[last]]
        known = symbol >= 0
        if not known.all():
            owner = np.repeat(np.arange(len(words)), sizes)
            sizes = np.bincount(owner[known], minlength=len(words))
            symbol = symbol[known]
        return symbol, sizes

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The token ids of every word, packed as little-endian 32-bit numbers."""
        symbol, sizes = self._symbols(words)
        result = [b""] * len(words)
        names = np.flatnonzero(sizes)
        start = np.cumsum(sizes[names]) - sizes[names]
        rank, made = self._ranked(symbol, start)
        while len(names):
            least = np.minimum.reduceat(rank, start)
            ends = np.append(start[1:], len(symbol))
            over = least == UNRANKED
            if over.any():
                stays = np.repeat(~over, ends - start)
                packed = symbol[~stays].astype("<u4").tobytes()
                high = 4 * np.cumsum((ends - start)[over])
                low = high - 4 * (ends - start)[over]
                done = zip(names[over].tolist(), low.tolist(), high.tolist(), strict=True)
                for name, i, j in done:
                    result[name] = packed[i:j]
                lengths = (ends - start)[~over]
                symbol, rank, made = symbol[stays], rank[stays], made[stays]
                names, least = names[~over], least[~over]
                start = np.cumsum(lengths) - lengths
                if not len(names):
                    break
                ends = np.append(start[1:], len(symbol))
            chosen = np.flatnonzero(rank == np.repeat(least, ends - start))
            if self.ordered:
                chosen = chosen[_every_other(chosen)]
            else:
                chosen = chosen[np.searchsorted(chosen, start)]
            symbol[chosen] = made[chosen]
            stays = np.ones(len(symbol), dtype=bool)
            stays[chosen + 1] = False
            # Places in the shortened array, and the pairs that changed.
            new_place = np.cumsum(stays) - 1
            symbol, rank, made = symbol[stays], rank[stays], made[stays]
            start = new_place[start]
            changed = new_place[chosen]
            is_start = np.zeros(len(symbol) + 1, dtype=bool)
            is_start[start] = is_start[-1] = True
            before = changed[~is_start[changed]] - 1
            places = np.concatenate((before, changed))
            inside = ~is_start[places + 1]
            rank[places[~inside]] = UNRANKED
            places = places[inside]
            rank[places], made[places] = self._search(symbol[places], symbol[places + 1])
        return result

    def _ranked(self, symbol: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each symbol with the next one of its word."""
        if not len(symbol):
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        rank, made = self._search(symbol, np.append(symbol[1:], 0))
        rank[np.append(start[1:], len(symbol)) - 1] = UNRANKED
        return rank, made


def _every_other(places: np.ndarray) -> np.ndarray:
    """Of adjoining places only the first, third, ...: the others overlap a merge."""
    fresh = np.append(True, np.diff(places) != 1)
    run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
    return (np.arange(len(places)) - run_start) % 2 == 0


# Stretches of these characters alone are what normalising makes of them once
# lower-cased, and are cut into pre-tokens by this pattern, the vocabulary's own
# as far as it concerns them.
PLAIN = re.compile(rb"[\x21-\x7e]+")
PLAIN_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
TO_BYTES = {ord(letter): b for b, letter in byte_letters().items()}


class Encoder:
    """Token ids of texts; words and stretches between white space are remembered."""

    def __init__(self, vocabulary: str) -> None:
        parts = json.loads(vocabulary)
        # Only the library's normalizer and splitter are used, so it gets no model.
        bare = parts["model"] | {"vocab": {}, "merges": []}
        tokenizer = Tokenizer.from_str(json.dumps(parts | {"model": bare, "added_tokens": []}))
        self._normalise = tokenizer.normalizer.normalize_str
        self._split = tokenizer.pre_tokenizer.pre_tokenize_str
        self._merger = Merger(parts["model"])
        self._added = {t["content"].encode(): t["id"] for t in parts.get("added_tokens") or []}
        longest_first = sorted(self._added, key=len, reverse=True)
        strings = b"|".join(map(re.escape, longest_first))
        self._cut = re.compile(b"(" + strings + b")") if strings else None
        self._words: dict[bytes, bytes] = {}
        self._stretches: dict[bytes, bytes] = {}

    def _pre_tokens(self, piece: bytes) -> list[bytes]:
        if PLAIN.fullmatch(piece):
            lower = piece.lower()
            return [lower] if lower.isalpha() else PLAIN_WORDS.findall(lower)
        words = self._split(self._normalise(piece.decode()))
        return [word.translate(TO_BYTES).encode("latin-1") for word, _ in words]

    def _parts(self, stretch: bytes) -> list[bytes | int]:
        """Pre-tokens of a stretch in order, with the ids of added tokens between them."""
        pieces = self._cut.split(stretch) if self._cut else [stretch]
        if len(pieces) == 1:
            return self._pre_tokens(stretch)
        found: list[bytes | int] = []
        for i, piece in enumerate(pieces):
            if i % 2:
                found.append(self._added[piece])
            elif piece:
                found.extend(self._pre_tokens(piece))
        return found

    def _learn(self, stretches: set[bytes]) -> dict[bytes, bytes]:
        """Packed ids of stretches; all words that are new are merged together."""
        made = {s: self._parts(s) for s in stretches}
        words = {w for found in made.values() for w in found if isinstance(w, bytes)}
        new = [w for w in words if w not in self._words]
        if len(self._words) + len(new) > REMEMBERED:
            self._words.clear()
            new = list(words)
        ids = self._words
        ids.update(zip(new, self._merger.merge(new), strict=True))
        learnt = {
            s: ids[found[0]]
            if len(found) == 1 and isinstance(found[0], bytes)
            else b"".join(
                [ids[w] if isinstance(w, bytes) else w.to_bytes(4, "little") for w in found]
            )
            for s, found in made.items()
        }
        for w in new:
            if len(w) > LONGEST_REMEMBERED:
                del ids[w]
        return learnt

    def encode_chunk(self, texts: list[bytes]) -> list[bytes]:
        cut = [t.split() for t in texts]
        wanted = set().union(*cut)
        table = self._stretches
        new = wanted.difference(table)
        if len(table) + len(new) > REMEMBERED:
            table.clear()
            new = wanted
        table.update(self._learn(new))
        encoded = [b"".join([table[s] for s in stretches]) for stretches in cut]
        for s in new:
            if len(s) > LONGEST_REMEMBERED:
                del table[s]
        return encoded

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; null and empty have none."""
        done: list[bytes] = []
        chunk, size = [], 0
        for text in texts:
            raw = (text or "").encode()
            if chunk and size + len(raw) > CHUNK_BYTES:
                done += self.encode_chunk(chunk)
                chunk, size = [], 0
            chunk.append(raw)
            size += len(raw)
        return done + self.encode_chunk(chunk) if chunk else done


class Decoder:
    """Texts of token ids: the tokens' own strings, joined by one space."""

    def __init__(self, vocabulary: str) -> None:
        parts = json.loads(vocabulary)
        added = {t["content"]: t["id"] for t in parts.get("added_tokens") or []}
        strings = parts["model"]["vocab"] | added
        size = max(strings.values()) + 1
        tokens = [b""] * size
        for string, i in strings.items():
            tokens[i] = string.encode() + b" "
        self._length = np.array([len(t) for t in tokens], dtype=np.int64)
        self._start = np.cumsum(self._length) - self._length
        self._letters = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, packed: bytes | None) -> str:
        """Ids outside the vocabulary give nothing."""
        ids = np.frombuffer(packed or b"", dtype="<u4").astype(np.int64)
        ids = ids[ids < len(self._length)]
        parts = [self._gather(ids[i : i + CHUNK_BYTES]) for i in range(0, len(ids), CHUNK_BYTES)]
        return b"".join(parts)[:-1].decode()

    def _gather(self, ids: np.ndarray) -> bytes:
        lengths = self._length[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self._start[ids] - (ends - lengths), lengths)
        return self._letters[shift + np.arange(len(shift))].tobytes()


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> Encoder:
    """One encoder per worker process, kept from task to task."""
    return Encoder(vocabulary)


@lru_cache(maxsize=2)
def _decoder(vocabulary: str) -> Decoder:
    return Decoder(vocabulary)


def packed_ids(spark: SparkSession, text: Column, path: str) -> Column:
    """Token ids of each text as one binary of little-endian unsigned 32-bit numbers.

    As the library encodes without added special tokens; the string of an added
    token inside a text is that token, as is its default. Null and empty texts
    and texts of white space only have no ids, an empty binary. Texts are never
    cut. The vocabulary file is read on the driver only.
    """
    shared = spark.sparkContext.broadcast(checked_vocabulary(path))

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared.value)
        for texts in batches:
            yield pd.Series(encoder.encode(texts.tolist()), dtype=object)

    return encoded(text)


def token_ids(spark: SparkSession, text: Column, path: str) -> Column:
    """Token ids of each text as an array<int>; see `packed_ids`."""
    shared = spark.sparkContext.broadcast(checked_vocabulary(path))

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared.value)
        for texts in batches:
            packed = encoder.encode(texts.tolist())
            yield pd.Series([np.frombuffer(p, dtype="<i4") for p in packed], dtype=object)

    return encoded(text)


def decoded(spark: SparkSession, packed: Column, path: str) -> Column:
    """The text of packed ids as the library decodes it, special tokens included.

    A null or empty binary gives the empty text.
    """
    shared = spark.sparkContext.broadcast(checked_vocabulary(path))

    @F.pandas_udf("string")
    def strings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = _decoder(shared.value)
        for ids in batches:
            yield pd.Series([decoder.decode(i) for i in ids.tolist()], dtype=object)

    return strings(packed)


def round_trip(spark: SparkSession, text: Column, path: str) -> Column:
    """Struct of `packed_ids` and the text they are `decoded` to, in one pass of one worker."""
    shared = spark.sparkContext.broadcast(checked_vocabulary(path))

    @F.pandas_udf("struct<ids: binary, text: string>")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = _encoder(shared.value), _decoder(shared.value)
        for texts in batches:
            packed = encoder.encode(texts.tolist())
            yield pd.DataFrame({"ids": packed, "text": [decoder.decode(p) for p in packed]})

    return coded(text)
