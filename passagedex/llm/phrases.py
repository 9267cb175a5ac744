"""Phrase collocations, counted in suffix subtrees over groups of prefixes.

A phrase of up to five words is a node near the root of the suffix tree of its
language: its count is the sum of the leaves below. The tree is never built
whole. Prefixes are counted first and grouped under a budget of suffixes, those
over the budget being replaced by their extensions; every suffix, truncated to
five words, goes to its prefix's group; and each group builds its subtrees alone,
from its suffixes in order, of which only the open path is held.

Suffixes are cut short where a word, or a pair of words, occurs too rarely for
any phrase that holds it. Which ones do is looked up in bitmaps of bounded size;
what these let through needlessly is dropped by its count.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagedex.llm.common import column
from passagedex.session import cut_lineage

UNKNOWN = "und"

# Letters of texts coded together; bounds the memory of a worker.
CHUNK_BYTES = 6 << 20

# Distinct suffixes a group holds, and groups at most: beyond that groups are larger.
GROUP_ROWS = 1 << 17
MAX_GROUPS = 1 << 18
# Groups for every task, as far as there are suffixes.
GROUPS_PER_TASK = 4
# Letters of a bound between groups; a longer prefix bounds as well when cut.
BOUND_LETTERS = 200

# Bits of a bitmap: sixteen per entry, within these.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29

# A phrase's words in one string that sorts as the words do: \x00 between them,
# \x00 and \x01 inside a word written as \x01 and a letter.
GAP = b"\x00"

# A-Z lower-cased, tab as space, and the characters that end a piece as full stops.
LETTERS = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz ........."
)

NODE = "lang string, phrase string, n bigint"


class _Codes(dict):
    """A number for every word, from 1 on; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _escaped(word: bytes) -> bytes:
    if b"\x00" in word or b"\x01" in word:
        return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")
    return word


def spaced(phrase: Column) -> Column:
    """The words of a phrase joined by spaces."""
    apart = F.replace(phrase, F.lit("\x00"), F.lit(" "))
    return F.replace(
        F.replace(apart, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01")
    )


def word_array(phrase: Column) -> Column:
    return F.split(phrase, "\x00")


def joined(words: Column, first: Column, n: Column) -> Column:
    """The phrase of n words of an array from word `first` on."""
    return F.array_join(F.slice(words, first, n), "\x00")


class Chunk:
    """Texts of one language as an array of word codes, 0 between pieces."""

    def __init__(self, lang: str, texts: Iterable[bytes]) -> None:
        self.lang = lang
        codes = _Codes()
        joined = b" . ".join(t.translate(LETTERS) for t in texts).replace(b".", b" . ")
        self.codes = np.array([codes[w] for w in joined.split()], dtype=np.int64)
        self.words = [b"", *map(_escaped, list(codes)[1:])]

    def hashes(self) -> np.ndarray:
        """A 32-bit hash of each word with its language."""
        seed = zlib.crc32(self.lang.encode() + GAP)
        return np.array([zlib.crc32(w, seed) for w in self.words], dtype=np.uint64)

    def keep(self, frequent: np.ndarray) -> None:
        """Words outside a bitmap end a piece; the others are numbered anew."""
        kept = set_in(frequent, self.hashes())
        kept[0] = False
        number = np.cumsum(kept) * kept
        self.codes = number[self.codes]
        self.words = [b"", *(w for w, k in zip(self.words, kept, strict=True) if k)]

    def pair_hashes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        hashes = self.hashes()
        return pair_hash(hashes[left], hashes[right])


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 32-bit mix of the hashes of two words."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFF)


def set_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set in a bitmap of longs, a power of two many bits."""
    place = hashes & np.uint64(64 * len(bits) - 1)
    word = bits[(place >> np.uint64(6)).astype(np.int64)]
    return (word >> (place & np.uint64(63))) & np.uint64(1) == 1


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Rows (lang, text) as chunks of one language each."""
    waiting: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        langs = batch["lang"].to_pylist()
        for lang, text in zip(langs, batch["text"], strict=True):
            raw = (text.as_py() or "").encode()
            # A very long text is taken in pieces, across which no phrase goes.
            long = len(raw) > CHUNK_BYTES
            for part in raw.translate(LETTERS).split(b".") if long else [raw]:
                waiting.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part) + 1
                if sum(size.values()) >= CHUNK_BYTES:
                    largest = max(size, key=size.__getitem__)
                    del size[largest]
                    yield Chunk(largest, waiting.pop(largest))
    for lang, texts in waiting.items():
        yield Chunk(lang, texts)


def _counted(chunk: Chunk, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chunk.lang] * len(phrases), pa.string()),
            pa.array(phrases, pa.binary()).cast(pa.string()),
            pa.array(counts, pa.int64()),
        ],
        names=["lang", "phrase", "n"],
    )


def _word_counts(chunk: Chunk) -> pa.RecordBatch:
    counts = np.bincount(chunk.codes, minlength=len(chunk.words))
    return _counted(chunk, chunk.words[1:], counts[1:])


def _pairs(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Where two words follow each other in a piece, and their pair number."""
    left, right = chunk.codes[:-1], chunk.codes[1:]
    at = np.flatnonzero((left > 0) & (right > 0))
    return at, left[at] * len(chunk.words) + right[at]


def _pair_counts(chunk: Chunk) -> pa.RecordBatch:
    """Pairs of words counted by a hash of 32 bits.

    The count of a hash is at least that of each of its pairs, so pairs of rare
    hashes are rare. Counts of phrases themselves never come from hashes.
    """
    pairs, counts = np.unique(_pairs(chunk)[1], return_counts=True)
    hashes = chunk.pair_hashes(*np.divmod(pairs, len(chunk.words)))
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes.astype(np.uint32).view(np.int32)), pa.array(counts, pa.int64())],
        names=["hash", "n"],
    )


def _suffixes(chunk: Chunk, frequent_pairs: np.ndarray, max_words: int) -> pa.RecordBatch:
    """The distinct truncated suffixes of two words or more of a chunk, with their counts."""
    codes = chunk.codes
    at, pairs = _pairs(chunk)
    distinct, which = np.unique(pairs, return_inverse=True)
    left, right = np.divmod(distinct, len(chunk.words))
    goes_on = np.zeros(len(codes) + max_words, dtype=bool)
    goes_on[at] = set_in(frequent_pairs, chunk.pair_hashes(left, right))[which]
    start = np.flatnonzero(goes_on)
    padded = np.append(codes, np.zeros(max_words, dtype=np.int64))
    alive = np.ones(len(start), dtype=bool)
    columns = [codes[start]]
    for d in range(1, max_words):
        alive = alive & goes_on[start + d - 1]
        columns.append(np.where(alive, padded[start + d], 0))
    order = np.lexsort(_packed(columns, len(chunk.words)))
    columns = [c[order] for c in columns]
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(order)))
    words = chunk.words
    rows = zip(*[c[first].tolist() for c in columns], strict=True)
    phrases = [GAP.join([words[c] for c in row if c]) for row in rows]
    return _counted(chunk, phrases, counts)


def _packed(columns: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Sort keys, the last the first: columns packed into longs as many as fit."""
    width = max(1, n.bit_length())
    per_key = max(1, 62 // width)
    keys = []
    for i in range(0, len(columns), per_key):
        key = columns[i]
        for c in columns[i + 1 : i + per_key]:
            key = (key << width) | c
        keys.append(key)
    return keys[::-1]


def _scanned(
    docs: DataFrame,
    rows_of: Callable[[Chunk], pa.RecordBatch],
    schema: str = NODE,
    frequent_words: Broadcast | None = None,
) -> DataFrame:
    """Counts that a function makes of all chunks of (lang, text), summed.

    With a bitmap of words, all others end a piece.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            if frequent_words is not None:
                chunk.keep(frequent_words.value)
            made = rows_of(chunk)
            for i in range(0, made.num_rows, 100_000):
                yield made.slice(i, 100_000)

    return _summed(docs.mapInArrow(scan, schema))


def _summed(counts: DataFrame) -> DataFrame:
    keys = [c for c in counts.columns if c != "n"]
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"))


def _bitmap(hashes: DataFrame) -> Broadcast:
    """Broadcast bitmap of 32-bit numbers `hash`, sixteen bits for each, up to 64 MB."""
    spark = hashes.sparkSession
    bits = LEAST_BITS
    wanted = min(16 * hashes.count(), MOST_BITS)
    while bits < wanted:
        bits *= 2
    at = F.col("hash").cast("long").bitwiseAND(F.lit(bits - 1))
    table = (
        hashes.select(
            F.shiftright(at, 6).alias("place"),
            F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bits"),
        )
        .groupBy("place")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    filled = np.zeros(bits // 64, dtype=np.uint64)
    filled[table["place"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(filled)


def _group_bounds(suffixes: DataFrame, max_words: int) -> list[tuple[bytes, bytes]]:
    """The first prefix (lang, words) of every group but the first, in order.

    Prefixes of one word are counted. Those with more suffixes than a group may
    hold are replaced by their extensions, until none is left; at full depth a
    prefix is a single suffix. Neighbours in order then share groups.
    """
    spark = suffixes.sparkSession
    total = suffixes.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    budget = max(
        1, -(-total // MAX_GROUPS), min(GROUP_ROWS, total // (GROUPS_PER_TASK * tasks))
    )
    fitting, over = [], None
    for depth in range(1, max_words + 1):
        sizes = cut_lineage(_prefix_sizes(suffixes, depth, over))
        fitting.append(sizes.where(F.col("n") <= budget))
        # At most total / budget of them, so no more than there may be groups.
        found = sizes.where(F.col("n") > budget).select("lang", "phrase").collect()
        if not found or depth == max_words:
            break
        over = spark.sparkContext.broadcast({(r[0], r[1]) for r in found})
    prefixes = fitting[0]
    for more in fitting[1:]:
        prefixes = prefixes.unionByName(more)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = budget
        for batch in batches:
            first = np.zeros(batch.num_rows, dtype=bool)
            for i, size in enumerate(batch["n"].to_pylist()):
                first[i] = filled + size > budget
                filled = size if first[i] else filled + size
            yield batch.select(["lang", "phrase"]).filter(pa.array(first))

    in_order = prefixes.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")
    bounds = in_order.withColumn("phrase", F.substring("phrase", 1, BOUND_LETTERS)).mapInArrow(
        packed, "lang string, phrase string"
    )
    firsts = {(r[0].encode(), r[1].encode()) for r in bounds.collect()}
    return sorted(firsts)[1:]


def _prefix_sizes(suffixes: DataFrame, depth: int, of: Broadcast | None) -> DataFrame:
    """(lang, phrase, n): suffixes below each prefix of `depth` words.

    Only below the prefixes of one word less in `of`, if it is given.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for lang, phrase in zip(
                batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True
            ):
                words = phrase.split("\x00", depth)[:depth]
                if of is None or (lang, "\x00".join(words[: depth - 1])) in of.value:
                    counts[lang, "\x00".join(words)] += 1
            langs, phrases = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()),
                    pa.array(phrases, pa.string()),
                    pa.array(counts.values(), pa.int64()),
                ],
                names=["lang", "phrase", "n"],
            )

    return _summed(suffixes.select("lang", "phrase").mapInArrow(counted, NODE))


def _grouped(suffixes: DataFrame, bounds: list[tuple[bytes, bytes]]) -> DataFrame:
    """Suffixes with their group, each group in order within one partition."""
    spark = suffixes.sparkSession
    shared = spark.sparkContext.broadcast(bounds)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True)
            group = [bisect_right(shared.value, (a.encode(), b.encode())) for a, b in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.int32()), *batch.columns],
                names=["grp", *batch.schema.names],
            )

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, len(bounds) // (4 * GROUPS_PER_TASK))
    placed = suffixes.mapInArrow(dealt, f"grp int, {NODE}")
    return placed.repartition(parts, "grp").sortWithinPartitions("grp", "lang", "phrase")


class _Subtrees:
    """Totals of the nodes of one group after another, from suffixes in order.

    Nodes have two words or more, as single words are counted before. Only the
    open path is held. A node below `min_count` is given as well if it
    is on the first or last path of its group, as its suffixes may go on there.
    """

    def __init__(self, min_count: int, max_words: int) -> None:
        self.min_count, self.max_words = min_count, max_words
        self.path: list[tuple] = []  # (grp, lang), then words, of the open nodes
        self.totals = [0] * (max_words + 1)
        self.on_first_path = [True] * (max_words + 1)
        self.made: list[tuple[str, bytes, int]] = []

    def _close(self, depth: int, last: bool) -> None:
        """Nodes of more than `depth` words end."""
        while len(self.path) - 1 > depth:
            level = len(self.path) - 1
            on_edge = last or self.on_first_path[level]
            if level > 1 and (on_edge or self.totals[level] >= self.min_count):
                phrase = GAP.join(self.path[1:])
                self.made.append((self.path[0][1], phrase, self.totals[level]))
            self.path.pop()
            self.on_first_path[level] = False

    def add(self, group: int, lang: str, phrase: str, n: int) -> None:
        if not self.path or self.path[0] != (group, lang):
            self._close(0, last=True)
            self.path = [(group, lang)]
            self.on_first_path = [True] * (self.max_words + 1)
        words = phrase.encode().split(GAP)
        same = 0
        while same < min(len(words), len(self.path) - 1) and words[same] == self.path[same + 1]:
            same += 1
        self._close(same, last=False)
        for level in range(same + 1, len(words) + 1):
            self.path.append(words[level - 1])
            self.totals[level] = 0
        for level in range(1, len(words) + 1):
            self.totals[level] += n

    def end(self) -> None:
        self._close(0, last=True)

    def taken(self) -> pa.RecordBatch:
        made, self.made = self.made, []
        langs, phrases, counts = zip(*made, strict=True) if made else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.string()),
                pa.array(phrases, pa.binary()).cast(pa.string()),
                pa.array(counts, pa.int64()),
            ],
            names=["lang", "phrase", "n"],
        )


def _nodes(grouped: DataFrame, min_count: int, max_words: int) -> DataFrame:
    """(lang, phrase, n) of every phrase of two words or more that occurs `min_count` times."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Subtrees(min_count, max_words)
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("grp", "lang", "phrase", "n")]
            for row in zip(*columns, strict=True):
                trees.add(*row)
            yield trees.taken()
        trees.end()
        yield trees.taken()

    return _summed(grouped.mapInArrow(built, NODE)).where(F.col("n") >= min_count)


def phrase_counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = 5,
    min_count: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all frequent phrases, single words included, and (lang, n) of all words.

    Phrases are in the form that `spaced` reads.
    """
    rows = docs.select(
        F.coalesce(column(docs, lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        column(docs, text).alias("text"),
    )
    frequent = F.col("n") >= min_count
    words = cut_lineage(_scanned(rows, _word_counts))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    singles = words.where(frequent)
    key = F.concat("lang", F.lit("\x00"), "phrase").cast("binary")
    word_bits = _bitmap(singles.select(F.crc32(key).alias("hash")))
    pairs = _scanned(rows, _pair_counts, "hash int, n bigint", word_bits).where(frequent)
    pair_bits = _bitmap(cut_lineage(pairs.select("hash")))
    suffixes = cut_lineage(
        _scanned(
            rows,
            lambda chunk: _suffixes(chunk, pair_bits.value, max_words),
            frequent_words=word_bits,
        )
    )
    bounds = _group_bounds(suffixes, max_words)
    longer = _nodes(_grouped(suffixes, bounds), min_count, max_words)
    return singles.unionByName(longer), totals


def _looked_up(rows: DataFrame, on: list[str], values: DataFrame) -> DataFrame:
    """Rows with the columns of `values`, which has each key once.

    Keys that own over a thousandth of the rows are fewer than a thousand; they
    are joined by broadcast and only the rest by shuffle.
    """
    share = rows.count() // 1000
    common = rows.groupBy(*on).count().where(F.col("count") > share).drop("count")
    common = cut_lineage(common.join(values, on))
    others = rows.join(F.broadcast(common.select(*on)), on, "left_anti").join(values, on)
    return rows.join(F.broadcast(common), on).unionByName(others)


def mine_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = 5,
    min_count: int = 100,
    covered_percent: int = 100,
    top: int = 2000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best collocations.

    Candidates are phrases of two to `max_words` words, within pieces between
    punctuation or line ends, that occur `min_count` times or more: a. Of their
    cuts in two, the one with the lowest floor(1000 * a * n / (l * r)) counts,
    the first of equal ones; n is the number of words of the language, l and r
    the counts of both parts. A candidate goes if a longer one that holds it has
    at least `covered_percent` of its count. Ranks are by score, then a, then the
    phrase bytewise.

    Texts are lower-cased in A-Z only; null and empty texts have no words, a null
    language is `und`, repeated rows count repeatedly and an empty table gives no
    rows. Counts are exact and products are taken in 38 digits.
    """
    if not 0 < covered_percent <= 100 or max_words < 2 or min_count < 1 or top < 1:
        raise ValueError("covered_percent must be 1 to 100, max_words 2, min_count and top 1 or more")
    counted, totals = phrase_counts(docs, text, lang, max_words, min_count)
    nodes = cut_lineage(counted)
    words, size = F.col("words"), F.size("words")
    candidates = nodes.withColumn("words", word_array(F.col("phrase"))).where(size > 1)
    # A phrase inside a longer one is inside one that has a word more and counts
    # at least as often, so covers of one more word decide.
    shorter = F.array(joined(words, F.lit(1), size - 1), joined(words, F.lit(2), size - 1))
    covers = (
        candidates.where(size > 2)
        .select("lang", F.explode(shorter).alias("phrase"), "n")
        .groupBy("lang", "phrase")
        .agg(F.max("n").alias("longer"))
    )
    kept = candidates.join(covers, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * covered_percent)
    )
    cuts = (
        kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
        .select(
            "lang",
            "phrase",
            F.col("n").alias("a"),
            "k",
            joined(words, F.lit(1), F.col("k")).alias("first"),
            joined(words, F.col("k") + 1, size - F.col("k")).alias("rest"),
        )
    )

    def counts_of(part: str, name: str) -> DataFrame:
        return nodes.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))

    scored = _looked_up(cut_lineage(cuts), ["lang", "first"], counts_of("first", "l"))
    scored = _looked_up(cut_lineage(scored), ["lang", "rest"], counts_of("rest", "r"))
    scored = _looked_up(cut_lineage(scored), ["lang"], totals)
    a, l, r, n = (F.col(c).cast("decimal(19,0)") for c in "alrn")  # noqa: E741
    scored = scored.withColumn("over", a * 1000 * n).withColumn("under", l * r)
    scored = scored.withColumn("score", F.expr("`over` div `under`"))
    lowest = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")
    )
    listed = lowest.select("lang", spaced(F.col("phrase")).alias("phrase"), "cut.*")
    return _top(listed, top)


def _top(listed: DataFrame, top: int) -> DataFrame:
    """The first rows of every language, first within slices of it."""
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    in_slice = Window.partitionBy("lang", "slice").orderBy(*best)
    of_lang = Window.partitionBy("lang").orderBy(*best)
    return (
        listed.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        .withColumn("rank", F.row_number().over(in_slice))
        .where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(of_lang))
        .where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
