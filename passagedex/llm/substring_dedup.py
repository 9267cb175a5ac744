"""Removal of repeated passages with suffix automata of reference shards.

A passage repeats if a window of 35 consecutive words also starts elsewhere.
Streaming every document past an automaton of every shard of its own corpus
would take time with the square of the corpus, so automata are built only where
words have to be compared, and documents meet only the shards that can match:

1. Every window has an anchor: the eight-word run in it with the smallest hash,
   the first of equal ones. Equal windows have equal anchors, so a window whose
   anchor occurs once in the corpus cannot repeat.
2. Consecutive windows with one anchor form an extent, 62 words at most. If all
   extents of an anchor are equal, all their windows repeat: the inside of
   copied passages, however often copied, ends here.
3. The distinct extents of the other anchors, dealt by anchor, are the reference
   shards. Each shard's suffix automaton counts how often each state occurs; the
   extents are streamed through it for matching statistics, and every window
   whose state occurs twice repeats. Extents of one anchor stay in one shard.
4. Anchors with more distinct extents than a shard holds, as at the edge of a
   passage that a large part of the corpus quotes, have parts of extents and at
   the edges single windows counted by 128-bit hashes instead, so no task ever
   holds an anchor's extents.

Words are told apart by 64-bit hashes up to step 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagedex.llm.common import column, unused, whole, word_list
from passagedex.llm.shingles import mix, powers, run_hashes, word_hashes
from passagedex.sources.storage import fresh_folder

WINDOW = 35
ANCHOR = 8
SPAN = WINDOW - ANCHOR + 1
# Words after which a shard's automaton is built, and the most distinct extents
# an anchor may have to be in one: some 100 MB of states.
SHARD_WORDS = 20_000
SHARD_EXTENTS = 1_000
# Windows of larger anchors that are first taken together; divides SPAN.
PART = 7


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: read again, never computed again."""
    path = fresh_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of the extents of a text's word hashes."""
    if len(words) < WINDOW:
        none = np.empty(0, dtype=np.int64)
        return none.view(np.uint64), none, none
    runs = run_hashes(words, ANCHOR)
    view = np.lib.stride_tricks.sliding_window_view(runs, SPAN)
    # Long texts in parts, so that no part of the comparison grows with them.
    least = np.concatenate([view[i : i + 65536].argmin(axis=1) for i in range(0, len(view), 65536)])
    place = least + np.arange(len(view))
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    return runs[place[first]], first, np.diff(np.append(first, len(place)))


def _flat(values: list, kind) -> pa.Array:
    return pa.array(np.concatenate(values) if values else np.empty(0, dtype=np.int64), kind)


def find_anchors(rows: DataFrame) -> DataFrame:
    """Rows (key, text) to one row (anchor, key, extent) for each extent.

    `extent` is the first window times 32, plus the number of windows less one.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, extents = [], [], []
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text:
                    anchor, first, n = anchors(word_hashes(text.encode()))
                    keys.append(np.full(len(first), key, dtype=np.int64))
                    hashes.append(anchor.view(np.int64))
                    extents.append(first * 32 + n - 1)
            yield pa.RecordBatch.from_arrays(
                [_flat(x, pa.int64()) for x in (hashes, keys, extents)],
                names=["anchor", "key", "extent"],
            )

    return rows.select("key", "text").mapInArrow(found, "anchor bigint, key bigint, extent bigint")


def read_extents(marked: DataFrame) -> DataFrame:
    """Rows (key, text, marks) to (anchor, content, key, extent, words) for each mark.

    `content` is a hash of the extent's words; `words` are the words themselves.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("anchor", "content", "key", "extent", "words")}
            for key, text, marks in zip(
                batch["key"].to_pylist(),
                batch["text"].to_pylist(),
                batch["marks"].to_pylist(),
                strict=True,
            ):
                raw = text.encode()
                hashes = word_hashes(raw)
                words = raw.translate(TO_SPACE).split()
                up, down = powers(len(hashes) + 1)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])))
                extent = np.array([m["extent"] for m in marks], dtype=np.int64)
                first, stop = extent // 32, extent // 32 + extent % 32 + WINDOW
                content = mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64))
                rows["anchor"] += [m["anchor"] for m in marks]
                rows["content"] += content.view(np.int64).tolist()
                rows["key"] += [key] * len(marks)
                rows["extent"] += extent.tolist()
                rows["words"] += [
                    b" ".join(words[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[k], pa.int64() if k != "words" else pa.binary())
                    for k in rows
                ],
                names=list(rows),
            )

    schema = "anchor bigint, content bigint, key bigint, extent bigint, words binary"
    return marked.select("key", "text", "marks").mapInArrow(read, schema)


TO_SPACE = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with how often each state occurs."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, at: int, word: bytes, target: int) -> int:
        """A copy of `target` for the suffixes that end with `word` after state `at`."""
        copy = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[bytes], times: int) -> None:
        """A sequence that occurs `times` times."""
        last = 0
        for word in words:
            target = self.next[last].get(word)
            if target is not None:
                if self.length[target] != self.length[last] + 1:
                    target = self._split(last, word, target)
                last = target
            else:
                new, at = self._state(self.length[last] + 1, {}, 0), last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    target = self.next[at][word]
                    if self.length[target] != self.length[at] + 1:
                        target = self._split(at, word, target)
                    self.link[new] = target
                last = new
            self.count[last] += times

    def finish(self) -> None:
        """Count what occurs as the suffix of something longer."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def repeats(self, words: list[bytes], window: int = WINDOW) -> int:
        """Bit i is set if the window that starts at word i occurs at least twice.

        Streams the words for the longest match that ends at each of them.
        """
        state = matched = bits = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if matched >= window:
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                matched = min(matched, self.length[state])
                if self.count[state] > 1:
                    bits |= 1 << (i - window + 1)
        return bits


MASKS = "anchor bigint, content bigint, mask bigint"


def match_in_shards(extents: DataFrame) -> DataFrame:
    """(anchor, content, mask) of distinct extents (anchor, content, words, times)."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, last = [], 0, None

        def streamed() -> pa.RecordBatch:
            automaton = SuffixAutomaton()
            for _, _, words, times in shard:
                automaton.add(words, times)
            automaton.finish()
            columns = (
                [row[0] for row in shard],
                [row[1] for row in shard],
                [automaton.repeats(row[2]) for row in shard],
            )
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["anchor", "content", "mask"]
            )

        for batch in batches:
            for row in batch.to_pylist():
                if size >= SHARD_WORDS and row["anchor"] != last:
                    yield streamed()
                    shard, size = [], 0
                words = row["words"].split(b" ")
                shard.append((row["anchor"], row["content"], words, row["times"]))
                size, last = size + len(words), row["anchor"]
        if shard:
            yield streamed()

    n_tasks = int(extents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = extents.repartition(n_tasks, "anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "content", "words", "times").mapInArrow(matched, MASKS)


def _parts(words: list[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first window, windows, core) of the parts of an extent.

    Windows are told apart by how many words stand before their anchor; a part
    has PART consecutive numbers of them. The core is what all windows of the
    part have in common, so equal windows have equal cores.
    """
    runs = run_hashes(word_hashes(b" ".join(words)), ANCHOR)
    anchor = int(runs[:SPAN].argmin())
    place, n = 0, len(words) - WINDOW + 1
    while place < n:
        part = (anchor - place) // PART
        stop = min(n, anchor - part * PART + 1)
        start = anchor - part * PART
        yield place, stop - place, words[start : start + WINDOW - PART + 1]
        place = stop


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def match_by_windows(extents: DataFrame) -> DataFrame:
    """The same for anchors with more extents than a shard holds.

    Windows are first taken in parts. A part whose core is nowhere else cannot
    repeat, and parts that are equal wherever their core is repeat as a whole;
    only the windows of the other parts, at the edges of passages, are counted.
    """

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                words = row["words"].split(b" ")
                same = (row["anchor"], row["content"], row["times"])
                for place, n, core in _parts(words):
                    own = words[place : place + n + WINDOW - 1]
                    rows.append((*same, place, n, _digest(core), _digest(own), b" ".join(own)))
            yield _batch(PART_COLUMNS, rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                words = row["words"].split(b" ")
                same = (row["anchor"], row["content"], row["times"])
                for i in range(row["n"]):
                    rows.append((*same, row["place"] + i, _digest(words[i : i + WINDOW])))
            yield _batch(WINDOW_COLUMNS, rows)

    parts = extents.select("anchor", "content", "words", "times").mapInArrow(
        divided, _ddl(PART_COLUMNS)
    )
    cores = parts.groupBy(F.col("core").alias("k")).agg(
        F.sum("times").alias("all_times"), F.min("own").alias("low"), F.max("own").alias("high")
    )
    repeated = parts.join(cores.where("all_times > 1"), F.col("core") == F.col("k"))
    equal = repeated.where("low = high").select(
        "anchor",
        "content",
        F.expr("shiftleft(shiftleft(1L, int(n)) - 1, int(place))").alias("bits"),
    )
    edges = repeated.where("low != high").select(
        "anchor", "content", "times", "place", "n", "words"
    )
    windows = edges.mapInArrow(cut, _ddl(WINDOW_COLUMNS))
    twice = windows.groupBy(F.col("window").alias("k")).agg(F.sum("times").alias("all_times"))
    single = windows.join(twice.where("all_times > 1"), F.col("window") == F.col("k")).select(
        "anchor", "content", F.expr("shiftleft(1L, int(place))").alias("bits")
    )
    found = equal.unionByName(single).groupBy("anchor", "content")
    return found.agg(F.bit_or("bits").alias("mask"))


PART_COLUMNS = {k: pa.int64() for k in ("anchor", "content", "times", "place", "n")} | {
    k: pa.binary() for k in ("core", "own", "words")
}
WINDOW_COLUMNS = {k: pa.int64() for k in ("anchor", "content", "times", "place")} | {
    "window": pa.binary()
}


def _ddl(columns: dict) -> str:
    return ", ".join(f"{k} {'bigint' if t == pa.int64() else 'binary'}" for k, t in columns.items())


def _batch(columns: dict, rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(columns.values())]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _repeated_windows(marked: DataFrame) -> DataFrame:
    """(key, runs) of marked texts (key, text, marks): runs of extent and mask of windows."""
    extents = written(read_extents(marked), "extents")
    contents = extents.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"))
    per_anchor = contents.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n_contents"), F.sum("times").alias("n")
    )
    mixed = per_anchor.where("n_contents > 1").select(F.col("anchor").alias("k"), "n_contents")
    distinct = (
        extents.join(mixed, F.col("anchor") == F.col("k"))
        .groupBy("anchor", "content", "n_contents")
        .agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("times"))
    )
    masks = match_in_shards(distinct.where(F.col("n_contents") <= SHARD_EXTENTS)).unionByName(
        match_by_windows(distinct.where(F.col("n_contents") > SHARD_EXTENTS))
    )
    masks = masks.select(F.col("anchor").alias("a"), F.col("content").alias("c"), "mask")
    kinds = per_anchor.where("n > 1").select(F.col("anchor").alias("k"), "n_contents")
    every = F.expr("shiftleft(1L, int(extent % 32) + 1) - 1")
    judged = (
        extents.select("anchor", "content", "key", "extent")
        .join(kinds, F.col("anchor") == F.col("k"))
        .join(masks, (F.col("anchor") == F.col("a")) & (F.col("content") == F.col("c")), "left")
        .withColumn("mask", F.when(F.col("n_contents") == 1, every).otherwise(F.col("mask")))
    )
    return (
        judged.where("mask != 0")
        .groupBy(F.col("key").alias("run_key"))
        .agg(F.collect_set(F.struct("extent", "mask")).alias("runs"))
    )


REPEATS = (
    "n_words bigint, n_removed bigint, spans array<struct<first:bigint,last:bigint>>, "
    "kept_sha256 string"
)


def _covered(n_words: int, runs: list | None) -> np.ndarray:
    """Which words lie in a repeated window."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    for run in [] if runs is None else runs:
        for i in range(run["extent"] % 32 + 1):
            if run["mask"] >> i & 1:
                edges[run["extent"] // 32 + i] += 1
                edges[run["extent"] // 32 + i + WINDOW] -= 1
    return np.cumsum(edges)[:-1] > 0


def _measure(text: str, runs: list | None) -> tuple:
    words = text.encode().translate(TO_SPACE).split()
    gone = _covered(len(words), runs)
    steps = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    spans = [
        {"first": int(a), "last": int(b) - 1}
        for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1), strict=True)
    ]
    kept = b" ".join(w for w, out in zip(words, gone, strict=True) if not out)
    return len(words), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def find_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The table with one more column `repeats`: what of each text occurs elsewhere.

    repeats is a struct of n_words, n_removed (words in a window of 35 words that
    also starts at another place, in this or another row), spans (first, last:
    word numbers of the removed runs) and kept_sha256 (of the other words, joined
    by one space). Texts of fewer words than a window, empty and null ones keep
    all they have. All occurrences are found, the first included, so repeated
    rows with enough words are removed whole. An input column `repeats` is
    replaced; other columns are kept.

    Rows are told apart by a 64-bit hash of id and text; rows equal in both share
    it and fare alike.
    """
    docs = docs.drop("repeats")
    key = F.xxhash64(column(docs, doc_id).cast("string"), column(docs, text))
    rows = docs.select(key.alias("key"), column(docs, text).alias("text"), F.struct("*").alias("doc"))

    found = written(find_anchors(rows), "anchors")
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = (
        found.join(twice.select(F.col("anchor").alias("k")), F.col("anchor") == F.col("k"))
        .groupBy(F.col("key").alias("mark_key"))
        .agg(F.collect_set(F.struct("anchor", "extent")).alias("marks"))
    )
    marked = written(
        rows.join(marks, F.col("key") == F.col("mark_key")).select("key", "text", "doc", "marks"),
        "marked",
    )
    runs = _repeated_windows(marked)

    @F.pandas_udf(REPEATS)
    def measured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, masks in batches:
            made = [_measure(t, r) for t, r in zip(texts, masks, strict=True)]
            yield pd.DataFrame(made, columns=["n_words", "n_removed", "spans", "kept_sha256"])

    removed = marked.join(runs, F.col("key") == F.col("run_key"), "left").select(
        "doc.*", measured("text", "runs").alias("repeats")
    )
    words = word_list(F.col("text"))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    untouched = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_removed"),
        none.alias("spans"),
        F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("kept_sha256"),
    )
    known = marked.select(F.col("key").alias("k")).distinct()
    others = rows.select("key", "doc", untouched.alias("repeats")).join(
        known, F.col("key") == F.col("k"), "left_anti"
    )
    return removed.unionByName(others.select("doc.*", "repeats"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows with all repeated windows cut from their texts; same columns.

    A text that loses words becomes its other words, each with the white space
    that follows it; others stay byte for byte.
    """
    marked = unused(docs, "repeats")
    found = find_repeats(docs.withColumnRenamed("repeats", marked), text, doc_id)
    pieces = F.regexp_extract_all(
        whole(column(found, text)), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)
    )
    spans = F.col("repeats.spans")
    kept = F.filter(
        pieces, lambda _, i: ~F.exists(spans, lambda s: (s["first"] <= i) & (i <= s["last"]))
    )
    shown = F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(column(found, text))
    cleaned = found.withColumn(text, shown).drop("repeats")
    return cleaned.withColumnRenamed(marked, "repeats") if marked in cleaned.columns else cleaned
