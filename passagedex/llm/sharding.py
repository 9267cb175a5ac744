"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups, largest first, each go to the fullest shard that still has room for
them; shards are kept in a balanced tree by remaining capacity. Packing every
group of a large corpus in one place is not possible, so packing has two levels
of the same kind: tasks pack their own groups into crates a small fraction of a
shard in size, and the crates, a bounded number of them, are packed into shards.
A group larger than a crate is a crate of its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagedex.llm.common import column, unused, whole
from passagedex.session import cut_lineage

# Crates the driver packs: their number is at most some 2 x MAX_CRATES plus one
# for each task.
MAX_CRATES = 200_000
CRATES_PER_SHARD = 1024
# Parts a shard is numbered in independently.
NUMBERED_PARTS = 1024
LEAF = 256


class RoomTree:
    """Bins by (remaining room, bin): a balanced tree of two levels, as a B-tree keeps it.

    Leaves are sorted runs that are split in half when they grow beyond LEAF.
    """

    def __init__(self) -> None:
        self._leaves: list[list[tuple[int, int]]] = []
        self._tops: list[tuple[int, int]] = []

    def add(self, room: int, bin_id: int) -> None:
        entry = (room, bin_id)
        if not self._leaves:
            self._leaves, self._tops = [[entry]], [entry]
            return
        i = min(bisect_left(self._tops, entry), len(self._leaves) - 1)
        leaf = self._leaves[i]
        insort(leaf, entry)
        self._tops[i] = leaf[-1]
        if len(leaf) > LEAF:
            half = len(leaf) // 2
            self._leaves[i : i + 1] = [leaf[:half], leaf[half:]]
            self._tops[i : i + 1] = [leaf[half - 1], leaf[-1]]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room of at least `size`."""
        i = bisect_left(self._tops, (size, -1))
        if i == len(self._leaves):
            return None
        leaf = self._leaves[i]
        entry = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self._tops[i] = leaf[-1]
        else:
            del self._leaves[i], self._tops[i]
        return entry


class Packer:
    """Best fit into bins of one capacity; what is larger gets a bin of its own."""

    def __init__(self, capacity: int) -> None:
        self._capacity, self._tree, self.n_bins = capacity, RoomTree(), 0

    def place(self, size: int) -> int:
        """Bin of the next group; for best-fit decreasing, call with falling sizes."""
        tightest = self._tree.take_tightest(size)
        if tightest is None:
            room, bin_id = self._capacity, self.n_bins
            self.n_bins += 1
        else:
            room, bin_id = tightest
        if room > size:
            self._tree.add(room - size, bin_id)
        return bin_id


def pack(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Bin of each of the falling sizes, and the number of bins."""
    packer = Packer(capacity)
    return [packer.place(size) for size in sizes], packer.n_bins


def pack_evenly(sizes: list[int], n_bins: int) -> list[int]:
    """Bins of the falling sizes, of the least capacity for which best fit needs no more
    than `n_bins`, as far as halving the interval finds it."""
    if not sizes:
        return []
    low = max(sizes[0], -(-sum(sizes) // n_bins))
    high = sizes[0] + low
    best, used = pack(sizes, high)
    while used > n_bins:
        high *= 2
        best, used = pack(sizes, high)
    while low < high:
        middle = (low + high) // 2
        bins, used = pack(sizes, middle)
        if used <= n_bins:
            best, high = bins, middle
        else:
            low = middle + 1
    return best


def _crates(groups: DataFrame, capacity: int) -> DataFrame:
    """(key, group_size) rows with their crate: best-fit decreasing within each task.

    Rows come sorted by falling size; a task remembers its open crates only.
    """
    schema = "key binary, group_size bigint, crate bigint"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity)
        for batch in batches:
            crates = [packer.place(size) for size in batch["group_size"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["group_size"], pa.array(crates, pa.int64())],
                names=["key", "group_size", "crate"],
            )

    n_tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartition(n_tasks, "key").sortWithinPartitions(F.desc("group_size"), "key")
    task = F.spark_partition_id().cast("long")
    # A crate is numbered by its task and its place there.
    return dealt.mapInArrow(packed, schema).select(
        "key", "group_size", (task * (1 << 32) + F.col("crate")).alias("crate")
    )


def assign_groups(
    groups: DataFrame, *, n_shards: int | None = None, capacity: int | None = None
) -> DataFrame:
    """Groups (key binary, group_size bigint) with their shard: rows (key, shard).

    With `capacity`, as few shards of that size as best fit finds; with
    `n_shards`, that many of nearly equal sizes. Keys must differ, sizes be
    positive. A group larger than a shard is never divided: it gets one by itself
    or, with `n_shards`, sets the largest size.
    """
    if (n_shards is None) == (capacity is None):
        raise ValueError("either n_shards or capacity")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    about = n_shards or max(1, -(-total // capacity))
    per_shard = max(1, min(CRATES_PER_SHARD, MAX_CRATES // about))
    crate_size = max(1, total // (about * per_shard))
    if capacity is not None:
        crate_size = min(crate_size, capacity)
    crates = cut_lineage(_crates(groups, crate_size))
    sizes = crates.groupBy("crate").agg(F.sum("group_size").alias("crate_size"))
    rows = sorted(sizes.collect(), key=lambda r: (-r.crate_size, r.crate))
    falling = [r.crate_size for r in rows]
    bins = pack_evenly(falling, n_shards) if n_shards else pack(falling, capacity)[0]
    shards = groups.sparkSession.createDataFrame(
        [(r.crate, b) for r, b in zip(rows, bins, strict=True)], "crate bigint, shard int"
    )
    # At most some 2 x MAX_CRATES rows of twelve bytes and one for each task.
    return crates.join(F.broadcast(shards), "crate").select("key", "shard")


def shard_documents(
    docs: DataFrame,
    *,
    n_shards: int | None = None,
    capacity: int | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    place: str = "place",
) -> DataFrame:
    """The table with one more column `place`: struct(size, shard, slot).

    Size is the UTF-8 bytes of the text plus 1. Equal texts are one indivisible
    group, null among the empty ones, and share a shard however many they are.
    Slots number the rows of a shard from 0 without gaps, in a scattered order
    that depends on ids and texts only; rows equal in both are numbered in turn.
    An input column of that name is replaced. An empty table stays empty.
    """
    docs = docs.drop(place)
    key, size, order, part, shard = (
        unused(docs, k) for k in ("key", "size", "order", "part", "shard")
    )
    words = whole(column(docs, text))
    sized = docs.select(
        "*",
        F.unhex(F.sha2(words.cast("binary"), 256)).alias(key),
        (F.octet_length(words).cast("long") + 1).alias(size),
    )
    groups = sized.groupBy(F.col(key).alias("key")).agg(F.sum(size).alias("group_size"))
    assigned = assign_groups(groups, n_shards=n_shards, capacity=capacity)
    placed = sized.join(
        assigned.select(F.col("key").alias(key), F.col("shard").alias(shard)), key
    )
    scattered = F.xxhash64(column(placed, doc_id).cast("string"), F.col(key))
    placed = placed.withColumn(order, scattered).withColumn(
        part, F.pmod(F.col(order), F.lit(NUMBERED_PARTS)).cast("int")
    )
    return _numbered(placed, docs, key, size, order, part, shard, place)


def _numbered(placed, docs, key, size, order, part, shard, into) -> DataFrame:
    """Gapless slots without one task per shard: parts are counted, then numbered by themselves."""
    parts = placed.groupBy(F.col(shard).alias("shard"), F.col(part).alias("part")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("shard").alias(shard),
        F.col("part").alias(part),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
    )
    within = Window.partitionBy(shard, part).orderBy(order, key)
    slot = F.col("start") + F.row_number().over(within) - 1
    numbered = placed.join(starts, [shard, part])
    place = F.struct(
        F.col(size).alias("size"), F.col(shard).alias("shard"), slot.cast("long").alias("slot")
    )
    return numbered.select(*[column(docs, c) for c in docs.columns], place.alias(into))
