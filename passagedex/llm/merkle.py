"""A Merkle manifest of a table: one root for all rows and a proof for each.

Rows are leaves. The leaves of a group, in order, are hashed in runs of `fanout`
until one node is left; the groups' subroots are hashed likewise to the root.

Siblings come from window functions. A node's hash stands on the row of its
first leaf, so at a level whose nodes span `step` leaves the nodes of a run are
lag and lead columns at the fixed offsets step, 2 * step, ... . Offsets outside
the run are masked by the node's slot and the run's length, and the run's first
child hashes the parent. Windows run over chunks of a bounded number of leaves;
the roots of the chunks are the leaves of the next round, so no window holds a
group and the rounds grow with the logarithm of the largest one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagedex.llm.common import column, unused
from passagedex.session import cut_lineage

# Rows a chunk has at most, and rows a partition of the ordered leaves holds.
CHUNK_ROWS = 4096
ROWS_PER_PARTITION = 1_000_000


def sha256(value: Column) -> Column:
    """Lower-case hex digest of a string's UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else byte count, colon and value; no two lists of values look alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return sha256(F.concat(*map(field, values)))


def _group_key(group: Column) -> Column:
    """A string that is never null and sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _placed(leaves: DataFrame) -> DataFrame:
    """Rows (grp, sort keys, hash, ...) with `pos` in their group and the group's size `n`.

    A range sort deals rows to partitions; a row's place is its place in the
    partition plus what earlier partitions hold of its group. Rows alike in all
    sort keys are ordered by their place in the input, so that a key that very
    many rows share is dealt to many partitions.
    """
    spark = leaves.sparkSession
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-leaves.count() // ROWS_PER_PARTITION),
    )
    keys = ["grp", "key", "hash", "tie"]
    ordered = cut_lineage(
        leaves.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("row", 33))
        .drop("tie")
    )
    held = ordered.groupBy("grp", "part").agg(
        F.count(F.lit(1)).alias("held"), F.min("row").alias("first")
    )
    group = Window.partitionBy("grp")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = cut_lineage(
        held.select(
            "grp",
            "part",
            (F.sum("held").over(before) - F.col("held") - F.col("first")).alias("shift"),
            F.sum("held").over(group).alias("n"),
        )
    )
    return ordered.join(starts, ["grp", "part"]).select(
        *[c for c in leaves.columns], (F.col("row") + F.col("shift")).alias("pos"), "n"
    )


def _height(n: Column, fanout: int) -> Column:
    """Levels of hashing until n nodes are one."""
    height, size = F.lit(0), 1
    while size < 2**62:
        height += F.when(n > size, 1).otherwise(0)
        size *= fanout
    return height


def _climb(nodes: DataFrame, done: int, levels: int, fanout: int) -> DataFrame:
    """Nodes (grp, pos, n, height, hash) with their chunk, its root and their proof in it.

    `done` is the number of levels below the nodes. A proof is an array of
    (left, right), the siblings before and after, each as digests in order; a
    group that is one node by then has no levels left and an empty proof.
    """
    chunk_rows = fanout**levels
    rows = nodes.withColumn("chunk", F.floor(F.col("pos") / chunk_rows)).withColumn(
        "at", F.col("pos") % chunk_rows
    )
    in_chunk = Window.partitionBy("grp", "chunk")
    in_order = in_chunk.orderBy("pos")
    # All runs but a chunk's last are full, so slot and size tell a run's length.
    rows = rows.withColumn("size", F.least(F.lit(chunk_rows), F.col("n") - F.col("chunk") * chunk_rows))
    h, count = F.col("hash"), F.col("size")
    rows = rows.withColumn("h0", h)
    for level in range(levels):
        step = fanout**level
        this, live = F.col(f"h{level}"), F.col("height") > done + level
        number = F.floor(F.col("at") / step)
        slot = number % fanout
        length = F.least(F.lit(fanout), F.ceil(count / step) - (number - slot))
        lefts = [
            F.when(slot >= d, F.lag(this, d * step).over(in_order))
            for d in range(fanout - 1, 0, -1)
        ]
        rights = [
            F.when(slot + d < length, F.lead(this, d * step).over(in_order))
            for d in range(1, fanout)
        ]
        first_leaf = live & (F.col("at") % step == 0)
        none = F.lit("")
        rows = (
            rows.withColumn(
                f"s{level}",
                F.when(
                    first_leaf,
                    F.struct(
                        F.concat(*[F.coalesce(x, none) for x in lefts]).alias("left"),
                        F.concat(*[F.coalesce(x, none) for x in rights]).alias("right"),
                    ),
                ),
            )
            .withColumn(
                f"h{level + 1}",
                F.when(
                    first_leaf & (slot == 0), sha256(F.concat(this, F.col(f"s{level}.right")))
                ).otherwise(F.when(~live & (F.col("at") == 0), this)),
            )
            .drop(f"h{level}")
        )
    # Every leaf takes its ancestors' siblings from the row of their first leaf.
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    siblings = [F.last(f"s{level}", ignorenulls=True).over(so_far) for level in range(levels)]
    proof = F.filter(F.array(*siblings), lambda s: s.isNotNull())
    kept = [c for c in nodes.columns if c != "hash"]
    return rows.select(
        *kept,
        "hash",
        "chunk",
        "at",
        F.col(f"h{levels}").alias("chunk_root"),
        proof.alias("proof"),
    )


def _rounds(placed: DataFrame, fanout: int) -> list[DataFrame]:
    """What `_climb` makes of the leaves, then of the chunks' roots, until one chunk is left."""
    levels = 1
    while fanout ** (levels + 1) <= CHUNK_ROWS:
        levels += 1
    nodes = cut_lineage(placed.withColumn("height", _height(F.col("n"), fanout)))
    top = nodes.agg(F.max("height")).first()[0] or 0
    rounds = [_climb(nodes, 0, levels, fanout)]
    while levels * len(rounds) < top:
        nodes = cut_lineage(
            rounds[-1].where("at = 0").select(
                "grp",
                F.col("chunk").alias("pos"),
                F.ceil(F.col("n") / fanout**levels).alias("n"),
                "height",
                F.col("chunk_root").alias("hash"),
            )
        )
        rounds.append(_climb(nodes, levels * len(rounds), levels, fanout))
    return rounds


def _subroots(rounds: list[DataFrame]) -> DataFrame:
    return rounds[-1].where("at = 0").select("grp", F.col("chunk_root").alias("subroot"))


def _descended(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first round's nodes with whole proofs and the other columns of `tops`.

    `tops` has a row (grp, rest, ...) per group, `rest` being the proof above it.
    What is above a chunk is that of its root one round on, so every join meets
    a key with at most a chunk of rows, however large a group is.
    """
    others = [c for c in tops.columns if c not in ("grp", "rest")]
    upper = rounds[-1].join(tops, "grp").withColumn("proof", F.concat("proof", "rest"))
    for climbed in reversed(rounds[:-1]):
        known = upper.select(
            "grp", F.col("pos").alias("chunk"), F.col("proof").alias("rest"), *others
        )
        upper = climbed.join(known, ["grp", "chunk"]).withColumn(
            "proof", F.concat("proof", "rest")
        )
    return upper


def folded(leaf_hash: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(
        proof, leaf_hash, lambda acc, s: sha256(F.concat(s["left"], acc, s["right"]))
    )


def siblings_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    both = F.transform(proof, lambda s: F.concat(s["left"], s["right"]))
    return sha256(F.array_join(both, ""))


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    order: str = "doc_id",
    fanout: int = 2,
    **carried: Column,
) -> DataFrame:
    """(`order`, leaf, subroot, root, proof, carried columns): one row per row.

    A leaf is the digest of the row's `columns`. Leaves of a group ascend by
    `order`, null first; rows alike in it are ordered by their digest, and equal
    rows are leaves side by side. A group may be null and then comes first of the
    subroots; the others follow bytewise. A proof lists per level, up to the
    root, the digests before and after the node; where a node is alone in its run
    both are empty, and a table of one row has an empty proof. An empty table
    gives no rows. `carried` columns are computed from the row with its leaf.
    Texts are hashed whole and read once; only digests are shuffled.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    leaves = cut_lineage(
        docs.select(
            _group_key(column(docs, group)).alias("grp"),
            column(docs, order).alias("key"),
            leaf(*[column(docs, c) for c in columns]).alias("hash"),
            *[value.alias(f"carried_{name}") for name, value in carried.items()],
        )
    )
    rounds = _rounds(_placed(leaves), fanout)
    subroots = cut_lineage(_subroots(rounds))
    as_leaves = subroots.select(
        F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("subroot").alias("hash")
    )
    crown = _rounds(_placed(as_leaves), fanout)
    no_rest = F.array().cast(crown[0].schema["proof"].dataType)
    root = _subroots(crown).select("grp", F.col("subroot").alias("root"), no_rest.alias("rest"))
    tops = cut_lineage(
        _descended(crown, root).select(
            F.col("key").alias("grp"),
            F.col("hash").alias("subroot"),
            "root",
            F.col("proof").alias("rest"),
        )
    )
    return _descended(rounds, tops).select(
        F.col("key").alias(order),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        "proof",
        *[F.col(f"carried_{name}").alias(name) for name in carried],
    )
