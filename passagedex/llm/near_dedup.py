"""MinHash near-duplicate detection with odd sketches.

Every distinct shingle set gets 320 MinHash samples. Their 64 bands of five say
which documents are compared; folded into a bitmap of parities, an odd sketch,
they say how similar two documents are: the more samples differ, the more bits
of the XOR are set. Links are confirmed on the full shingle sets.

No bucket's pairs are ever all written out. A bucket is first a star: its
members are compared with its smallest one. Where that does not join them all,
the bucket is open: its members outside the component of its smallest member
must meet the others. Open buckets whose smallest members are in one component
mostly hold the same members, so these are listed once for the component, or
once per bucket where that is less work. They meet in blocks of bounded size,
and a block yields confirmed links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from passagedex.llm.common import WORD, Scratch, column, unused, whole
from passagedex.llm.shingles import mix, shingle_set

WIDTH = 5
PERCENT = 75
# Two sets of similarity 0.75 share no band once in thirty million times.
BANDS, ROWS = 64, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
# Pairs the sketches put below this are no candidates: over six standard
# deviations under 0.75, so a link is lost to it once in a billion times.
LEAST_ESTIMATE = 0.58
# Members of each side that one block compares.
BLOCK = 2048
# Comparisons of sketches that take as long as moving one more member to a block.
ROW_COST = 256

_random = np.random.default_rng(40_961)
SCALE = _random.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SHIFT = _random.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
BAND_SCALE = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)

MOST_DIFFERENT = int(
    SKETCH_BITS / 2 * (1 - exp(-4 * SAMPLES * (1 - LEAST_ESTIMATE) / SKETCH_BITS))
)

SIGNATURE = "n bigint, class binary, bands array<bigint>, sketch array<bigint>"


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The samples: for each of the hash functions its least value over the set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(short), 1024):
        least = np.minimum(least, (short[i : i + 1024, None] * SCALE + SHIFT).min(axis=0))
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples as sixteen longs."""
    places = mix(samples.astype(np.uint64) | PLACE) % np.uint64(SKETCH_BITS)
    parity = np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def signature(text: str | None) -> dict:
    """Set size, class (equal for equal sets), band hashes and odd sketch of a text."""
    shingles = shingle_set(text, WIDTH)
    if not len(shingles):
        return {"n": 0, "class": None, "bands": None, "sketch": None}
    samples = min_hashes(shingles)
    bands = samples.reshape(BANDS, ROWS).astype(np.uint64) * BAND_SCALE
    numbers = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(56)
    sums = np.array([shingles.sum(), mix(shingles).sum()], dtype=np.uint64)
    return {
        "n": len(shingles),
        "class": sums.tobytes(),
        "bands": mix(bands.sum(axis=1) + numbers).view(np.int64),
        "sketch": odd_sketch(samples),
    }


def sign(docs: DataFrame) -> DataFrame:
    """Rows (id, text) to (id, text_hash, n, class, bands, sketch); the text stays behind."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, text_hash bigint, {SIGNATURE}"

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [signature(t) for t in batch["text"].to_pylist()]
            kinds = {
                "n": pa.int64(),
                "class": pa.binary(),
                "bands": pa.list_(pa.int64()),
                "sketch": pa.list_(pa.int64()),
            }
            arrays = [pa.array([m[k] for m in made], kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["text_hash"], *arrays], names=["id", "text_hash", *kinds]
            )

    keyed = docs.select("id", F.xxhash64(whole(F.col("text"))).alias("text_hash"), "text")
    return keyed.mapInArrow(signed, schema)


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sets have at least 75 % of their union in common."""
    if min(len(one), len(two)) * 100 < PERCENT * max(len(one), len(two)):
        return False
    union = len(np.union1d(one, two))
    return 100 * (len(one) + len(two) - union) >= PERCENT * union


@F.pandas_udf(BooleanType())
def confirmed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether two texts are linked, on their full sets. The right text often stays the same."""
    text, shingles = None, shingle_set(None)
    for left, right in batches:
        links = []
        for a, b in zip(left, right, strict=True):
            if b != text:
                text, shingles = b, shingle_set(b, WIDTH)
            links.append(similar(shingle_set(a, WIDTH), shingles))
        yield pd.Series(links, dtype=bool)


def plausible(n: Column, sketch: Column, other_n: Column, other_sketch: Column) -> Column:
    """Whether sizes and odd sketches leave a similarity of 0.75 possible."""
    differing = F.aggregate(
        F.zip_with(sketch, other_sketch, lambda a, b: F.bit_count(a.bitwiseXOR(b))),
        F.lit(0),
        lambda acc, bits: acc + bits,
    )
    sizes = F.least(n, other_n) * 100 >= F.greatest(n, other_n) * PERCENT
    return sizes & (differing <= MOST_DIFFERENT)


def components(links: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """Connected components of links (a, b): rows (node, label), label the least node.

    Nodes take the least label among their neighbours, then the label of their
    label, until nothing changes; the rounds grow with the logarithm of the
    longest chain. Each round is a table of its own, and the one before goes.
    """
    tables = tables or Scratch(links.sparkSession, "components")
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b")
    edges = tables.keep(both.distinct())
    labels = tables.keep(
        edges.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("label")
        )
    )
    while True:
        offers = (
            edges.join(labels, edges["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("offer"))
        )
        lower = labels.join(offers, labels["node"] == offers["a"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", "offer").alias("label")
        )
        up = lower.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = lower.join(up, lower["label"] == up["up"], "left").select(
            "node", "old", F.least("label", F.coalesce("up_label", "label")).alias("label")
        )
        jumped = tables.keep(jumped)
        tables.drop(labels)
        labels = jumped
        if labels.where("label != old").isEmpty():
            tables.drop(edges)
            return labels.select("node", "label")


def _block_links(with_text: bool):
    """Function of one block: entries that have a plausible partner, or confirmed links.

    Members listed for a whole component are compared if they share any band. In
    a bucket, a pair counts in the first band it shares only, and not if the
    bucket's smallest member is in it, as those pairs were compared before.
    """

    def compared(table: pa.Table) -> pa.Table:
        def column_of(name):
            return table[name].to_numpy()

        def matrix(name, width):
            values = table[name].combine_chunks().flatten().to_numpy()
            return values.reshape(-1, width).view(np.uint64)

        node, label, n, group = (column_of(k) for k in ("node", "label", "n", "side"))
        hub, whole_component = table["hub"][0].as_py(), table["whole"][0].as_py()
        bucket = np.uint64(table["grp"][0].as_py() & (2**64 - 1))
        bands, sketch = matrix("bands", BANDS), matrix("sketch", SKETCH_BITS // 64)
        within = table["low"][0].as_py() == table["high"][0].as_py()
        texts = table["text"].to_pylist() if with_text else None
        sets: dict[int, np.ndarray] = {}
        joined: dict[int, int] = {}
        found, links = np.zeros(len(node), dtype=bool), []

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i], WIDTH)
            return sets[i]

        left = np.arange(len(node)) if within else np.flatnonzero(group == 0)
        right = left if within else np.flatnonzero(group == 1)
        for place, i in enumerate(left.tolist()):
            others = right[place + 1 :] if within else right
            fits = label[others] != label[i]
            if not whole_component:
                fits &= (node[others] != hub) & (node[i] != hub)
            fits &= np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * PERCENT
            others = others[fits]
            bits = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1)
            others = others[bits <= MOST_DIFFERENT]
            same = bands[others] == bands[i]
            if whole_component:
                others = others[same.any(axis=1)]
            else:
                others = others[bands[i][same.argmax(axis=1)] == bucket]
            if texts is None:
                found[others] = True
                found[i] |= len(others) > 0
                continue
            for j in others.tolist():
                a, b = root(int(label[i])), root(int(label[j]))
                if a != b and similar(shingles(i), shingles(j)):
                    links.append((int(node[i]), int(node[j])))
                    joined[max(a, b)] = min(a, b)
        if texts is not None:
            return pa.table(
                {
                    "a": pa.array([a for a, _ in links], pa.int64()),
                    "b": pa.array([b for _, b in links], pa.int64()),
                }
            )
        return table.select([*BLOCK_KEY, "side", "hub", "node"]).filter(pa.array(found))

    return compared


# A group of members is a bucket, or a component of smallest members as a whole.
GROUP = ("whole", "grp")
BLOCK_KEY = (*GROUP, "low", "high")


def _groups(labelled: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (whole, grp, node, hub, label) of the groups to compare, and the groups.

    `labelled` has members (bucket, node, hub, label). Open buckets are taken
    together by the component of their smallest member. A component is listed as
    a whole unless its comparisons, members counted as ROW_COST each, are more
    than those of its buckets.
    """
    hub_labels = labelled.where("node = hub").select(
        F.col("bucket").alias("k"), F.col("label").alias("hub_label")
    )
    major = F.count_if(F.col("label") == F.col("hub_label")).alias("n_major")
    minor = F.count_if(F.col("label") != F.col("hub_label")).alias("n_minor")
    buckets = tables.keep(
        labelled.join(hub_labels, F.col("bucket") == F.col("k"))
        .groupBy("bucket")
        .agg(F.first("hub_label").alias("hub_label"), major, minor)
        .where("n_minor > 0")
    )
    work = (
        F.col("n_minor") * (F.col("n_major") + F.col("n_minor") / 2)
        + (F.col("n_major") + F.col("n_minor")) * ROW_COST
    )
    renamed = buckets.select(F.col("bucket").alias("k"), "hub_label")
    members = tables.keep(labelled.join(renamed, F.col("bucket") == F.col("k")).drop("k"))
    listed = members.groupBy("hub_label", "node").agg(F.first("label").alias("label"))
    components = listed.groupBy("hub_label").agg(major, minor).withColumn("work", work)
    split = buckets.groupBy("hub_label").agg(F.sum(work).alias("split_work"))
    chosen = tables.keep(
        components.join(split, "hub_label").withColumn("whole", F.col("work") <= F.col("split_work"))
    )
    wholes, splits = chosen.where("whole"), chosen.where("NOT whole")
    no_hub = F.lit(-1).cast("long").alias("hub")
    entries = listed.join(wholes.select("hub_label"), "hub_label").select(
        F.lit(True).alias("whole"), F.col("hub_label").alias("grp"), "node", no_hub, "label"
    )
    of_buckets = members.join(splits.select("hub_label"), "hub_label", "left_semi").select(
        F.lit(False).alias("whole"), F.col("bucket").alias("grp"), "node", "hub", "label"
    )
    groups = wholes.select("whole", F.col("hub_label").alias("grp"), "hub_label", "n_major", "n_minor")
    groups = groups.unionByName(
        buckets.join(splits.select("hub_label"), "hub_label", "left_semi").select(
            F.lit(False).alias("whole"), F.col("bucket").alias("grp"), "hub_label", "n_major", "n_minor"
        )
    )
    return entries.unionByName(of_buckets), groups


def _blocks(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of groups dealt into blocks.

    Members of the component of the group's smallest members are never compared
    with each other; they and the others are cut into parts of about BLOCK. Every
    pair of parts that may hold a link is a block (low, high); parts of the first
    kind have negative numbers.
    """
    sizes = groups.select(
        *GROUP,
        F.ceil(F.col("n_major") / BLOCK).alias("majors"),
        F.ceil(F.col("n_minor") / BLOCK).alias("minors"),
        "hub_label",
    )
    placed = entries.join(sizes, list(GROUP))
    major = F.col("label") == F.col("hub_label")
    parts = F.when(major, F.col("majors")).otherwise(F.col("minors"))
    own = F.pmod(F.xxhash64("node"), parts)
    minors = F.sequence(F.lit(0).cast("long"), F.col("minors") - 1)
    majors = F.sequence(-F.col("majors"), F.lit(-1).cast("long"))
    block = lambda low, high, side: F.struct(
        low.alias("low"), high.alias("high"), F.lit(side).alias("side")
    )
    of_major = F.transform(minors, lambda x: block(-own - 1, x, 0))
    of_minor = F.concat(
        F.when(F.col("majors") > 0, F.transform(majors, lambda x: block(x, own, 1))).otherwise(
            F.slice(of_major, 1, 0)
        ),
        F.transform(
            minors,
            lambda x: F.struct(
                F.least(x, own).alias("low"),
                F.greatest(x, own).alias("high"),
                F.when(own <= x, 0).otherwise(1).alias("side"),
            ),
        ),
    )
    dealt = F.explode(F.when(major, of_major).otherwise(of_minor))
    return placed.withColumn("block", dealt).select(*GROUP, "node", "hub", "block.*")


def near_components(docs: DataFrame) -> DataFrame:
    """Rows (id, text) to (id, text_hash, n, component, chosen): see `find_near_duplicates`.

    `chosen` marks the rows of one text of each component: that of its smallest
    id, or of no id if it has none, and rows without words.
    """
    tables = Scratch(docs.sparkSession, "near-duplicates")
    signed = tables.keep(sign(docs))
    # One row for each distinct set: its smallest id and one of its texts. The node
    # is a number of its own, as one id may have texts of different sets and some
    # rows may have no id.
    worded = signed.where("n > 0")
    nameless = F.col("id").isNull()
    classes = tables.keep(
        worded.groupBy("class", "n")
        .agg(
            F.min(F.struct(nameless.alias("nameless"), "id", "text_hash")).alias("first"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        )
        .select(
            "class",
            "n",
            F.monotonically_increasing_id().alias("node"),
            F.col("first.id").alias("id"),
            F.col("first.text_hash").alias("text_hash"),
            "bands",
            "sketch",
        )
    )
    narrow = tables.keep(signed.select("id", "text_hash", "n", "class"))
    tables.drop(signed)
    entries = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = (
        entries.groupBy("bucket")
        .agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
    )
    shared = tables.keep(entries.join(hubs, "bucket"))

    marks = classes.select("node", "n", "sketch", "bands")
    left, right = (
        classes.select(*[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "sketch")])
        for side in ("a", "b")
    )
    stars = shared.where("node != hub").select("node", "hub").distinct()
    stars = (
        stars.join(left, F.col("node") == F.col("node_a"))
        .join(right, F.col("hub") == F.col("node_b"))
        .where(plausible(*(F.col(c) for c in ("n_a", "sketch_a", "n_b", "sketch_b"))))
        .select(F.col("node").alias("a"), F.col("hub").alias("b"))
    )
    stars = tables.keep(stars)
    in_buckets = shared.select("node").distinct()
    texts = tables.keep(_texts(docs, classes.join(in_buckets, "node", "left_semi")))
    pairs = stars.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    first = components(pairs.where(confirmed("text_a", "text_b")).select("a", "b"), tables)
    tables.drop(stars)

    # Buckets that the stars did not join, and that have more than a star's pairs.
    labelled = (
        shared.where("size > 2")
        .join(first.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left")
        .select("bucket", "node", "hub", F.coalesce("label", "node").alias("label"))
    )
    second = first.select(F.col("node").alias("l_node"), "label")

    def marked(blocks: DataFrame) -> DataFrame:
        known = marks.withColumnRenamed("node", "k")
        return (
            blocks.join(known, F.col("node") == F.col("k"))
            .join(second, F.col("node") == F.col("l_node"), "left")
            .withColumn("label", F.coalesce("label", "node"))
            .drop("k", "l_node")
        )

    entry = "whole boolean, grp bigint, low bigint, high bigint, side int, hub bigint, node bigint"
    labelled = tables.keep(labelled)
    tables.drop(shared)
    sketched = marked(_blocks(*_groups(labelled, tables))).groupBy(*BLOCK_KEY)
    likely = tables.keep(sketched.applyInArrow(_block_links(False), entry))
    tables.drop(labelled)
    worded = marked(likely).join(texts.withColumnRenamed("node", "k"), F.col("node") == F.col("k"))
    more = worded.drop("k").groupBy(*BLOCK_KEY).applyInArrow(_block_links(True), "a bigint, b bigint")
    more = tables.keep(more)
    tables.drop(texts, likely)
    joined = components(_relabelled(more, first), tables)
    joined = joined.withColumnRenamed("node", "k").withColumnRenamed("label", "to")
    final = first.join(joined, F.col("label") == F.col("k"), "left").select(
        "node", F.coalesce("to", "label").alias("label")
    )
    alone = joined.select(F.col("k").alias("node"), F.col("to").alias("label")).join(
        first, "node", "left_anti"
    )
    labels = final.unionByName(alone)
    named = classes.join(labels.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left")
    named = named.select(
        "class",
        "n",
        F.struct(nameless.alias("nameless"), "id", "text_hash").alias("own"),
        F.coalesce("label", "node").alias("label"),
    )
    least = named.groupBy(F.col("label").alias("k")).agg(F.min("own").alias("least"))
    named = named.join(least, F.col("label") == F.col("k")).select("class", "n", "least")
    named = tables.keep(named)
    tables.drop(classes, more)
    chosen = F.col("id").eqNullSafe(F.col("least.id")) & (
        F.col("text_hash") == F.col("least.text_hash")
    )
    return narrow.join(named, ["class", "n"], "left").select(
        "id",
        "text_hash",
        "n",
        F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("id")).alias("component"),
        ((F.col("n") == 0) | chosen).alias("chosen"),
    )


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, text) of the classes' own documents, repeated rows once."""
    wanted = classes.select("node", F.col("id").alias("k"), F.col("text_hash").alias("wanted_hash"))
    keyed = docs.select("id", "text", F.xxhash64(whole(F.col("text"))).alias("text_hash"))
    same = F.col("id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("wanted_hash"))
    found = keyed.join(wanted, same)
    return found.groupBy("node", "text_hash").agg(F.first("text").alias("text")).drop("text_hash")


def _relabelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between the labels of their ends."""
    for end in ("a", "b"):
        names = labels.select(F.col("node").alias("k"), F.col("label").alias("to"))
        links = links.join(names, F.col(end) == F.col("k"), "left")
        links = links.withColumn(end, F.coalesce("to", end)).drop("k", "to")
    return links


def find_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of the table.

    Sets are of the distinct runs of five words, A-Z lower-cased; fewer words are
    one run. Documents are linked from a similarity of 0.75 on. component_id is
    the smallest id reachable over links, and kept says that it is the row's own.

    Documents without words or text link to nothing and are their own component.
    Rows without an id are linked by their text and are kept only where no row
    of their component has an id; then component_id is null and the rows of one
    text of the component are kept. Rows with one id are told apart by their
    texts, each with the component of its text; repeated rows agree. Ids are
    whole numbers. An empty table gives no rows.
    """
    rows = docs.select(
        column(docs, doc_id).cast("long").alias("id"), column(docs, text).alias("text")
    )
    return near_components(rows).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.when(F.col("id").isNull(), F.col("chosen"))
        .otherwise(F.col("id") == F.col("component"))
        .alias("kept"),
    )


def keep_one_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of every component, the one with the smallest id, with all columns.

    Where rows of one id and different texts are in one component, one text
    stays, and of rows equal in id and text one. A component without any id
    keeps one row. Rows without words all stay, but one of those of one id and text.
    """
    key, hashed = unused(docs, "near_id"), unused(docs, "near_text")
    rows = docs.select(
        column(docs, doc_id).cast("long").alias("id"), column(docs, text).alias("text")
    )
    kept = near_components(rows).where("chosen").select("id", "text_hash").distinct()
    keyed = docs.withColumn(key, column(docs, doc_id).cast("long")).withColumn(
        hashed, F.xxhash64(whole(column(docs, text)))
    )
    blank = F.col(key).isNull() & ~whole(column(docs, text)).rlike(WORD)
    same = F.col(key).eqNullSafe(F.col("id_")) & (F.col(hashed) == F.col("text_hash_"))
    one_each = keyed.where(~blank).join(kept.toDF("id_", "text_hash_"), same, "left_semi")
    one_each = one_each.dropDuplicates([key, hashed])
    return one_each.unionByName(keyed.where(blank)).select(*[column(keyed, c) for c in docs.columns])
