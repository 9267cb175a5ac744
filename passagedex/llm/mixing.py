"""Mixing sources to target weights with DataFrame functions only.

The documents of a source, in a seeded order, form one run of words that is cut
into blocks of equal length. Sainte-Laguë apportionment hands the blocks of the
whole mix to the sources by highest quotient, target / (2k + 1). As a larger
house only adds seats, cutting the seats in quotient order gives every shard of
the mix its own integer quotas. Which blocks fill a source's seats is a seeded
rotation: the run is entered at a seeded block and followed round, so a source
that is asked for more than it has is repeated evenly. Seats of a source thus
follow each other in the run, and only the documents at the two ends of what is
taken are cut.

A source whose target is under LEAST_SEATS blocks would be rounded too coarsely.
All such sources share a second house of the same method whose seats are single
words. Only the seats whose quotients are near the last one taken are ranked
there, as all others are won or lost by arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagedex.llm.common import WORD, column, unused, whole, word_count

# Seats of a mix; one is a ten-thousandth of the words it takes.
HOUSE = 10_000
# Sources with a smaller target, in blocks of the house, are in the house of words.
LEAST_SEATS = 100
# Hexadecimal digits of the order that split a source into runs which are summed
# up and sorted independently: 4,096 of them.
RUN_DIGITS = 3


def source_key(source: Column) -> Column:
    """A key for a source that sorts by code point with null last, and joins null to null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("z"))


def cycling_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights given out in turn to the sources in the order of their keys.

    The window has one row per source.
    """
    turn = (F.row_number().over(Window.orderBy("key")) - 1) % len(weights)
    return sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("long"))


def source_targets(sizes: DataFrame, percent: int = 150, max_repeat: int = 2) -> DataFrame:
    """Targets by weight, capped at `max_repeat` times the source's size.

    `sizes` has one row per source: key, source_size, weight (long). The mix
    takes `percent` of all words. What a cap cuts off goes to the others by
    weight until none is above its cap: sources reach their caps in the order of
    size over weight, so the level follows from running sums over that order.
    With weights or sizes of 0 the target is 0. The window has one row per source.
    """
    if percent > 100 * max_repeat:
        raise ValueError("the mix asks for more than all sources repeated as often as allowed")
    every = Window.partitionBy()
    ratio = F.try_divide(F.col("source_size"), F.col("weight"))
    before = Window.orderBy(F.col("ratio").asc_nulls_last(), "key").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranked = sizes.withColumn("ratio", ratio).select(
        "key",
        "source_size",
        "weight",
        "ratio",
        F.sum("source_size").over(every).alias("words"),
        F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weights_before"),
    )
    # Words per unit of weight if the sources before this one are at their caps.
    level = F.try_divide(
        F.col("words") * percent / 100 - F.col("words_before") * max_repeat,
        F.col("weights") - F.col("weights_before"),
    )
    holds = F.col("own_level") <= F.col("ratio") * max_repeat
    leveled = ranked.withColumn("own_level", level).withColumn(
        "level", F.min_by("own_level", F.when(holds, F.struct("ratio", "key"))).over(every)
    )
    cap = (F.col("source_size") * max_repeat).cast("double")
    share = F.least(F.col("weight") * F.col("level"), cap)
    target = F.when(F.col("weight") > 0, F.coalesce(share, cap)).otherwise(F.lit(0.0))
    return leveled.select("key", "source_size", target.alias("target"))


def block_sizes(targets: DataFrame, house: int = HOUSE) -> DataFrame:
    """The targets with block_words, the words of a seat, and `small`, for the house of words."""
    block = F.ceil(F.sum("target").over(Window.partitionBy()) / house)
    sized = targets.withColumn("block_words", F.greatest(F.lit(1), block).cast("long"))
    # Where a block is a word, the house is as fine as can be.
    coarse = (F.col("block_words") > 1) & (F.col("target") < F.col("block_words") * LEAST_SEATS)
    return sized.withColumn("small", coarse & (F.col("target") > 0))


def apportion(targets: DataFrame, max_repeat: int = 2) -> DataFrame:
    """Seats of the house by highest quotient: rows (key, k, seat), seat counted from 0.

    Input: see `block_sizes`; small sources have no seats here. Every row
    also has block_words, n_blocks, the blocks of its source, and seats, the size
    of the house. No source gets more than `max_repeat` seats for each block it
    has. Ties of quotients go to the earlier source. The one task that ranks the
    candidates has at most house + 3 x sources of them, and where a block is over
    a word at most a hundredth of the house are sources.
    """
    every = Window.partitionBy()
    sized = targets.where((F.col("target") > 0) & ~F.col("small")).select(
        "key",
        "source_size",
        "target",
        F.sum("target").over(every).alias("total"),
        "block_words",
        F.count(F.lit(1)).over(every).alias("n_sources"),
    )
    sized = sized.select(
        "*",
        F.ceil(F.col("source_size") / F.col("block_words")).alias("n_blocks"),
        F.round(F.col("total") / F.col("block_words")).cast("long").alias("seats"),
    )
    # A divisor method stays within half a seat per source of the exact shares.
    share = F.col("target") / F.col("total") * (F.col("seats") + F.col("n_sources") / 2 + 1)
    most = F.least(F.floor(share + 1), F.col("n_blocks") * max_repeat).cast("long")
    quotients = sized.withColumn("most", most).select(
        "key",
        "block_words",
        "n_blocks",
        "seats",
        "target",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1)).alias("k"),
    )
    highest = Window.orderBy((F.col("target") / (F.col("k") * 2 + 1)).desc(), "key", "k")
    ranked = quotients.withColumn("seat", F.row_number().over(highest) - 1)
    return ranked.where(F.col("seat") < F.col("seats")).drop("target")


def _seeded(seed: int, label: str, key: Column) -> Column:
    """A whole number below 2^32 for a source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{label}"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def apportion_words(targets: DataFrame, shards: int, max_repeat: int = 2) -> DataFrame:
    """Seats of small sources in a house of single words: rows (key, words, quotas).

    The house of the first s shards has round(total * s / shards) seats, and as a
    larger house only adds seats, quotas are the differences between these.
    Sainte-Laguë seats lie within a rounding of every source's share, scaled by
    what all roundings and caps together may shift: up to 2 for each of the n
    sources. Seats below that range are won, those above lost, and the contested
    ones between, some 7 per source and shard, are ranked by their quotients.
    """
    every = Window.partitionBy()
    small = targets.where("small").select(
        "key",
        "target",
        (F.col("source_size") * max_repeat).alias("most"),
        F.sum("target").over(every).alias("total"),
        F.count(F.lit(1)).over(every).alias("n_sources"),
    )
    upto = small.withColumn("upto", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    share = F.col("target") * F.col("upto") / shards
    margin = F.col("target") / F.col("total") * (F.col("n_sources") * 2 + 2) + 2
    high = F.least(F.floor(share + margin), F.col("most"))
    ranged = upto.select(
        "key",
        "target",
        "upto",
        F.round(F.col("total") * F.col("upto") / shards).cast("long").alias("house"),
        F.greatest(F.lit(0).cast("long"), F.least(F.ceil(share - margin), high)).alias("won"),
        high.alias("high"),
    )
    house = Window.partitionBy("upto")
    contested = ranged.withColumn("open", F.col("house") - F.sum("won").over(house)).select(
        "key",
        "target",
        "upto",
        "won",
        "open",
        F.explode(F.sequence(F.col("won"), F.greatest("won", "high"))).alias("k"),
        "high",
    )
    highest = house.orderBy(
        (F.col("k") >= F.col("high")).asc(), (F.col("target") / (F.col("k") * 2 + 1)).desc(), "key", "k"
    )
    taken = (F.row_number().over(highest) <= F.col("open")) & (F.col("k") < F.col("high"))
    seats = (
        contested.withColumn("taken", taken)
        .groupBy("key", "upto")
        .agg((F.first("won") + F.count_if("taken")).alias("seats"))
    )
    before = F.coalesce(F.lag("seats").over(Window.partitionBy("key").orderBy("upto")), F.lit(0))
    quota = F.struct((F.col("upto") - 1).alias("shard"), (F.col("seats") - before).alias("n"))
    return (
        seats.withColumn("quota", quota)
        .groupBy("key")
        .agg(F.max("seats").alias("words"), F.sort_array(F.collect_list("quota")).alias("quotas"))
    )


def word_turn(words: Column, quotas: Column, source_size: Column, seed: int) -> Column:
    """The turn of a source whose blocks are single words; null if it takes none."""
    turn = F.struct(
        F.lit(1).cast("long").alias("block_words"),
        source_size.alias("n_blocks"),
        F.pmod(_seeded(seed, "", F.col("key")), source_size).alias("entry"),
        F.floor(words / source_size).alias("laps"),
        (words % source_size).alias("rest"),
        F.filter(quotas, lambda x: x["n"] > 0).alias("quotas"),
    )
    return F.when(words > 0, turn)


def source_turns(seats: DataFrame, seed: int, shards: int) -> DataFrame:
    """Per source, what its seats take: rows (key, turn), one per source with a seat.

    turn has block_words, n_blocks, entry (the block the run is entered at), laps
    (how often the whole run is taken), rest (blocks of the last, partial lap)
    and quotas: (shard, n), the seats the source has in each shard of the mix.
    """
    entry = F.pmod(_seeded(seed, "", F.col("key")), F.col("n_blocks"))
    shard = F.floor(F.col("seat") * shards / F.col("seats")).cast("int")
    return (
        seats.groupBy("key", "block_words", "n_blocks", shard.alias("shard"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key", "block_words", "n_blocks")
        .agg(
            F.sum("n").alias("seats"),
            F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("quotas"),
        )
        .select(
            "key",
            F.struct(
                "block_words",
                "n_blocks",
                entry.alias("entry"),
                F.floor(F.col("seats") / F.col("n_blocks")).alias("laps"),
                (F.col("seats") % F.col("n_blocks")).alias("rest"),
                "quotas",
            ).alias("turn"),
        )
    )


def _shard_of(turn: Column, lap: Column, word: Column) -> Column:
    """Shard of the seat that takes this word of the source's run in this lap."""
    block = F.floor(word / turn["block_words"])
    seat = lap * turn["n_blocks"] + F.pmod(block - turn["entry"], turn["n_blocks"])
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("shard"))
    return F.aggregate(
        turn["quotas"],
        none,
        lambda acc, x: F.struct(
            (acc["n"] + x["n"]).alias("n"),
            F.coalesce(acc["shard"], F.when(seat < acc["n"] + x["n"], x["shard"])).alias("shard"),
        ),
        lambda acc: acc["shard"],
    )


def taken_pieces(turn: Column, source_size: Column, start: Column, size: Column) -> Column:
    """array of struct(lap, from, to): the words taken of a document at `start` of its source."""
    words, end = turn["block_words"], turn["entry"] + turn["rest"]
    stretches = F.array(
        F.struct(
            F.lit(0).cast("long").alias("low"),
            ((end - turn["n_blocks"]) * words).alias("high"),
        ),
        F.struct(
            (turn["entry"] * words).alias("low"), F.least(end * words, source_size).alias("high")
        ),
    )
    whole_laps = F.when(
        turn["laps"] > 0,
        F.transform(
            F.sequence(F.lit(1).cast("long"), turn["laps"]),
            lambda lap: F.struct(
                (lap - 1).alias("lap"), F.lit(0).cast("long").alias("from"), size.alias("to")
            ),
        ),
    ).otherwise(F.array().cast("array<struct<lap:bigint,from:bigint,to:bigint>>"))
    partial = F.transform(
        stretches,
        lambda x: F.struct(
            turn["laps"].alias("lap"),
            F.greatest(x["low"] - start, F.lit(0)).alias("from"),
            F.least(x["high"] - start, size).alias("to"),
        ),
    )
    pieces = F.filter(F.concat(whole_laps, partial), lambda x: x["from"] < x["to"])
    return F.coalesce(pieces, F.array().cast("array<struct<lap:bigint,from:bigint,to:bigint>>"))


def plan_mix(
    docs: DataFrame,
    weights: Callable[[DataFrame], DataFrame] = cycling_weights,
    *,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    percent: int = 150,
    max_repeat: int = 2,
    seed: int = 17,
    shards: int = 8,
    house: int = HOUSE,
) -> DataFrame:
    """The table with one more column `mix`, telling which words of each document are taken.

    mix is a struct of size (words), source_size and target (of its source, in
    words), start (its place in the run of its source), turn (see
    `source_turns`), pieces (lap, from, to: words, `to` excluded) and taken
    (words, repeats counted). `weights` adds a column `weight` to a table that
    has one row (key, source_size) per source; see `source_key`.

    Null texts have 0 words. A null source is a source of its own, ordered last.
    Rows with the same id, source and text follow each other and are taken
    independently. Nothing depends on partitioning, so reruns agree. A column
    `mix` of the input is replaced.

    A hot source is no hot task: its order is cut into 4,096 runs, which are
    summed up first and sorted each by itself.
    """
    docs = docs.drop("mix")
    key, size, order, run = (unused(docs, k) for k in ("key", "size", "order", "run"))
    words = column(docs, text)
    identity = F.coalesce(column(docs, doc_id).cast("string"), F.lit(""))
    digest = F.md5(
        F.concat(
            F.lit(f"{seed}:"), identity, F.lit(":"), F.md5(whole(words).cast("binary"))
        ).cast("binary")
    )
    measured = docs.select(
        "*",
        source_key(column(docs, source)).alias(key),
        word_count(words).alias(size),
        digest.alias(order),
    ).withColumn(run, F.substring(order, 1, RUN_DIGITS))

    runs = measured.groupBy(F.col(key).alias("key"), F.col(run).alias("run")).agg(
        F.sum(size).alias("run_words")
    )
    sources = runs.groupBy("key").agg(F.sum("run_words").alias("source_size"))
    targets = source_targets(weights(sources), percent, max_repeat)
    targets = block_sizes(targets, house)
    turns = source_turns(apportion(targets, max_repeat), seed, shards)
    small = apportion_words(targets, shards, max_repeat)
    by_words = word_turn(F.col("words"), F.col("quotas"), F.col("source_size"), seed)

    # Each run of a source begins where the runs before it end.
    earlier = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        runs.withColumn("begin", F.coalesce(F.sum("run_words").over(earlier), F.lit(0)))
        .join(targets, "key")
        .join(turns, "key", "left")
        .join(small, "key", "left")
        .select(
            F.col("key").alias("begin_key"),
            F.col("run").alias("begin_run"),
            F.struct(
                "begin", "source_size", "target", F.coalesce("turn", by_words).alias("turn")
            ).alias("mix"),
        )
    )
    placed = measured.join(
        begins, (F.col(key) == F.col("begin_key")) & (F.col(run) == F.col("begin_run"))
    )
    ahead = Window.partitionBy(key, run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("mix.begin") + F.sum(size).over(ahead) - F.col(size)
    placed = placed.withColumn("mix", F.col("mix").withField("start", start))
    mix, n = F.col("mix"), F.col(size)
    placed = placed.withColumn(
        "mix",
        F.struct(
            n.alias("size"),
            *(mix[c].alias(c) for c in ("source_size", "target", "start", "turn")),
            taken_pieces(mix["turn"], mix["source_size"], mix["start"], n).alias("pieces"),
        ),
    )
    taken = F.aggregate(
        mix["pieces"], F.lit(0).cast("long"), lambda acc, x: acc + x["to"] - x["from"]
    )
    return placed.select(
        *[column(docs, c) for c in docs.columns], mix.withField("taken", taken).alias("mix")
    )


def mix_sources(
    docs: DataFrame, *, text: str = "text", shard: str = "mix_shard", **settings
) -> DataFrame:
    """The mix itself: a row for every taken piece of a document, with its columns and
    a column `shard`, the shard of the mix it goes to, in place of any of that name; the house is cut into `shards`
    equal parts in the order of its seats, and a piece goes where its first word
    goes. A cut document's text is the words taken with the white space that
    follows them; other texts stay as they are. Settings as for `plan_mix`.
    """
    docs, own = docs.drop(shard), unused(docs, "mix")
    names = [own if c == "mix" else c for c in docs.columns]
    piece, mix = unused(docs, "piece"), F.col("mix")
    taken = plan_mix(docs.withColumnRenamed("mix", own), text=text, **settings).withColumn(piece, F.explode("mix.pieces"))
    first, stop = F.col(piece)["from"], F.col(piece)["to"]
    words = F.regexp_extract_all(column(taken, text), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(words, (first + 1).cast("int"), (stop - first).cast("int")), "")
    uncut = (first == 0) & (stop == mix["size"])
    shown = F.when(uncut, column(taken, text)).otherwise(part)
    goes_to = _shard_of(mix["turn"], F.col(piece)["lap"], mix["start"] + first)
    pieces = taken.select(
        *[
            (shown if c == text else column(taken, n)).alias(n)
            for c, n in zip(docs.columns, names, strict=True)
        ],
        goes_to.alias(shard),
    )
    return pieces.withColumnRenamed(own, "mix") if own in names else pieces
