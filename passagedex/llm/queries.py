"""The corpus operators applied to the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagedex.llm import bpe, merkle, oracles
from passagedex.llm.classifier import fit_quality, held_out, quality_score
from passagedex.llm.common import whole
from passagedex.llm.decontaminate import find_benchmark
from passagedex.llm.line_quality import measure_lines
from passagedex.llm.mixing import plan_mix
from passagedex.llm.near_dedup import find_near_duplicates
from passagedex.llm.phrases import mine_phrases
from passagedex.llm.sharding import shard_documents
from passagedex.llm.substring_dedup import find_repeats
from passagedex.llm.token_counts import token_count
from passagedex.llm.tool_calls import format_tool_calls
from passagedex.llm.url_filters import judged

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MAX_TOKENS = 1024
N_SHARDS = 8
GOOD_SCORE = 0.7
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered(oracles.DECONTAMINATION)
def op1_decontamination(spark, sf_dir):
    """What every document shares with the benchmark."""
    found = find_benchmark(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    items = F.col("leaks.items")
    return found.select(
        "doc_id",
        "leaks.n_words",
        "leaks.n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("leaks.n_hit") > 0).alias("contaminated"),
    )


@registered()
def op2_token_counts(spark, sf_dir):
    """Bytes and tokens of every document."""
    docs = _table(spark, sf_dir, "documents")
    vocabulary = str(public_tokenizers.path("byte_bpe_50k.json"))
    n_tokens = token_count(spark, F.col("text"), vocabulary)
    counted = docs.select(
        "doc_id",
        F.octet_length(whole(F.col("text"))).cast("long").alias("n_bytes"),
        n_tokens.alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


@registered(oracles.URL_FILTERS)
def op4_url_filters(spark, sf_dir):
    """Every page's url judged by the four rules."""
    pages = _table(spark, sf_dir, "pages")
    verdict = judged(spark, F.col("url"), URL_RULES)
    return pages.select("page_id", verdict.alias("v")).select("page_id", "v.*")


TOOLS = [
    (
        name,
        '{"type": "object", "properties": {"query": {"type": "string"}, '
        '"limit": {"type": "integer"}}, "required": ["query", "limit"]}',
    )
    for name in ("search", "summarise")
]


def _tool_tables(spark, sf_dir):
    """Calls and results that the conversations stand for.

    A user's turn is a call, the assistant's turn after it the result. A call
    names the user's turn before it, two turns back, so a conversation is a chain of
    calls; depending on the length of the text also the one before that, and a turn
    of the assistant, which is no call. Depending on the length of
    the text a call lacks an argument, has one of a wrong type, an extra one or
    broken JSON, or names a tool that does not exist.
    """
    turns = _table(spark, sf_dir, "conversations")
    size = F.char_length("text")

    def call_id(turn):
        return F.format_string("call_%d_%d", "conv_id", turn)

    query, limit = F.col("text").alias("query"), size.alias("limit")
    plain = F.struct(query, limit)
    arguments = (
        F.when(size % 7 == 0, F.to_json(F.struct(query)))
        .when(size % 11 == 0, F.to_json(F.struct(query, size.cast("string").alias("limit"))))
        .when(size % 13 == 0, F.to_json(F.struct(F.lit(True).alias("deep"), query, limit)))
        .when(size % 17 == 0, F.concat(F.to_json(plain), F.lit("]")))
        .otherwise(F.replace(F.to_json(plain), F.lit('"limit":'), F.lit(' "limit" : ')))
    )
    name = (
        F.when(size % 19 == 0, "guess").when(size % 2 == 0, "search").otherwise("summarise")
    )
    turn = F.col("turn")
    after = F.array(
        F.when(turn >= 2, call_id(turn - 2)),
        F.when((turn >= 4) & (size % 5 == 0), call_id(turn - 4)),
        F.when(size % 23 == 0, call_id(turn + 1)),
    )
    calls = turns.where("role = 'user'").select(
        "conv_id",
        "turn",
        call_id(F.col("turn")).alias("call_id"),
        name.alias("name"),
        arguments.alias("arguments"),
        F.array_compact(after).alias("after"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id",
        "turn",
        call_id(F.col("turn") - 1).alias("call_id"),
        F.col("text").alias("content"),
    )
    return calls, results, spark.createDataFrame(TOOLS, "name string, parameters string")


@registered(oracles.TOOL_CALLS)
def op3_tool_calls(spark, sf_dir):
    """Tool calls of all conversations, linked, ordered, validated and serialised."""
    formatted = format_tool_calls(*_tool_tables(spark, sf_dir))
    return formatted.withColumn("errors", F.array_join("errors", ","))


@registered()
def op5_sharding(spark, sf_dir):
    """Every document's place in eight shards of nearly equal bytes."""
    placed = shard_documents(_table(spark, sf_dir, "documents"), n_shards=N_SHARDS)
    return placed.select(
        "doc_id",
        "place.size",
        F.crc32(whole(F.col("text")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "place.shard",
        "place.slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@registered(oracles.MIXING)
def op6_mixing(spark, sf_dir):
    """How often the mix takes every document."""
    mixed = plan_mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@registered()
def op7_near_dedup(spark, sf_dir):
    """Near-duplicate component of every document."""
    return find_near_duplicates(_table(spark, sf_dir, "documents"))


@registered(oracles.LINE_QUALITY)
def op8_line_quality(spark, sf_dir):
    """Measures and verdict of every document."""
    measured = measure_lines(_table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured.select(
        "doc_id", *[f"quality.{n}" for n in names], "quality.base_failed", "quality.kept"
    )


@registered(oracles.SUBSTRING_DEDUP)
def op9_substring_dedup(spark, sf_dir):
    """What every document keeps once repeated passages are cut."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_repeats(docs).select(
        "doc_id", "repeats.n_words", "repeats.n_removed", "repeats.kept_sha256"
    )


@registered()
def op10_quality_classifier(spark, sf_dir):
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    forest = fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = quality_score(docs, forest)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"),
    )


@registered(oracles.MERKLE)
def op11_merkle_manifest(spark, sf_dir):
    """Every document's proof, folded anew with a seventh of the rows tampered with."""
    docs = _table(spark, sf_dir, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    longer = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names]
    proved = merkle.manifest(docs, names, forged=F.when(tampered, merkle.leaf(*longer)))
    presented = F.coalesce("forged", "leaf")
    return proved.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.siblings_digest(F.col("proof")).alias("proof_sha256"),
        merkle.folded(presented, F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@registered(oracles.PHRASES)
def op12_phrase_collocations(spark, sf_dir):
    """The 2,000 best collocations of every language."""
    return mine_phrases(_table(spark, sf_dir, "documents"))


@registered()
def op13_bpe_round_trip(spark, sf_dir):
    """Digests of every document's token ids and of the text they decode to."""
    vocabulary = str(public_tokenizers.path("word_bpe_49k.json"))
    docs = _table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", bpe.round_trip(spark, F.col("text"), vocabulary).alias("c"))
    return coded.select(
        "doc_id",
        (F.octet_length("c.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("c.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("c.text").cast("binary"), 256).alias("decoded_sha256"),
    )
