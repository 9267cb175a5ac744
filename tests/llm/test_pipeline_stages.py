"""Pipeline stages on a small awkward table, and the mix of small sources against its SQL."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passagedex.llm import mixing, queries
from tests.llm.test_corpus_operators import plain_components, plain_leaks, texts, words_of

SCHEMA = """doc_id long, text string, lang string, source string, n_chars int,
    size int, Shard string, slot int, place int, mix_shard int, mix int, `a.b` int"""


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    made = texts()
    rows = [
        (i, t, "en", "ab"[i % 2] if i % 5 else None, -1, 1, "s", 2, 3, 4, 5, 6)
        for i, t in enumerate(made)
    ]
    rows += [rows[30], rows[30], rows[1], (None, made[31], None, "a", None, *[None] * 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    items = [(1, " ".join(made[25].split()[3:20])), (2, None), (None, "one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), rows, items, str(folder)


def test_stages_keep_all_columns_and_empty_tables(spark, table):
    docs, _, _, folder = table
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        more = [] if name != "sharding" else ["size_1", "shard_1", "slot_1"]
        assert made.columns == [*docs.columns, *more], name
        assert stage(spark, docs.limit(0), folder).collect() == [], name


def test_near_duplicates_stage_keeps_the_first_of_each_component(spark, table):
    docs, rows, _, folder = table
    expected = plain_components(rows)
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()]
    assert sorted(kept) == sorted({c for _, c in expected.values()})


def test_decontamination_stage_drops_what_holds_a_window(spark, table):
    docs, rows, items, folder = table
    made = corpus_pipeline.decontamination(spark, docs, folder).collect()
    clean = [(r[0], r[1]) for r in rows if not plain_leaks(r[1], items)[1]]
    assert Counter((r.doc_id, r.text) for r in made) == Counter(clean)


def test_mixing_and_sharding_stages_neither_lose_nor_make_words(spark, table):
    docs, _, _, folder = table
    planned = mixing.plan_mix(docs)
    mixed = corpus_pipeline.mixing(spark, docs, folder).collect()
    assert sum(len(words_of(r.text)) for r in mixed) == planned.agg(F.sum("mix.taken")).first()[0]
    assert all(r.n_chars == len(r.text or "") for r in mixed)
    placed = corpus_pipeline.sharding(spark, docs, folder).collect()
    assert Counter((r.doc_id, r.text) for r in placed) == Counter((r.doc_id, r.text) for r in docs.collect())
    slots = Counter((r.shard_1, r.slot_1) for r in placed)
    sizes = Counter(r.shard_1 for r in placed)
    assert slots == Counter((s, i) for s, n in sizes.items() for i in range(n))


def test_small_sources_are_mixed_as_the_sql_has_it(spark, tmp_path):
    rows = [(i, "w " * 700, "huge") for i in range(400)]
    rows += [(1000 + i, "x y z " * (1 + i % 7), f"tiny{i % 9}") for i in range(90)]
    rows += [(5000, "only", "one"), (5001, None, "none"), (5002, "a b c", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.plan_mix(docs).where("mix.turn.block_words = 1").count() > 50
    made = queries.QUERIES["op6_mixing"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result = con.sql(queries.ORACLES["op6_mixing"])
    order = [result.columns.index(c) for c in made.columns]
    expected = [tuple(r[i] for i in order) for r in result.fetchall()]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(expected, key=str)


def test_shares_of_the_mix_do_not_depend_on_how_many_shards_there_are(spark):
    rows = [(i, "w " * 900, "huge") for i in range(300)]
    rows += [(1000 + i, "x " * (5 + i % 11), f"tiny{i % 40:02}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = []
    for shards in (1, 8):
        planned = mixing.plan_mix(docs, shards=shards)
        taken.append(Counter({(r.doc_id, r.mix.taken) for r in planned.collect()}))
    assert taken[0] == taken[1]
