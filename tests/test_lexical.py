import random

import pytest
from pyspark.sql import functions as F

from passagedex.functions.bm25 import Parameters
from passagedex.operators import statistics
from passagedex.plans import lexical
from passagedex.plans.lexical import build_index, create_index, open_index, rebuild_from_passages
from tests import plain


def passages(spark, texts, path="f"):
    rows = [
        (f"{path}//{i:03d}#000000", path, str(i), 0, "title", text, None)
        for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, lexical.PASSAGE).repartition(3)


def asked(spark, texts):
    rows = [(i, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id int, text string")


def hits(df):
    rows = sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"]))
    found = {}
    for row in rows:
        found.setdefault(row["query_id"], []).append((row["doc_key"], row["score"]))
        assert row["rank"] == len(found[row["query_id"]])
    return found


def check(index, spark, texts, queries, k):
    keys = [f"f//{i:03d}#000000" for i in range(len(texts))]
    found = hits(index.search(asked(spark, queries), k))
    for number, query in enumerate(queries):
        want = plain.ranking(keys, plain.bm25(texts, query.lower().split()), k)
        assert [key for key, _ in found[number]] == [key for key, _ in want], query
        for (_, score), (_, expected) in zip(found[number], want):
            assert score == pytest.approx(expected, abs=1e-6)


def corpus(n=120):
    dice = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    heavy = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(dice.choices(words, heavy, k=dice.randint(0, 25))) for _ in range(n)]
    return texts + texts[:10] + [""]


QUERIES = ["w1 w5 w40", "W3 w3 w17", "zzz", "", "w0", "w0 w1 w2 w3 w4", "w59 w58 nope"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "ix")
    return build_index(spark, passages(spark, corpus()), path, n_shards=4), path


def test_ranking_follows_the_definition(spark, built):
    check(built[0], spark, corpus(), QUERIES, 10)


def test_k_beyond_the_corpus_returns_everything(spark, built):
    check(built[0], spark, corpus(), QUERIES[:3], 500)


def test_opened_index_answers_the_same(spark, built):
    index, path = built
    again = open_index(spark, path)
    assert again.corpus == index.corpus
    check(again, spark, corpus(), QUERIES, 7)


def test_pruned_search_is_exact(spark, built, monkeypatch):
    index = open_index(spark, built[1])
    index.direct_postings, index.worth_pruning = 0, 1.0
    for budget in (1, 40, 10_000):
        monkeypatch.setattr(lexical, "PROBE_POSTINGS", budget)
        check(index, spark, corpus(), QUERIES, 5)


def test_large_query_sets_are_exact(spark, built):
    index = open_index(spark, built[1])
    index.broadcast_rows = 2
    check(index, spark, corpus(), QUERIES, 10)


def test_padding_beyond_the_stored_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "HEAD_KEYS", 3)
    monkeypatch.setattr(lexical, "PLACES_PER_ROW", 4)
    texts = corpus(30)
    index = build_index(spark, passages(spark, texts), str(tmp_path / "ix"), n_shards=2)
    check(index, spark, texts, QUERIES, 9)
    same = ["a b"] * 3 + ["a"] * 2 + ["b c"]
    index = build_index(spark, passages(spark, same), str(tmp_path / "same"), n_shards=2)
    assert index.corpus["mean_idf"] < 0
    check(index, spark, same, ["a", "b", "c a", "zzz"], 4)


def test_negative_mean_takes_the_first_unmatched_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "PLACES_PER_ROW", 3)
    dice = random.Random(8)
    texts = [" ".join(w for w in "a b c d".split() if dice.random() < 0.9) for _ in range(60)]
    texts[7] = "rare a"
    index = build_index(spark, passages(spark, texts), str(tmp_path / "ix"), n_shards=3)
    assert index.corpus["mean_idf"] < 0
    queries = ["a", "a b c d", "rare", "rare a", "zzz", "", "d d"]
    for k in (1, 5, 59, 200):
        check(index, spark, texts, queries, k)


def test_negative_mean_makes_no_row_per_passage_and_query(spark, tmp_path):
    texts = ["a b"] * 400 + ["a"] * 3 + ["b only"]
    index = build_index(spark, passages(spark, texts), str(tmp_path / "ix"), n_shards=2)
    assert index.corpus["mean_idf"] < 0
    queries = asked(spark, ["only", "zzz", "a"])
    found = index.scores(queries)
    rows = index._unmatched_rows(queries, found, 2).groupBy("query_id").count().collect()
    # One match and two more, two, and the one passage without "a".
    assert {r["query_id"]: r["count"] for r in rows} == {0: 3, 1: 2, 2: 1}
    plan = index.search(queries, 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tiny_corpora_with_negative_mean(spark, tmp_path):
    for n, texts in enumerate((["a a"], ["a", "a", "a"], ["a b", "a b", "c", "a"])):
        index = build_index(spark, passages(spark, texts), str(tmp_path / f"{n}"), n_shards=2)
        check(index, spark, texts, ["a", "b", "c", "x", "a a"], 10)


def test_one_query_as_text_or_words(spark, built):
    by_text = hits(built[0].search_one("W1  w5", 4))
    by_words = hits(built[0].search_one(["w1", "w5"], 4))
    assert by_text == by_words and len(by_text["q"]) == 4


@pytest.mark.parametrize("k", [0, -1])
def test_k_must_be_positive(spark, built, k):
    with pytest.raises(ValueError):
        built[0].search(asked(spark, ["w1"]), k)


def test_records_carry_their_own_metadata(spark, tmp_path):
    path = str(tmp_path / "ix")
    parts = [[f"batch{b} item{b}x{i} word" for i in range(5)] for b in range(3)]
    for number, texts in enumerate(parts):
        build_index(spark, passages(spark, texts, f"p{number}"), path, "append", n_shards=2)
    index = open_index(spark, path)
    assert index.document_count() == 15
    assert {r["batch_id"]: r["n_passages"] for r in index.batches().collect()} == {0: 5, 1: 5, 2: 5}
    queries = asked(spark, [f"item{b}x{i}" for b in range(3) for i in range(5)])
    for row in index.records(index.search(queries, 1)).collect():
        batch, item = divmod(row["query_id"], 5)
        assert row["metadata"]["id"] == str(item)
        assert row["document"] == row["metadata"]["text"] == parts[batch][item]


def test_appending_equals_building_at_once(spark, tmp_path):
    texts = corpus(40)
    whole = build_index(spark, passages(spark, texts), str(tmp_path / "whole"), n_shards=2)
    rows = passages(spark, texts)
    path = str(tmp_path / "parts")
    build_index(spark, rows.where("id < 13"), path, "append", n_shards=2)
    build_index(spark, rows.where("id >= 13"), path, "append")
    parts = open_index(spark, path)
    for field in ("n_docs", "total_len", "n_terms", "n_postings"):
        assert parts.corpus[field] == whole.corpus[field]
    assert parts.corpus["mean_idf"] == pytest.approx(whole.corpus["mean_idf"])
    found = hits(parts.search(asked(spark, QUERIES), 6))
    stripped = {q: [(key.split("@")[0], s) for key, s in rows] for q, rows in found.items()}
    expected = hits(whole.search(asked(spark, QUERIES), 6))
    for query, rows in expected.items():
        assert [k for k, _ in stripped[query]] == [k for k, _ in rows]
        assert [s for _, s in stripped[query]] == pytest.approx([s for _, s in rows], abs=1e-6)


def test_same_article_twice_is_there_twice(spark, tmp_path):
    path = str(tmp_path / "ix")
    for _ in range(2):
        build_index(spark, passages(spark, ["a b", "c"]), path, "append", n_shards=2)
    index = open_index(spark, path)
    assert index.document_count() == 4
    assert index.passages().select("doc_key").distinct().count() == 4


def test_unfinished_and_retried_batches(spark, tmp_path):
    path = str(tmp_path / "ix")
    build_index(spark, passages(spark, ["a b", "c"]), path, "append", n_shards=2)
    index = open_index(spark, path)
    number = index.claim_batch("job")
    index.write_batch(passages(spark, ["half"], "g"), number)
    assert open_index(spark, path).passages().count() == 2
    assert index.claim_batch("job") == number
    index.write_batch(passages(spark, ["x", "y", "z"], "g"), number)
    index.publish()
    assert index.document_count() == 5 == index.passages().count()
    assert index.publish().document_count() == 5


def test_rebuild_starts_over_and_keeps_parameters(spark, tmp_path):
    path, other = str(tmp_path / "ix"), str(tmp_path / "other")
    build_index(spark, passages(spark, ["a", "b"]), path, n_shards=2)
    build_index(
        spark, passages(spark, ["c", "d", "e"]), path, n_shards=2, parameters=Parameters(k1=2.0)
    )
    assert open_index(spark, path).document_count() == 3
    again = rebuild_from_passages(spark, path, other)
    assert again.document_count() == 3 and again.parameters.k1 == 2.0
    assert sorted(r["term"] for r in again.term_stats().collect()) == ["c", "d", "e"]


def test_empty_and_missing_indexes(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        open_index(spark, str(tmp_path / "none"))
    empty = rebuild_from_passages(spark, str(tmp_path / "none"), str(tmp_path / "ix"))
    assert empty.search(asked(spark, ["a"])).collect() == []
    stats = create_index(spark, str(tmp_path / "two"), 2).statistics().first()
    assert (stats["document_count"], stats["has_index"]) == (0, False)
    assert stats["average_document_length"] == 0


def test_passages_given_as_words(spark, tmp_path):
    texts = ["red fox", "blue whale", "red whale"]
    words = passages(spark, texts).withColumn("tokens", F.split("text", " ")).drop("text")
    index = build_index(spark, words, str(tmp_path / "ix"), n_shards=2)
    check(index, spark, texts, ["red", "blue red"], 3)


def test_weights_agree_with_scores(spark, built):
    index, _ = built
    weights = {(r["term"], r["doc_key"]): r["weight"] for r in index.weights().collect()}
    for row in index.scores(asked(spark, ["w7"])).collect():
        assert row["units"] / 2**40 == pytest.approx(weights["w7", row["doc_key"]], abs=1e-9)


def test_scores_are_summed_without_a_shuffle(spark, built):
    plan = built[0].scores(asked(spark, ["w1 w2"]))._jdf.queryExecution().executedPlan().toString()
    above_scan = plan.split("BroadcastHashJoin")[0]
    assert "HashAggregate" in above_scan and "Exchange" not in above_scan
    assert "PushedFilters: [In(term, [w1,w2])" in plan
    assert "Bucketed: true" in plan
    search = built[0].search(asked(spark, ["w1"]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in search


def test_matches_move_to_their_query_once(spark, built):
    plan = built[0].search(asked(spark, QUERIES), 5)._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not [line for line in moves if "doc_key" in line]
    # One of the matches, one of the bare query ids that ask for padding.
    assert len([line for line in moves if "term" not in line]) == 2


def test_rankings_of_many_rows_are_cut_in_slices(spark, built):
    index = open_index(spark, built[1])
    index.rows_per_ranking = 20
    check(index, spark, corpus(), QUERIES, 10)
    check(index, spark, corpus(), QUERIES[:3], 200)


def test_a_query_given_twice_is_one_query(spark, built):
    once = hits(built[0].search(asked(spark, ["w59", "zzz"]), 6))
    rows = [(0, "w59"), (1, "zzz"), (1, None), (1, ""), (0, "")]
    again = spark.createDataFrame(rows, "query_id int, text string")
    assert hits(built[0].search(again, 6)) == once


def test_writers_never_share_a_batch_number(spark, tmp_path):
    path = str(tmp_path / "index")
    first = create_index(spark, path, 2)
    second = open_index(spark, path)
    listed = second._numbered
    stale = listed("claims")
    numbers = [first.claim_batch("one")]
    # The second writer looked before the first one claimed.
    second._numbered = lambda folder: stale if folder == "claims" else listed(folder)
    numbers.append(second.claim_batch("two"))
    assert numbers == [0, 1]
    assert [first.claim_batch("one"), second.claim_batch("two")] == numbers


@pytest.mark.parametrize("before", ["_take_version", "_publish_batches", "_terms"])
def test_a_writer_publishing_inside_another_publish_loses_nothing(spark, tmp_path, monkeypatch, before):
    path = str(tmp_path / "ix")

    def batch(name):
        return passages(spark, [f"only {name}"], name)

    build_index(spark, batch("zero"), path)
    one, two = open_index(spark, path), open_index(spark, path)
    inner = getattr(lexical.LexicalIndex, before)
    pending = [batch("two")]

    def interrupted(self, *args):
        if self is one and pending:
            two.append(pending.pop())
        return inner(self, *args)

    monkeypatch.setattr(lexical.LexicalIndex, before, interrupted)
    one.append(batch("one"))
    last = open_index(spark, path)
    assert last.document_count() == 3 and last.corpus["n_terms"] == 4
    for name in ("zero", "one", "two"):
        best = last.records(last.search_one(name, 1)).first()
        assert best["document"] == f"only {name}"


def test_a_shard_is_small_whatever_the_input():
    for n_bytes in (10**8, 10**9, 6 * 10**9, 10**11):
        assert n_bytes / lexical.shards_for(n_bytes) <= 8_000_000


def test_unpruned_rankings_leave_out_matches_below_the_floor(spark, built):
    index = open_index(spark, built[1])
    index.direct_postings, index.worth_pruning = 0, 0.0
    check(index, spark, corpus(), QUERIES, 5)
    queries = asked(spark, QUERIES)
    (block,) = index._blocks(queries)
    kept = {(r["query_id"], r["doc_key"]) for r in index._best_matches(block, 5).collect()}
    scored = {(r["query_id"], r["doc_key"]) for r in index.scores(queries).collect()}
    assert kept < scored


def test_postings_are_made_from_few_passages_a_task(spark, tmp_path, monkeypatch):
    tasks = {}
    insert = lexical.LexicalIndex._insert

    def noted(self, table, rows, batch_id):
        tasks[table] = rows.rdd.getNumPartitions()
        insert(self, table, rows, batch_id)

    monkeypatch.setattr(lexical.LexicalIndex, "_insert", noted)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    texts = [f"w{i} w{i % 7} w{i % 3}" for i in range(400)]
    index = build_index(spark, passages(spark, texts), str(tmp_path / "ix"), n_shards=64)
    # Some 64 files of 4 MB, as Spark reckons the cost of opening one.
    assert tasks[index._postings] >= 16
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == split


def test_postings_meet_their_terms_in_more_tasks_the_more_there_are(spark, monkeypatch):
    rows = [(f"t{i % 40}", f"d{i}", 1, 3) for i in range(400)]
    postings = spark.createDataFrame(rows, lexical.POSTING)
    stats = statistics.document_frequencies(postings).withColumn("idf", F.lit(1.5))
    monkeypatch.setattr(statistics, "POSTINGS_PER_TASK", 20)
    joined = statistics.join_term_stats(postings, stats, 400 * 40)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "800)" in plan
    found = {(r["term"], r["doc_key"], r["df"]) for r in joined.collect()}
    assert found == {(term, key, 10) for term, key, _, _ in rows}


def scored(df):
    rows = [((r["query_id"], r["doc_key"]), r["units"] / 2**40) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_scores_are_those_of_every_passage_sharing_a_term(spark, built):
    texts, queries = corpus(), [*QUERIES, "w59 " * 400_000]
    want = {}
    for number, query in enumerate(queries):
        words = query.lower().split()
        for i, score in enumerate(plain.bm25(texts, words)):
            if set(words) & set(texts[i].split()):
                want[number, f"f//{i:03d}#000000"] = score
    index = open_index(spark, built[1])
    # The last query's sums come close to the end of a bigint: Spark adds them.
    for some in (queries[:-1], queries):
        found = scored(index.scores(asked(spark, some)))
        assert found == pytest.approx({k: v for k, v in want.items() if k[0] < len(some)}, rel=1e-9)
    index.broadcast_rows = 2
    again = scored(index.scores(asked(spark, QUERIES)))
    assert again == pytest.approx({k: v for k, v in want.items() if k[0] < len(QUERIES)}, rel=1e-9)


def test_passages_of_one_key_are_scored_together(spark, tmp_path):
    rows = passages(spark, ["a b", "a c", "d"])
    twice = rows.unionByName(rows.where("id = 0"))
    index = build_index(spark, twice, str(tmp_path / "ix"), n_shards=2)
    once = scored(index.scores(asked(spark, ["b c"])))
    weights = {}
    for r in index.weights().where("term IN ('b', 'c')").collect():
        weights[0, r["doc_key"]] = weights.get((0, r["doc_key"]), 0) + r["weight"]
    assert once == pytest.approx(weights, abs=1e-9)
    assert set(once) == {(0, "f//000#000000"), (0, "f//001#000000")}


def test_pairs_of_query_and_passage_are_not_hashed(spark, built):
    plan = built[0].scores(asked(spark, QUERIES))._jdf.queryExecution().executedPlan().toString()
    made = plan.split("FileScan")[0]
    assert "keys=[doc_key" in made and "keys=[query_id" not in made


@pytest.mark.parametrize("n_files", [1, 16])
def test_postings_are_sorted_by_term_alone(spark, tmp_path, monkeypatch, n_files):
    monkeypatch.setattr(lexical, "OPEN_FILES", n_files)
    insert, plans = lexical.LexicalIndex._insert, {}

    def noted(self, table, rows, batch_id):
        columns = ", ".join(c for c in spark.table(table).columns if c != "batch_id")
        explained = spark.sql(
            f"EXPLAIN INSERT OVERWRITE TABLE {table} PARTITION (batch_id = {batch_id}) "
            f"SELECT {columns} FROM {{rows}}",
            rows=rows,
        )
        plans[table] = explained.first()[0]
        insert(self, table, rows, batch_id)

    monkeypatch.setattr(lexical.LexicalIndex, "_insert", noted)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    texts = corpus()
    index = build_index(spark, passages(spark, texts), str(tmp_path / "ix"), n_shards=8)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    sorts = [line for line in plans[index._postings].splitlines() if "Sort [" in line]
    assert len(sorts) == 1 and "Sort [term" in sorts[0]
    check(index, spark, texts, QUERIES, 10)
    files = index.postings().select("term", F.input_file_name().alias("file")).collect()
    by_file = {}
    for row in files:
        by_file.setdefault(row["file"], []).append(row["term"])
    assert len(by_file) >= 8 and all(terms == sorted(terms) for terms in by_file.values())
