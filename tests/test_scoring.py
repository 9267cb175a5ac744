import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagedex.functions import bm25
from passagedex.operators import scoring
from passagedex.plans import lexical
from passagedex.plans.lexical import build_index, open_index
from tests.test_lexical import QUERIES, asked, check, corpus, passages


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scoring") / "ix")
    build_index(spark, passages(spark, corpus()), path, n_shards=4)
    return path


def factors(rows):
    names = ["query_id", "term", "factor", "needed", "floor", "bar"]
    return pa.table({n: pa.array(c) for n, c in zip(names, zip(*rows))})


def best(rows, postings, k, most_rows):
    """Best k by the kernel, from (key, {term: weight}) given a few passages at a time."""
    table = factors(rows)
    terms = table["term"].combine_chunks().unique()
    parts = list(scoring.query_parts(table, terms, most_rows))
    found = scoring._Best(parts, len(terms), k)
    number = {t: n for n, t in enumerate(terms.to_pylist())}
    for at in range(0, len(postings), 7):
        some = postings[at : at + 7]
        flat = [(r, number[t], w) for r, (_, has) in enumerate(some) for t, w in has.items()]
        row, term, weight = zip(*flat)
        keys = np.array([key for key, _ in some], dtype=object)
        found.add(keys, np.array(row), np.array(term), np.array(weight, dtype=float))
    out = {}
    for batch in found.rows():
        for r in batch.to_pylist():
            out.setdefault(r["query_id"], []).append((-r["units"], r["doc_key"]))
    return parts, out


@pytest.mark.parametrize("pairs, sparse", [(5, 8), (10**6, 8), (40, 0)])
@pytest.mark.parametrize("pruned", [False, True])
def test_best_rows_are_those_of_the_definition(monkeypatch, pairs, sparse, pruned):
    monkeypatch.setattr(scoring, "PAIRS", pairs)
    monkeypatch.setattr(scoring, "SPARSE", sparse)
    dice = random.Random(5)
    words = [f"t{i}" for i in range(12)]
    postings = [
        (f"k{i:03d}", {t: dice.choice([0.5, 1.0]) for t in dice.sample(words, dice.randint(1, 6))})
        for i in range(90)
    ]
    dice.shuffle(postings)
    queries = {f"q{i}": dice.sample(words, dice.randint(1, 6)) for i in range(9)} | {None: ["t3"]}
    factor = {t: float(1 + n % 3) for n, t in enumerate(words)}
    unit, k = 2**40, 4
    want, rows = {}, []
    for query, terms in queries.items():
        full = []
        for key, has in postings:
            units = sum(round(factor[t] * has[t] * unit) for t in terms if t in has)
            full += [(-units, key)] if units else []
        want[query] = sorted(full)[:k]
        floor = -want[query][-1][0] if pruned and len(want[query]) == k else 0
        # The terms that together stay below the floor, lightest first.
        weak, needed = 0, {}
        for t in sorted(terms, key=factor.get):
            needed[t] = weak + factor[t] * unit >= floor or not all(needed.values())
            needed[t] = bool(needed[t] or any(needed.values()))
            weak += 0 if needed[t] else int(factor[t] * unit)
        rows += [(query, t, factor[t], needed[t], floor, floor - weak) for t in terms]
    parts, found = best(rows, postings, k, most_rows=8)
    assert found == want
    assert len(parts) > 3 and all(len(p.query) <= 8 for p in parts)


def test_ranking_neither_moves_nor_sorts_matches(spark, built):
    index = open_index(spark, built)
    for direct in (index.direct_postings, 0):
        index.direct_postings, index.worth_pruning = direct, 1.0
        (block,) = index._blocks(asked(spark, QUERIES))
        rows = index._best_matches(block, 5)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Aggregate" not in plan
        assert "Bucketed: true" in plan
        # Four buckets give their best rows, not their matches.
        n_queries = rows.select("query_id").distinct().count()
        assert rows.count() <= 4 * 5 * n_queries
    assert rows.count() < index.scores(asked(spark, QUERIES)).count()


def test_blocks_read_the_postings_once(spark, built):
    index = open_index(spark, built)
    index.broadcast_rows = 6
    queries = asked(spark, QUERIES * 3)
    assert len(index._blocks(queries)) > 3
    (block,) = index._ranked_blocks(queries)
    assert block.small
    check(index, spark, corpus(), QUERIES * 3, 10)


def test_words_of_no_passage_fill_no_blocks(spark, built):
    index = open_index(spark, built)
    index.broadcast_rows = index.held_rows = 20
    queries = QUERIES + [f"nowhere{i} none{i}" for i in range(40)]
    assert len(index._ranked_blocks(asked(spark, queries))) == 1
    check(index, spark, corpus(), queries, 3)


def test_queries_beyond_a_task_and_beyond_a_broadcast(spark, built):
    index = open_index(spark, built)
    index.broadcast_rows, index.held_rows = 2, 4
    blocks = index._ranked_blocks(asked(spark, QUERIES))
    assert len(blocks) > 1 and {block.small for block in blocks} == {True, False}
    check(index, spark, corpus(), QUERIES, 10)


def test_postings_of_a_large_shard_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    tasks = {}
    insert = lexical.LexicalIndex._insert

    def noted(self, table, rows, batch_id):
        tasks[table] = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        insert(self, table, rows, batch_id)

    monkeypatch.setattr(lexical.LexicalIndex, "_insert", noted)
    monkeypatch.setattr(lexical, "POSTINGS_SPLIT", 20_000)
    dice = random.Random(9)
    texts = [" ".join(f"w{dice.randrange(10**6)}" for _ in range(40)) for _ in range(600)]
    index = build_index(spark, passages(spark, texts), str(tmp_path / "ix"), n_shards=1)
    made = tasks[index._postings]
    assert sum(made) >= 600 * 39 and max(made) < sum(made) / 3
    check(index, spark, texts, [texts[3], "w1 w2", texts[7]], 5)


@pytest.mark.parametrize("pairs, sparse", [(5, 8), (10**6, 8), (40, 0)])
def test_every_pair_that_shares_a_term_is_summed(monkeypatch, pairs, sparse):
    monkeypatch.setattr(scoring, "PAIRS", pairs)
    monkeypatch.setattr(scoring, "SPARSE", sparse)
    # t0 counts for nothing, but a passage that holds it is matched.
    factor = {"t0": 0.0, "t1": 1.0, "t2": -1.0, "t3": 2.5}
    queries = {"a": ["t0"], "b": ["t1", "t2", "t3"], None: ["t3"], "c": ["t9"]}
    rows = [(q, t, factor.get(t, 1.0), True, 0, 0) for q, terms in queries.items() for t in terms]
    dice = random.Random(2)
    postings = {
        None if i == 4 else f"k{i}": {t: 0.5 * (1 + i % 3) for t in factor if dice.random() < 0.6}
        for i in range(40)
    }
    table = factors(rows)
    terms = table["term"].combine_chunks().unique()
    number = {t: n for n, t in enumerate(terms.to_pylist())}
    every = scoring._All(list(scoring.query_parts(table, terms, 2)), len(terms))
    batch = pa.record_batch(
        {
            "doc_key": pa.array(list(postings), pa.string()),
            "numbers": pa.array([[number[t] for t in has] for has in postings.values()], pa.list_(pa.int32())),
            "weights": pa.array([list(has.values()) for has in postings.values()], pa.list_(pa.float64())),
        }
    )
    names = ["query_id", "doc_key", "units"]
    found = [tuple(r.values()) for b in every.rows(batch, names) for r in b.to_pylist()]
    want = {
        (q, key): round(sum(factor[t] * has[t] for t in asks if t in has) * 2**40)
        for key, has in postings.items()
        for q, asks in queries.items()
        if any(t in has for t in asks)
    }
    assert len(found) == len(want) and {(q, key): u for q, key, u in found} == want


def test_scores_are_rounded_as_round_does(spark):
    dice = random.Random(6)
    some = [dice.randrange(2 ** dice.randint(1, 57)) for _ in range(3000)]
    # Ties of the fourth decimal, and the numbers next to what would be one.
    some += [(2 * i + 1) * 2**35 + d for i in range(200) for d in (-1, 0, 1)]
    some += [round((i + 0.5) * 2**40 / 10_000) + d for i in range(0, 10**6, 4999) for d in (-1, 0, 1)]
    rows = [(s * u,) for u in some for s in (1, -1)]
    units = spark.createDataFrame(rows, "units bigint")
    plain = F.round(bm25.from_units(F.col("units")), 4)
    both = units.select("units", plain.alias("a"), bm25.rounded_units(F.col("units")).alias("b"))
    assert not both.where(F.col("a").cast("string") != F.col("b").cast("string")).collect()
