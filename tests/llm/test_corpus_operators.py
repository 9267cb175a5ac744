"""The corpus operators against plain definitions, on small awkward tables."""

import hashlib
import json
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passagedex.llm import (
    classifier,
    decontaminate,
    line_quality,
    mixing,
    near_dedup,
    sharding,
    substring_dedup,
    token_counts,
    tool_calls,
    url_filters,
)

SCHEMA = "doc_id long, text string, source string, quality string, mix string, _key int, place int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    """Copies, near copies, shared passages, junk, null, empty, very long, repeated words."""
    chance = random.Random(5)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"Word{i}" for i in range(400)]

    def prose(n):
        return " ".join(chance.choice(vocabulary) + ("." if i % 11 == 10 else "") for i in range(n))

    passage, base = prose(60), prose(200).split(" ")
    made = [None, "", " \t\n ", "one", "two words", "a  b   c\n\n d", "the " * 120, prose(6000)]
    made += [prose(chance.randint(1, 150)) for _ in range(25)]
    made += [f"{prose(30)}\n{passage} {prose(20)}" for _ in range(12)]
    for _ in range(30):
        words = list(base)
        for _ in range(chance.randint(0, 12)):
            words[chance.randrange(len(words))] = chance.choice(vocabulary)
        made.append(" ".join(words))
    made += [made[20]] * 6 + [made[20].upper(), passage, prose(34), prose(35)]
    return made


@pytest.fixture(scope="module")
def rows():
    made = texts()
    sources = ["a", "b", None, "ä", "a", "a"]
    table = [(i, t, sources[i % 6], "q", "m", i, 1) for i, t in enumerate(made)]
    table += [table[30], table[30], table[1], (None, made[31], "b", None, None, None, None)]
    return table


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def by_text(df, column, *more):
    return {(r["doc_id"], r["text"]): r[column] for r in df.select("doc_id", "text", column).collect()}


# ---------------------------------------------------------------- 1


def plain_leaks(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, item_text in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item_text or "").translate(LOWER))
        size = min(10, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [1 << 20, 200])
def test_benchmark_windows(spark, docs, rows, empty, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "MAX_ITEM_BYTES", bound)
    long_text = rows[9][1]
    items = [
        (1, " ".join(rows[40][1].split()[5:40])),
        (2, "one"),
        (3, None),
        (4, "--- ..."),
        (None, "Two, WORDS"),
        (6, long_text.lower()),
        (6, long_text.lower()),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_benchmark(docs, benchmark)
    assert found.columns == [*docs.columns, "leaks"] and found.count() == len(rows)
    for r in found.collect():
        n_words, n_hit, ids = plain_leaks(r.text, items)
        assert (r.leaks.n_words, r.leaks.n_hit, r.leaks["items"]) == (n_words, n_hit, ids)
        assert sum(h["last"] - h["first"] + 1 for h in r.leaks.hits) == n_hit
        for h in r.leaks.hits:
            piece = r.text[h["start"] : h["end"]]
            shown = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", piece.translate(LOWER))
            assert len(shown) == h["last"] - h["first"] + 1
    assert decontaminate.drop_contaminated(docs, benchmark).columns == docs.columns
    assert decontaminate.find_benchmark(empty, benchmark).count() == 0
    nothing = decontaminate.find_benchmark(docs, benchmark.limit(0))
    assert nothing.where("leaks.n_hit > 0").count() == 0


# ---------------------------------------------------------------- 2


def test_tokens_equal_the_library(spark, docs):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    chance = random.Random(3)
    signs = ["a", "B", " ", "\n", "\t", "é", "12", ".", "'s", "\u00a0", "\x1c", "²", "<|endoftext|>"]
    odd = ["".join(chance.choices(signs, k=chance.randint(0, 25))) for _ in range(3000)]
    odd += ["x" * 20_000, " " * 3000 + "a", "日本語" * 500, "don't<|endoftext|"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    df = df.unionByName(docs.select("doc_id", "text"))
    counted = df.withColumn("n", token_counts.token_count(spark, F.col("text"), path))
    for r in counted.collect():
        assert r.n == len(library.encode(r.text or "", add_special_tokens=False).ids), repr(r.text)


def test_proved_tokens_are_whole():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    vocabulary, _ = token_counts.checked_vocabulary(path)
    library = Tokenizer.from_str(vocabulary)
    proved = sorted(token_counts.prove_whole_tokens(vocabulary))
    assert len(proved) > 40_000
    assert {len(e.ids) for e in library.encode_batch(proved, add_special_tokens=False)} == {1}


# ---------------------------------------------------------------- 3


def test_calls_are_linked_ordered_and_validated(spark):
    schema = json.dumps(
        {"type": "object", "properties": {"n": {"type": "integer"}, "q": {"type": "string"}}, "required": ["q"]}
    )
    tools = spark.createDataFrame([("find", schema), ("find", schema)], "name string, parameters string")
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "find", '{"q": "x", "n": 2}', []),
            (1, 2, "b", "find", '{"n": "2"}', ["a", "a"]),
            (1, 4, "c", "find", '{"q": "y"}', ["b", "a", None]),
            (1, 5, "x", "find", '{"q": "y"}', ["y"]),
            (1, 6, "y", "find", '{"q": "y"}', ["x"]),
            (1, 7, "z", "find", "[1", ["nobody"]),
            (1, 8, None, "find", "{}", None),
            (None, 0, "a", None, '{"q": "x"}', None),
            (2, 0, "a", "find", '{"q":"p","q":"q"}', None),
            (2, 3, "a", "find", '{"q":"late"}', None),
            (3, 5, "e", "find", '{"q": 1.50, "k": [1, {"b": null, "a": true}]}', None),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, after array<string>",
    ).withColumn("state", F.lit("extra"))
    results = spark.createDataFrame(
        [(1, 1, "a", "ok"), (1, 9, "a", "again"), (3, 4, "e", "early"), (3, 9, "lost", None), (None, 1, "a", "n")],
        "conv_id long, turn long, call_id string, content string",
    )
    got = {(r.conv_id, r.call_id): r for r in tool_calls.format_tool_calls(calls, results, tools).collect()}
    assert len(got) == 10
    shown = {k: (r.state, r.level, r.missing, list(r.errors), r.valid) for k, r in got.items()}
    assert shown[1, "a"] == ("linked", 0, 0, [], True)
    assert shown[1, "b"] == ("no_result", 1, 0, ["missing:q", "type:n"], False)
    assert shown[1, "c"] == ("no_result", 2, 0, [], False)
    assert shown[1, "x"][1] is None and shown[1, "y"][1] is None
    assert shown[1, "z"] == ("no_result", 0, 1, ["not_json"], False)
    assert shown[None, "a"] == ("linked", 0, 0, ["unknown_tool"], False)
    assert shown[2, "a"][3] == ["not_json"]
    assert shown[3, "e"] == ("early", 0, 0, ["extra:k", "type:q"], False)
    assert shown[3, "lost"][0] == "no_call"
    assert got[1, "a"].message == (
        '{"arguments":{"n":2,"q":"x"},"content":"ok","id":"a","level":0,"name":"find"}'
    )
    nothing = tool_calls.format_tool_calls(calls.limit(0), results.limit(0), tools.limit(0))
    assert nothing.count() == 0


def plain_levels(after: dict[str, list[str]]) -> dict[str, int | None]:
    """Longest ways of one conversation; None on and behind cycles."""
    needs = {c: [n for n in ns if n in after] for c, ns in after.items()}
    levels: dict[str, int] = {}
    while ready := [c for c, ns in needs.items() if c not in levels and all(n in levels for n in ns)]:
        levels.update({c: 1 + max((levels[n] for n in needs[c]), default=-1) for c in ready})
    return {c: levels.get(c) for c in after}


def test_levels_of_long_chains_and_graphs(spark, monkeypatch):
    rounds = []
    keep = tool_calls.Scratch.keep
    monkeypatch.setattr(tool_calls.Scratch, "keep", lambda self, df: rounds.append(1) or keep(self, df))
    rng = random.Random(3)
    graphs = {
        1: {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(1000)},
        None: {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(5)},
        2: {f"c{i}": [f"c{(i + 1) % 7}"] for i in range(7)} | {"t0": ["c0"], "t1": ["t0"], "m": ["t1", "e"], "e": []},
    }
    for g in range(3, 20):
        graphs[g] = {
            f"c{i}": [f"c{rng.randrange(40 if rng.random() < 0.01 else max(i, 1))}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
            for i in range(40)
        }
    rows = [(g, c, ns) for g, graph in graphs.items() for c, ns in graph.items()]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in tool_calls.call_levels(calls).collect()}
    assert got == {(g, c): v for g, graph in graphs.items() for c, v in plain_levels(graph).items()}
    assert got[1, "c999"] == 999 and len(rounds) < 60


def test_tool_tables_of_any_size_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "MAX_TOOL_BYTES", 10)
    tools = spark.createDataFrame([("find", '{"type": "object"}')], "name string, parameters string")
    calls = spark.createDataFrame([("find", "{}")], "name string, arguments string")
    with pytest.raises(ValueError):
        tool_calls.argument_errors(calls, tools)


def test_arguments_are_checked_at_any_depth(spark):
    schema = {
        "type": "object",
        "properties": {
            "unit": {"type": ["string", "null"], "enum": ["m", "km", None]},
            "n": {"enum": [1, 2.5]},
            "list": {
                "type": "array",
                "items": {"type": "object", "properties": {"x": {"type": "number"}}, "required": ["x"]},
            },
            "open": {"type": "object", "additionalProperties": {"type": "boolean"}},
            "free": {"type": "object"},
        },
    }
    cases = {
        '{"unit": "m", "n": 1.0}': [],
        '{"unit": null, "n": 2.50, "free": {"a": 1}}': [],
        '{"unit": "mile", "n": 3}': ["enum:n", "enum:unit"],
        '{"unit": 4}': ["type:unit"],
        '{"list": [{"x": 1}, {"x": 1.5}], "open": {"a": true}}': [],
        '{"list": [{"x": "1"}, {}, 7, {"x": 1, "y": 2}]}': [
            "extra:list.3.y", "missing:list.1.x", "type:list.0.x", "type:list.2",
        ],
        '{"open": {"a": 1, "b": false}, "other": 1}': ["extra:other", "type:open.a"],
        '{"open": [], "list": {}}': ["type:list", "type:open"],
        '{"anything": 1}': ["extra:anything"],
    }
    tools = spark.createDataFrame(
        [("deep", json.dumps(schema)), ("wide", '{"additionalProperties": true}')],
        "name string, parameters string",
    )
    calls = spark.createDataFrame(
        [("deep", a) for a in cases] + [("wide", '{"anything": 1}')], "name string, arguments string"
    )
    got = {(r.name, r.arguments): list(r.errors) for r in tool_calls.argument_errors(calls, tools).collect()}
    assert got == {**{("deep", a): e for a, e in cases.items()}, ("wide", '{"anything": 1}'): []}


def test_repeated_and_nameless_rows_do_not_vanish(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "f", "{}", []), (1, 0, "a", "f", "{}", []), (1, 4, "a", "g", "{}", None),
            (1, 2, None, "f", "{}", None), (None, 0, "a", "f", "{}", None), (None, 1, "a", None, None, None),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame(
        [(1, 1, "a", "x"), (1, 3, "a", None), (1, 3, "a", None), (2, 0, None, "y")],
        "conv_id long, turn long, call_id string, content string",
    )
    rest = tool_calls.unlinked_rows(calls, results)
    assert Counter((r.conv_id, r.call_id, r.turn, r.state) for r in rest.collect()) == {
        (1, "a", 0, "call_repeated"): 1,
        (1, "a", 4, "call_repeated"): 1,
        (1, None, 2, "call_no_id"): 1,
        (None, "a", 1, "call_repeated"): 1,
        (1, "a", 3, "result_repeated"): 2,
        (2, None, 0, "result_no_id"): 1,
    }


def test_only_one_json_value_counts(spark):
    good = ['{"b":1, "a":[]}', " 1 ", "null", '"x"', "[1,2]"]
    bad = ['{"a":1}]', "1}", "1,2", '1,"w":2', "", " ", "{} {}", '{"a":1,"a":2}', None]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = [r[0] for r in df.select(tool_calls.canonical_json(F.col("t"))).collect()]
    assert got == ['{"a":[],"b":1}', "1", "null", '"x"', "[1,2]"] + [None] * len(bad)


# ---------------------------------------------------------------- 4


def test_urls_meet_the_most_specific_rule(spark):
    rules = [
        ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de", "block"),
        ("org", "/fr/", "allow"), ("a.example.net", "/en/x", "block"), ("b.com", "/", "allow"), ("b.com", "/", "block"),
    ]
    hosts = ["example.net", "x.EXAMPLE.net", "notexample.net", "a.example.net", "example.com", "org", "b.com", "", "net.", ".net"]
    paths = ["", "/", "/en/", "/en/xyz", "/de", "/deutsch/1", "/fr/?a=/b", "?x://net/", "#/en/", "/EN/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "net/", "://net/", "a://b://net/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = df.select("url", url_filters.judged(spark, F.col("url"), rules).alias("v")).collect()
    for url, v in got:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", rest, re.S).groups()
        host = host.translate(LOWER)
        fits = [
            (len(h.split(".")), len(p), a == "block", h + p, a)
            for h, p, a in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        assert (v.host, v.path, v.rule, v.verdict) == (host, path, best[3], best[4]), url
    kept = url_filters.filter_urls(df, rules)
    assert kept.columns == df.columns and 0 < kept.count() < len(urls)
    with pytest.raises(ValueError):
        url_filters.judged(spark, F.col("url"), [("x" * 9_000_000, "/", "block")])


# ---------------------------------------------------------------- 5


def test_best_fit_is_tightest():
    chance = random.Random(1)
    sizes = sorted((chance.randint(1, 60) for _ in range(3000)), reverse=True)
    packer, room = sharding.Packer(100), []
    for size in sizes:
        fitting = [(r, i) for i, r in enumerate(room) if r >= size]
        expected = min(fitting)[1] if fitting else len(room)
        if not fitting:
            room.append(100)
        room[expected] -= size
        assert packer.place(size) == expected


def test_shards_are_even_whole_and_gapless(spark, docs, rows, empty):
    placed = sharding.shard_documents(docs, n_shards=4).collect()
    assert len(placed) == len(rows)
    size, shards, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in placed:
        assert r.place.size == len((r.text or "").encode()) + 1
        size[r.place.shard] += r.place.size
        shards[r.text or ""].add(r.place.shard)
        slots[r.place.shard].append(r.place.slot)
    groups = Counter()
    for _, text, *_ in rows:
        groups[text or ""] += len((text or "").encode()) + 1
    assert max(size.values()) <= max(max(groups.values()), sum(size.values()) / 4 * 1.01)
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, n_shards=4).count() == 0
    capacity = max(groups.values())
    full = Counter()
    for r in sharding.shard_documents(docs, capacity=capacity).collect():
        full[r.place.shard] += r.place.size
    assert max(full.values()) <= capacity and len(full) <= 2 * sum(full.values()) / capacity + 1


# ---------------------------------------------------------------- 6


def test_mix_meets_its_targets(spark, docs, rows, empty):
    planned = mixing.plan_mix(docs).collect()
    assert len(planned) == len(rows)
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len(words_of(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = dict(zip(order, [5, 2, 1] * len(order), strict=False))
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        level = left / sum(weights[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weights[s] * level > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in planned:
        target = 2 * sizes[r.source] if r.source in capped else weights[r.source] * level
        assert r.mix.size == len(words_of(r.text)) and r.mix.source_size == sizes[r.source]
        assert r.mix.target == pytest.approx(target)
        assert 0 <= r.mix.taken <= 2 * r.mix.size
        taken[r.source] += r.mix.taken
    for r in planned:
        assert abs(taken[r.source] - r.mix.target) <= 0.01 * r.mix.target + 3
    again = mixing.plan_mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.mix.taken) for r in planned) == Counter((r.doc_id, r.mix.taken) for r in again)
    mixed = mixing.mix_sources(docs, shards=3)
    assert mixed.columns == [*docs.columns, "mix_shard"]
    made = mixed.collect()
    assert sum(len(words_of(r.text)) for r in made) == sum(taken.values())
    assert {r.mix_shard for r in made} == {0, 1, 2}
    assert mixing.plan_mix(empty).count() == 0
    assert mixing.plan_mix(docs.where("text is null")).where("mix.taken != 0").count() == 0


def test_mix_takes_small_sources_beside_a_huge_one(spark):
    chance = random.Random(3)
    table = [(i, "w " * 900, "huge") for i in range(2000)]
    for k in range(300):
        source = f"tiny{k:03}"
        table += [
            (10_000 + 10 * k + j, " ".join(["x"] * n), source)
            for j, n in enumerate(chance.choices(range(1, 40), k=chance.randint(1, 4)))
        ]
    small = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(5)
    weights = lambda sources: sources.withColumn("weight", F.lit(1).cast("long"))
    for percent in (150, 60):
        taken, target = Counter(), {}
        for r in mixing.plan_mix(small, weights, percent=percent).collect():
            assert 0 <= r.mix.taken <= 2 * r.mix.size
            taken[r.source] += r.mix.taken
            target[r.source] = r.mix.target
        for source, words in target.items():
            assert words > 0
            assert abs(taken[source] - words) <= (0.01 * words if source == "huge" else 1), source
        tiny = [s for s in target if s != "huge"]
        assert abs(sum(taken[s] - target[s] for s in tiny)) <= 1
    mixed = mixing.mix_sources(small, weights=weights, percent=60, shards=4).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(taken.values())
    shards = Counter(r.mix_shard for r in mixed if r.source != "huge")
    assert set(shards) == {0, 1, 2, 3} and 2 * min(shards.values()) > max(shards.values())


# ---------------------------------------------------------------- 7


def plain_components(table):
    sets = {}
    for doc_id, text, *_ in table:
        words = words_of(text, lower=True)
        if doc_id is not None:
            sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            one, two = sets[a], sets[b]
            if one and two and 100 * len(one & two) >= 75 * len(one | two):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_texts_of_one_id_are_apart(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(120)) for c in "ab")
    table = [(0, one + " end"), (1, one), (1, two), (2, two + " end"), (3, "alone")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = near_dedup.find_near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [
        (0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False), (3, 3, True),
    ]
    kept = sorted((r.doc_id, r.text) for r in near_dedup.keep_one_each(df).collect())
    assert kept == [(0, one + " end"), (1, two), (3, "alone")]


def test_rows_without_ids_are_linked_by_their_texts(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(120)) for c in "abc")
    table = [(None, one)] * 3 + [(None, one + " end"), (None, two), (7, two + " x"), (8, two)]
    table += [(None, three), (None, ""), (None, None), (None, ""), (9, None), (9, None)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in near_dedup.find_near_duplicates(df).collect()]
    assert Counter(got) == Counter(
        {(None, None): 8, (None, 7): 1, (7, 7): 1, (8, 7): 1, (9, 9): 2}
    )
    kept = Counter((r.doc_id, (r.text or "")[:2]) for r in near_dedup.keep_one_each(df).collect())
    assert kept == {(None, "a0"): 1, (7, "b0"): 1, (None, "c0"): 1, (None, ""): 3, (9, ""): 1}


def test_all_links_near_the_threshold_are_found(spark):
    """Recall on some thousand documents in groups whose similarities lie around 0.75."""
    chance = random.Random(11)
    table = []
    for group in range(60):
        base = [f"g{group % 50}w{chance.randrange(900)}" for _ in range(chance.randint(60, 160))]
        for _ in range(chance.choice([3, 20, 60])):
            words = list(base)
            for _ in range(chance.randint(0, len(base) // 24)):
                words[chance.randrange(len(words))] = f"r{chance.randrange(10**6)}"
            table.append((len(table), " ".join(words)))
    expected = {}
    for group in range(50):
        members = [(i, t) for i, t in table if t.find(f"g{group}w") >= 0]
        expected |= plain_components(members)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find_near_duplicates(df).collect()}
    assert len(table) > 1000 and len({c for _, c in expected.values()}) > 200
    assert got == expected


@pytest.mark.parametrize(("block", "row_cost"), [(512, 256), (2, 0), (2, 10**9), (512, -(10**9))])
def test_near_duplicates(spark, docs, rows, empty, monkeypatch, block, row_cost):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "ROW_COST", row_cost)
    expected = plain_components(rows)
    got = near_dedup.find_near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == expected[31][1] and not r.kept
        else:
            n, component = expected[r.doc_id]
            assert (r.n_shingles, r.component_id, r.kept) == (n, component, component == r.doc_id)
    if row_cost == 256:
        kept = near_dedup.keep_one_each(docs)
        assert kept.columns == docs.columns
        ids = sorted(r.doc_id for r in kept.collect())
        assert ids == sorted({c for _, c in expected.values()})
        assert near_dedup.find_near_duplicates(empty).count() == 0


def test_odd_sketch_estimates_similarity():
    chance = np.random.default_rng(1)
    for share in (0.6, 0.75, 0.9):
        pool = chance.integers(0, 1 << 62, 4000, dtype=np.uint64)
        both = int(share * 2000)
        one, two = pool[:2000], np.concatenate((pool[:both], pool[2000 : 4000 - both]))
        sketches = [near_dedup.odd_sketch(near_dedup.min_hashes(np.unique(s))) for s in (one, two)]
        bits = np.bitwise_count((sketches[0] ^ sketches[1]).view(np.uint64)).sum()
        size, k = near_dedup.SKETCH_BITS, near_dedup.SAMPLES
        estimate = 1 + size / 4 / k * np.log(1 - 2 * bits / size)
        assert estimate == pytest.approx(both / (4000 - both), abs=0.12)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(map(tuple, near_dedup.components(df).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


# ---------------------------------------------------------------- 8


def test_line_measures(spark, docs, rows, empty):
    measured = line_quality.measure_lines(docs)
    assert measured.count() == len(rows)
    for r in measured.select("doc_id", "text", "quality").collect():
        words, q = words_of(r.text), r.quality
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {
            i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)
        }
        lines = [x for x in (r.text or "").split("\n") if words_of(x)]
        assert q.n_words == len(words) and q.n_repeat_words == len(covered)
        assert q.word_chars == sum(map(len, words)) and q.n_dup_lines == len(lines) - len(set(lines))
        assert q.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
    assert line_quality.clean_lines(docs).columns == docs.columns
    assert line_quality.measure_lines(empty).count() == 0


def test_prose_of_other_scripts_and_mentions_of_phrases_stay(spark):
    ends = {"hindi": "।", "arabic": "؟", "urdu": "۔", "chinese": "。", "amharic": "።"}
    words = [f"{a}{b}" for a in "कखगघचछ" for b in "टठडढणतथ"]
    mention = " ".join(f"word{i}" for i in range(30)) + " as our privacy policy says here."
    table = [(name, " ".join(words) + end) for name, end in ends.items()]
    table += [("mention", mention), ("endless", " ".join(words)), ("short", "Read our privacy policy")]
    df = spark.createDataFrame(table, "doc_id string, text string")
    got = {r.doc_id: (r.quality.n_failed_lines, r.quality.kept) for r in line_quality.measure_lines(df).collect()}
    assert {k: v for k, v in got.items() if k not in ("endless", "short")} == {
        name: (0, True) for name in [*ends, "mention"]
    }
    assert got["endless"] == (1, False) and got["short"][0] == 1


def test_lines_that_fail(spark):
    prose = "These are plain words of a sentence that ends well. " * 3
    bad = [
        "home | news | sport | about",
        "All rights reserved, whatever that means here.",
        "words*** with### many&&& signs$$$ in%%% them***",
        "THIS!! IS!! LOUD!! TEXT!!",
        "word " * 30,
    ]
    table = [(i, f"{prose}\n{line}\n\n{prose.strip()}x") for i, line in enumerate(bad)]
    table += [(10, "\n".join(bad[:2] * 3)), (11, prose + "\n" + prose.upper())]
    df = spark.createDataFrame(table, "doc_id long, text string")
    cleaned = {r.doc_id: r.text for r in line_quality.clean_lines(df).collect()}
    for i in range(len(bad)):
        assert cleaned.get(i, "gone") in (f"{prose}\n\n{prose.strip()}x", "gone")
    measured = {r.doc_id: r.quality for r in line_quality.measure_lines(df).collect()}
    assert all(measured[i].n_failed_lines == 1 for i in range(len(bad)))
    assert measured[10].n_failed_lines == 6 and not measured[10].kept
    assert measured[11].n_failed_lines == 0


# ---------------------------------------------------------------- 9


@pytest.mark.parametrize("most", [1_000, 1])
def test_repeated_windows(spark, docs, rows, empty, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "SHARD_EXTENTS", most)
    if most == 1_000:
        monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 300)
    windows = Counter()
    for _, text, *_ in rows:
        words = words_of(text)
        windows.update(tuple(words[i : i + 35]) for i in range(len(words) - 34))
    got = substring_dedup.find_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        words = words_of(r.text)
        gone = {
            i + k for i in range(len(words) - 34) if windows[tuple(words[i : i + 35])] > 1 for k in range(35)
        }
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (r.repeats.n_words, r.repeats.n_removed) == (len(words), len(gone))
        assert r.repeats.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    if most == 1:
        cleaned = substring_dedup.remove_repeats(docs)
        assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
        assert substring_dedup.find_repeats(empty).count() == 0


def test_suffix_automaton_counts():
    chance = random.Random(2)
    texts = [[chance.choice([b"a", b"b", b"c"]) for _ in range(chance.randint(3, 30))] for _ in range(20)]
    times = [chance.randint(1, 2) for _ in texts]
    automaton = substring_dedup.SuffixAutomaton()
    for text, n in zip(texts, times, strict=True):
        automaton.add(text, n)
    automaton.finish()
    count = Counter()
    for text, n in zip(texts, times, strict=True):
        for i in range(len(text) - 3):
            count[tuple(text[i : i + 4])] += n
    for text in texts:
        expected = sum(1 << i for i in range(len(text) - 3) if count[tuple(text[i : i + 4])] > 1)
        assert automaton.repeats(text, 4) == expected


# ---------------------------------------------------------------- 10


def test_classifier_learns_and_never_sees_held_out_rows(spark, empty):
    chance = random.Random(4)
    table, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = [f"word{chance.randint(0, 80)}" for _ in range(chance.randint(5, 60))]
        text = " ".join(words) + "." if good else " | ".join(words)
        table.append((i, text))
        labels.append((i, int(good)))
    table += [(None, None), (500, ""), (501, "x" * 300_000), table[3]]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumn("label", F.lit(9))
    marks = spark.createDataFrame([*labels, (None, 1), (1000, None)], "doc_id long, quality int")
    forest = classifier.fit_quality(docs, marks)
    scored = classifier.quality_score(docs, forest)
    assert scored.columns == [*docs.columns, "score"]
    got = scored.withColumn("held", classifier.held_out(F.col("doc_id"))).collect()
    truth = dict(labels)
    tested = [(r.score >= 0.7) == bool(truth[r.doc_id]) for r in got if r.held and r.doc_id in truth]
    assert len(tested) > 50 and sum(tested) / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    # Turning the held-out labels round changes nothing.
    turned = marks.withColumn(
        "quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    assert np.array_equal(classifier.fit_quality(docs, turned).value, forest.value)
    nothing = classifier.fit_quality(docs, marks.limit(0))
    assert {r.score for r in classifier.quality_score(docs, nothing).collect()} == {0.5}
    assert classifier.quality_score(empty, forest).count() == 0


# ---------------------------------------------------------------- contract


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not here")
def test_pipeline_runs_to_shards(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:1]:
        assert stage(spark, docs, FOLDER).columns == names
    made = corpus_pipeline.run(spark, FOLDER)
    assert made.columns == [*names, "size", "shard", "slot"]
    assert made.select("shard").distinct().count() == 8
