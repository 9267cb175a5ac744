"""Encoding and decoding against the tokenizer library."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passagedex.llm import bpe

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    chance = random.Random(3)
    ranges = [(0, 0x2FF), (0x300, 0x370), (0x600, 0x1200), (0x2000, 0x2100), (0xAC00, 0xD7A0)]
    ranges += [(0x1F300, 0x1F700), (32, 32), (32, 32), (97, 122), (97, 122)]
    made = ["", None, " \t\n", "aaaaaaa aaa AAAA 123", "x" * 5000, "ab" * 3000, "<|endoftext|"]
    made += ["it's <|endoftext|>x<|startoftext|> I'LL we've", "<|endoftext|>́<|endoftext|>"]
    made += [" ́a b\u0085c\x1cd e　f İΣΑΣ ﬁ ẞ ǅ", "हिन्दी। 日本語 각 👍🏽 ﻿a​b", "A" * 70 + " " + "A" * 70]
    for _ in range(300):
        picked = (chance.choice(ranges) for _ in range(chance.randint(0, 60)))
        made.append("".join(chr(chance.randint(*r)) for r in picked))
    words = [f"Word{i}" for i in range(900)]
    made.append(" ".join(chance.choice(words) for _ in range(20_000)))
    return made + made[3:9]


def expected(library, made):
    encoded = library.encode_batch([t or "" for t in made], add_special_tokens=False)
    return [e.ids for e in encoded]


@pytest.mark.parametrize(("remembered", "chunk"), [(200_000, 1 << 20), (5, 64), (0, 1)])
def test_ids_equal_the_librarys(library, monkeypatch, remembered, chunk):
    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", chunk)
    made = texts()[:-7] if chunk < 100 else texts()
    encoder = bpe.Encoder(bpe.checked_vocabulary(PATH))
    got = [np.frombuffer(p, "<u4").tolist() for p in encoder.encode(made)]
    assert got == expected(library, made)


def test_one_merge_a_round_gives_the_same(library):
    made = texts()
    encoder = bpe.Encoder(bpe.checked_vocabulary(PATH))
    assert encoder._merger.ordered
    encoder._merger.ordered = False
    got = [np.frombuffer(p, "<u4").tolist() for p in encoder.encode(made)]
    assert got == expected(library, made)


def test_columns_on_spark(spark, library):
    made = texts()
    rows = [(i, t, 1) for i, t in enumerate(made)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    packed = docs.select("doc_id", bpe.packed_ids(spark, F.col("text"), PATH).alias("p"))
    both = packed.select("doc_id", "p", bpe.decoded(spark, F.col("p"), PATH).alias("t"))
    arrays = docs.select("doc_id", bpe.token_ids(spark, F.col("text"), PATH).alias("a"))
    got = {r["doc_id"]: r for r in both.collect()}
    lists = {r["doc_id"]: r["a"] for r in arrays.collect()}
    for i, ids in enumerate(expected(library, made)):
        assert np.frombuffer(bytes(got[i]["p"]), "<u4").tolist() == ids == lists[i]
        assert got[i]["t"] == library.decode(ids, skip_special_tokens=False)
    one_pass = docs.select("doc_id", bpe.round_trip(spark, F.col("text"), PATH).alias("c"))
    for r in one_pass.collect():
        assert (r["c"]["ids"], r["c"]["text"]) == (got[r["doc_id"]]["p"], got[r["doc_id"]]["t"])
    assert docs.limit(0).select(bpe.packed_ids(spark, F.col("text"), PATH)).collect() == []


def test_decoding_skips_ids_outside_the_vocabulary(library):
    decoder = bpe.Decoder(bpe.checked_vocabulary(PATH))
    ids = [320, 10**6, 49406, 49407, 2**32 - 1]
    packed = np.array(ids, dtype="<u4").tobytes()
    assert decoder.decode(packed) == library.decode([320, 49406, 49407], skip_special_tokens=False)
    assert decoder.decode(None) == decoder.decode(b"") == ""


def test_other_vocabularies_are_refused(tmp_path):
    parts = json.loads(open(PATH, encoding="utf-8").read())
    parts["model"]["dropout"] = 0.1
    path = tmp_path / "v.json"
    path.write_text(json.dumps(parts))
    with pytest.raises(ValueError, match="vocabulary"):
        bpe.checked_vocabulary(str(path))


def test_a_pair_that_arises_below_its_own_rank_is_merged_one_at_a_time():
    vocabulary = {c: i for i, c in enumerate(["a", "b", "a</w>", "b</w>", "ab", "aab", "abb</w>"])}
    merges = [["a", "ab"], ["a", "b"], ["ab", "b</w>"]]
    merger = bpe.Merger({"vocab": vocabulary, "merges": merges, "end_of_word_suffix": "</w>"})
    assert not merger.ordered
    assert np.frombuffer(merger.merge([b"aabb"])[0], "<u4").tolist() == [5, 3]
