import numpy as np
import pytest
from pyspark.sql import functions as F

from passagedex.functions.encoders import HashedWords, masked_mean, pooled
from passagedex.operators import embedding, neighbours
from passagedex.operators.embedding import embed, mean_pool
from passagedex.operators.neighbours import Cells, Sizes, nearest
from passagedex.plans.dense import build_vector_index, open_vector_index, save_vectors
from passagedex.plans.lexical import build_index, open_index
from passagedex.schemas import PASSAGE


def table(spark, matrix, name):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>")


def brute(vectors, queries, k):
    vectors, queries = vectors.astype("float64"), queries.astype("float64")
    found = {}
    for number, query in enumerate(queries):
        gaps = ((vectors - query) ** 2).sum(axis=1)
        order = sorted(range(len(vectors)), key=lambda i: (gaps[i], i))[:k]
        found[number] = [(i, gaps[i]) for i in order]
    return found


def collected(df):
    found = {}
    for row in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(row["query_id"], []).append((row["doc_key"], row["distance"]))
    return found


@pytest.fixture(scope="module")
def matrices():
    dice = np.random.default_rng(5)
    vectors = dice.normal(size=(700, 12)).astype("float32")
    vectors[100:400] = vectors[7]
    queries = np.vstack([vectors[:300:9], dice.normal(size=(5, 12))]).astype("float32")
    return vectors, queries


def same(got, want):
    assert got.keys() == want.keys()
    for query, rows in want.items():
        assert [key for key, _ in got[query]] == [key for key, _ in rows]
        assert [d for _, d in got[query]] == pytest.approx([d for _, d in rows], abs=1e-9)


def test_nearest_equals_brute_force_with_many_copies(spark, matrices):
    vectors, queries = matrices
    found = nearest(
        table(spark, vectors, "doc_key").repartition(5), table(spark, queries, "query_id"), 6
    )
    same(collected(found), brute(vectors, queries, 6))


SMALL = Sizes(broadcast=0, block=12 * 4 * 10, slice=12 * 4 * 60)


def test_blocks_equal_brute_force(spark, matrices, monkeypatch):
    vectors, queries = matrices
    monkeypatch.setattr(neighbours, "QUERY_CHUNK", 7)
    for k in (1, 6, 800):
        found = nearest(table(spark, vectors, "doc_key"), table(spark, queries, "query_id"), k, SMALL)
        same(collected(found), brute(vectors, queries, k))


def test_far_cells_are_skipped(spark):
    dice = np.random.default_rng(11)
    centres = dice.normal(size=(6, 12)) * 50
    vectors = np.vstack([c + dice.normal(size=(80, 12)) for c in centres]).astype("float32")
    queries = (vectors[::16] + dice.normal(size=(30, 12)) * 0.1).astype("float32")
    rows, asked = table(spark, vectors, "doc_key"), table(spark, queries, "query_id")
    cells = Cells(rows, 12, SMALL)
    assert len(cells.cells) > 1 and cells.slices.sum() >= 8
    everywhere = len(queries) * int(cells.slices.sum())
    want = brute(vectors, queries, 4)
    ceilings = spark.createDataFrame(
        [(q, float(found[-1][1])) for q, found in want.items()], "query_id bigint, ceiling double"
    )
    sent = cells._sent(asked.join(ceilings, "query_id")).count()
    assert len(queries) <= sent < everywhere / 2
    same(collected(nearest(rows, asked, 4, SMALL)), want)


def test_cells_of_equal_vectors_and_no_vectors(spark):
    vectors = np.ones((300, 12), dtype="float32")
    queries = np.vstack([vectors[:3], vectors[:2] * 5])
    rows, asked = table(spark, vectors, "doc_key"), table(spark, queries, "query_id")
    cells = Cells(rows, 12, SMALL)
    assert cells.slices.max() >= 5
    same(collected(nearest(rows, asked, 3, SMALL)), brute(vectors, queries, 3))
    assert nearest(rows.limit(0), asked, 3, SMALL).count() == 0


def test_queries_with_many_slices_to_meet_are_not_copied_to_them(spark, matrices, monkeypatch):
    vectors, queries = matrices
    rows = table(spark, vectors, "doc_key").withColumn(
        "doc_key", F.concat(F.lit("v"), F.lpad(F.col("doc_key").cast("string"), 4, "0"))
    )
    asked = table(spark, np.vstack([queries, vectors[400:]]), "query_id").repartition(3)
    monkeypatch.setattr(neighbours, "PACK", 12 * 4 * 16)
    monkeypatch.setattr(neighbours, "HELD", 12 * 4 * 40)
    sent, send = [], Cells._sent

    def noted(self, queries):
        found = send(self, queries)
        sent.append(found.count())
        return found

    monkeypatch.setattr(Cells, "_sent", noted)
    found = collected(nearest(rows, asked, 6, SMALL))
    want = brute(vectors, np.vstack([queries, vectors[400:]]), 6)
    same(found, {q: [(f"v{key:04}", d) for key, d in best] for q, best in want.items()})
    assert Cells(rows, 12, SMALL).slices.sum() >= 12
    assert sum(sent) <= (1 + neighbours.FEW_SLICES) * len(want)


def test_queries_of_few_and_of_many_slices_and_repeated_ids(spark, monkeypatch):
    dice = np.random.default_rng(3)
    centres = dice.normal(size=(9, 12)) * 50
    vectors = np.vstack([c + dice.normal(size=(50, 12)) for c in centres]).astype("float32")
    queries = np.vstack([vectors[::9], dice.normal(size=(20, 12)) * 500]).astype("float32")
    rows, asked = table(spark, vectors, "doc_key"), table(spark, queries, "query_id")
    monkeypatch.setattr(neighbours, "PACK", 12 * 4 * 16)
    monkeypatch.setattr(neighbours, "FEW_SLICES", 2)
    streamed, stream = [], Cells._streamed

    def noted(self, faced, n, k, schema):
        streamed.append(n)
        return stream(self, faced, n, k, schema)

    monkeypatch.setattr(Cells, "_streamed", noted)
    same(collected(nearest(rows, asked, 4, SMALL)), brute(vectors, queries, 4))
    assert len(streamed) == 1 and 0 < streamed[0] < len(queries)
    twice = collected(nearest(rows, asked.union(asked), 4, SMALL))
    for query, best in brute(vectors, queries, 4).items():
        want = [best[0], best[0], best[1], best[1]]
        assert [key for key, _ in twice[query]] == [key for key, _ in want]


def test_packs_hold_every_row_once_and_few_bytes(spark, matrices, monkeypatch):
    vectors = matrices[0]
    monkeypatch.setattr(neighbours, "PACK", 12 * 4 * 16)
    cells = Cells(table(spark, vectors, "doc_key").repartition(3), 12, SMALL)
    places = {r["doc_key"]: r["cell"] for r in cells.placed.select("doc_key", "cell").collect()}
    packs = cells._packed_vectors().collect()
    assert sorted(key for p in packs for key in p["keys"]) == list(range(len(vectors)))
    assert len({p["pack"] for p in packs}) == len(packs)
    for pack in packs:
        assert len(pack["keys"]) <= 16
        assert sorted(pack["cells"]) == sorted({places[key] for key in pack["keys"]})
        kept = np.frombuffer(pack["vectors"], "f4").reshape(-1, 12)
        assert (kept == vectors[pack["keys"]]).all()


def test_k_beyond_the_vectors(spark, matrices):
    vectors, queries = matrices[0][:4], matrices[1][:3]
    found = nearest(table(spark, vectors, "doc_key"), table(spark, queries, "query_id"), 50)
    same(collected(found), brute(vectors, queries, 50))
    with pytest.raises(ValueError):
        nearest(table(spark, vectors, "doc_key"), table(spark, queries, "query_id"), 0)


def test_embedding_does_not_depend_on_batches(spark):
    texts = [f"word{i % 7} other{i}" for i in range(150)] + ["", "Upper upper"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    whole = {r["id"]: r["embedding"] for r in embed(df, "id", "text", HashedWords).collect()}
    pieces = embed(df.repartition(6), "id", "text", HashedWords, batch_size=3).collect()
    assert {r["id"]: r["embedding"] for r in pieces} == whole
    want = HashedWords()(texts).astype("float32")
    assert np.array_equal(np.array([whole[i] for i in range(len(texts))], dtype="float32"), want)


def test_masked_mean_ignores_padding():
    hidden = np.array([[[1.0, 3.0], [3.0, 5.0], [99.0, 99.0]]])
    assert masked_mean(hidden, np.array([[1, 1, 0]])).tolist() == [[2.0, 4.0]]


def test_mean_pool(spark, matrices):
    vectors = matrices[0][:60]
    rows = [(i % 3, [float(x) for x in row]) for i, row in enumerate(vectors)]
    df = spark.createDataFrame(rows, "label int, embedding array<float>")
    for row in mean_pool(df, "label").collect():
        want = vectors[row["label"] :: 3].astype("float64").mean(axis=0)
        assert row["embedding"] == pytest.approx(list(want))


def test_text_to_formatted_hits(spark, tmp_path):
    rows = [
        ("a#0", "1", "title", "red fox", None),
        ("a#1", "1", "paragraph", "the red fox runs", "red fox"),
        ("b#0", "2", "title", "blue whale", None),
    ]
    schema = "doc_key string, id string, type string, text string, title string"
    path = str(tmp_path / "v")
    build_vector_index(spark, spark.createDataFrame(rows, schema), path, HashedWords)
    index = open_vector_index(spark, path, HashedWords)
    assert (index.dimension, index.n_vectors) == (32, 3)
    queries = spark.createDataFrame([("q", "The red FOX runs")], "query_id string, text string")
    best = index.retrieve(queries, 1).first()
    assert best["result"] == "Title: red fox\nContent: the red fox runs"
    assert best["distance"] == pytest.approx(0.0)
    with pytest.raises(FileNotFoundError):
        open_vector_index(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("kind", ["lexical", "dense"])
def test_both_indexes_answer_by_the_same_verbs(spark, tmp_path, kind):
    texts = [("title", "red fox", None), ("paragraph", "the red fox runs", "red fox")]
    texts += [("title", f"blue whale {i}", None) for i in range(5)]
    rows = [(f"k{i}", "f", str(i), 0, *text) for i, text in enumerate(texts)]
    passages = spark.createDataFrame(rows, PASSAGE)
    path = str(tmp_path / kind)
    if kind == "lexical":
        build_index(spark, passages, path, n_shards=2)
        index = open_index(spark, path)
    else:
        build_vector_index(spark, passages, path, HashedWords)
        index = open_vector_index(spark, path, HashedWords)
    assert index.document_count() == 7
    asked = spark.createDataFrame(
        [(1, "The red FOX runs"), (2, "blue whale 3")], "query_id int, text string"
    )
    found = {(r["query_id"], r["rank"]): r["result"] for r in index.retrieve(asked, 2).collect()}
    assert len(found) == 4
    assert found[1, 1] == "Title: red fox\nContent: the red fox runs"
    assert found[2, 1] == "Title: blue whale 3"
    for query in ("blue whale 3", ["blue", "whale", "3"]):
        hits = index.retrieve_one(query, 1).collect()
        assert [(h["query_id"], h["rank"], h["result"]) for h in hits] == [
            ("q", 1, "Title: blue whale 3")
        ]


def test_texts_need_an_encoder(spark, tmp_path):
    vectors = spark.createDataFrame([("a", [1.0])], "doc_key string, embedding array<float>")
    records = vectors.selectExpr("doc_key", "'1' id", "'title' type", "'a' text", "'' title")
    index = save_vectors(vectors, records, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="encoder"):
        index.retrieve_one("a")


def test_ragged_vectors_are_refused(spark, tmp_path):
    schema = "doc_key string, embedding array<float>, id string, type string, text string, title string"
    rows = [("a", [1.0], "1", "title", "a", None), ("b", [1.0, 2.0], "2", "title", "b", None)]
    df = spark.createDataFrame(rows, schema)
    with pytest.raises(ValueError):
        save_vectors(df, df, str(tmp_path / "v"))


def letters_model():
    """A model of tokens whose vectors are (letter, 1); it pads with nonsense and cuts nothing."""

    def tokens_of(texts, max_tokens):
        width = max(map(len, texts), default=0) + 2
        hidden, mask = np.full((len(texts), width, 2), 99.0), np.zeros((len(texts), width), dtype=int)
        for row, text in enumerate(texts):
            mask[row, : len(text)] = 1
            hidden[row, : len(text)] = [(ord(c), 1.0) for c in text] or np.empty((0, 2))
        return hidden, mask

    return tokens_of


def test_pooled_vectors_are_cut_and_do_not_depend_on_batches(spark):
    texts = ["", "a", "abcdef" * 3, "zz", "abc", "b" * 50] * 7
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for batch_size in (1, 3, 64):
        made = embed(df, "id", "text", pooled(letters_model, 4), batch_size=batch_size).collect()
        assert len(made) == len(texts)
        for row in made:
            codes = [ord(c) for c in texts[row["id"]][:4]]
            want = [sum(codes) / len(codes), 1.0] if codes else [0.0, 0.0]
            assert row["embedding"] == pytest.approx(want)
    with pytest.raises(ValueError, match="max_tokens"):
        pooled(letters_model, 0)


def test_texts_are_taken_from_a_batch_in_parts(spark, monkeypatch):
    texts = [f"word{i} again" for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    whole = {r["id"]: r["embedding"] for r in embed(df, "id", "text", HashedWords).collect()}
    monkeypatch.setattr(embedding, "ROWS_AT_ONCE", 7)
    parts = embed(df, "id", "text", HashedWords)
    assert {r["id"]: r["embedding"] for r in parts.collect()} == whole

    def at_most_seven():
        def encode(texts):
            assert len(texts) <= 7
            return np.ones((len(texts), 1))

        return encode

    assert embed(df, "id", "text", at_most_seven).count() == 50


def test_few_word_vectors_are_remembered(monkeypatch):
    monkeypatch.setattr(HashedWords, "most_known", 3)
    words = HashedWords()
    texts = [f"w{i} w{i + 1}" for i in range(9)]
    assert (words(texts) == HashedWords()(texts)).all()
    assert len(words._known) == 3
