from passagedex.operators import passages as P
from tests import plain

ARTICLES = [
    {"id": "1", "title": "Anchors", "text": [['see <a href="X%20Y">x y</a>', "end"]]},
    {"id": "2", "title": "Upper", "text": [['<A HREF="Q">z</A>']]},
    {"id": "3", "title": "Blank", "text": [[], ["  "], ["a"], [""]]},
    {"id": "4", "title": "", "text": []},
    {"id": "5", "title": 'A  <a href="B">b</a>', "text": [["x y　z\u001cw"], None]},
    {"id": "6", "title": "İSTANBUL ΣΣ", "text": [["İI", "ΣΣ Σ"]]},
]
SCHEMA = "rel_path string, id string, title string, text array<array<string>>"


def articles(spark):
    rows = [("f", a["id"], a["title"], a["text"]) for a in ARTICLES]
    return spark.createDataFrame(rows, SCHEMA)


def as_tuples(df):
    fields = ("id", "passage_pos", "type", "text", "title")
    return sorted(tuple(row[f] for f in fields) for row in df.collect())


def test_flatten_follows_the_definition(spark):
    want = sorted((a["id"], *row) for a in ARTICLES for row in plain.passages(a))
    assert as_tuples(P.flatten_articles(articles(spark))) == want


def test_titles_and_paragraphs_make_up_the_whole(spark):
    rows = articles(spark)
    parts = P.title_rows(rows).unionByName(P.paragraph_rows(rows))
    assert as_tuples(parts) == as_tuples(P.flatten_articles(rows))


def test_keys_are_distinct_for_repeated_ids(spark):
    rows = [("f", "1", "t", [["a"]], 0), ("f", "1", "t", [["a"]], 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", row_no bigint")
    keys = [r["doc_key"] for r in P.flatten_articles(df).collect()]
    assert len(set(keys)) == 4


def test_passages_per_file_has_a_total(spark):
    rows = [("a", "1", "t", [["x"], ["y"]]), ("b", "2", "t", [])]
    df = P.passages_per_file(P.flatten_articles(spark.createDataFrame(rows, SCHEMA)))
    assert {r["rel_path"]: r["n_passages"] for r in df.collect()} == {"a": 3, "b": 1, None: 4}


def test_flatten_needs_one_scan_and_no_shuffle(spark, tmp_path):
    articles(spark).write.parquet(str(tmp_path / "a"))
    plan = P.flatten_articles(spark.read.parquet(str(tmp_path / "a")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Exchange" not in text
