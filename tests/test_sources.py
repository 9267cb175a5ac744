import bz2
import json

import pytest

from passagedex.operators.passages import flatten_articles
from passagedex.sources import articles as A

GOOD = {"id": 2, "title": "Two", "text": [["a", "b"]], "more": {"x": 1}}


def write_lines(folder, name, lines):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(bz2.compress("\n".join(lines).encode()))


def saved(spark, rows, tmp_path):
    A.save_articles(rows, str(tmp_path / "saved"))
    return A.load_articles(spark, str(tmp_path / "saved"))


def test_lines_bad_records_are_set_aside(spark, tmp_path):
    source = tmp_path / "in"
    lines = [
        json.dumps(GOOD),
        "not json",
        "",
        json.dumps({"id": "3", "text": []}),
        json.dumps({"id": "4", "title": "Bare", "text": ["abc"]}),
        json.dumps({"id": "5", "title": "Null", "text": [["a", None]]}),
        json.dumps({"id": "6", "title": "Six", "text": []}),
    ]
    write_lines(source, "AA/wiki 00+1.bz2", lines)
    write_lines(source, "wiki_01.json.bz2", [json.dumps({**GOOD, "id": "x"})])
    (source / "notes.txt").write_text("ignored")
    rows = saved(spark, A.read_article_lines(spark, str(source)), tmp_path)
    good = {(r["rel_path"], r["rel_dir"], r["id"]) for r in A.usable(rows).collect()}
    assert good == {
        ("AA/wiki 00+1.bz2", "AA", "2"),
        ("AA/wiki 00+1.bz2", "AA", "6"),
        ("wiki_01.json.bz2", "", "x"),
    }
    bad = A.quarantined(rows).collect()
    assert len(bad) == 4
    assert {r["_corrupt_record"] for r in bad if r["id"] is None} >= {"not json"}


def test_arrays_and_a_broken_file(spark, tmp_path):
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    (source / "sub/a.json").write_text(json.dumps([GOOD, {**GOOD, "id": "9"}], indent=2))
    (source / "broken.json").write_text('[{"id": "1", "title": "T", "text": []},')
    rows = saved(spark, A.read_article_arrays(spark, str(source)), tmp_path)
    assert {(r["rel_path"], r["id"]) for r in A.usable(rows).collect()} == {
        ("sub/a.json", "2"),
        ("sub/a.json", "9"),
    }
    assert [r["rel_path"] for r in A.quarantined(rows).collect()] == ["broken.json"]


def by_file(rows):
    found = [(r["rel_path"], r["rel_dir"], r["id"], r["title"], r["text"]) for r in rows.collect()]
    return sorted(found, key=str)


def test_indented_arrays_are_read_in_splits(spark, tmp_path):
    source = tmp_path / "in" / "a dir"
    source.mkdir(parents=True)
    tricky = ["\n  {", "\n  }", "},{ ]", "  ü", "", "\\"]
    many = [
        {"id": str(i), "title": tricky[i % 6] * 3, "text": [[tricky[i % 5], "x" * (i % 90)]], "more": [{}]}
        for i in range(900)
    ]
    (source / "big.json").write_text(json.dumps(many, indent=2))
    (source / "one.json").write_text(json.dumps(many[:1], indent=2, ensure_ascii=False) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = A.read_article_arrays(spark, str(tmp_path / "in"))
        assert rows.rdd.getNumPartitions() > 10
        want = [("a dir/big.json", "a dir", m["id"], m["title"], m["text"]) for m in many]
        want.append(("a dir/one.json", "a dir", "0", many[0]["title"], many[0]["text"]))
        assert by_file(rows) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_irregular_arrays_are_read_whole(spark, tmp_path):
    two = [GOOD, {**GOOD, "id": "9"}]
    indented = json.dumps(two, indent=2)
    files = {
        "good.json": indented,
        "compact.json": json.dumps(two),
        "four.json": json.dumps(two, indent=4),
        "empty.json": "[]",
        "nothing.json": "",
        "cut.json": indented[: len(indented) // 2],
        "unclosed.json": indented[:-1],
        "number.json": json.dumps([*two, 5], indent=2),
        "shape.json": json.dumps([GOOD, {**GOOD, "text": "flat"}], indent=2),
        "crlf.json": indented.replace("\n", "\r\n"),
        "hole.json": json.dumps([{}, *two, {}], indent=2),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content.encode())
    rows = A.read_article_arrays(spark, str(tmp_path))
    paths = [str(tmp_path / name) for name in files]
    whole = A.read_articles_of(spark, str(tmp_path), paths, "*.json", True)
    assert rows.columns == whole.columns
    assert by_file(rows) == by_file(whole)


def test_repeated_ids_in_a_file_stay_apart(spark, tmp_path):
    source = tmp_path / "in"
    write_lines(source, "a.bz2", [json.dumps(GOOD)] * 3)
    rows = A.usable(saved(spark, A.read_article_lines(spark, str(source)), tmp_path))
    assert flatten_articles(rows).select("doc_key").distinct().count() == 6


def test_missing_folder_is_an_error(spark, tmp_path):
    for read in (A.read_article_lines, A.read_article_arrays, A.stream_articles):
        with pytest.raises(FileNotFoundError):
            read(spark, str(tmp_path / "nowhere"))


def test_new_files(spark, tmp_path):
    for name in ("a/x.bz2", "b/y.bz2"):
        write_lines(tmp_path, name, [json.dumps(GOOD)])
    files = A.list_files(spark, str(tmp_path), "*.bz2")
    ledger = spark.createDataFrame([("a/x.bz2",), ("a/x.bz2",)], "rel_path string")
    assert [r["rel_path"] for r in A.files_not_in(files, ledger).collect()] == ["b/y.bz2"]
