import bz2
import json

import pytest

from passagedex import registry
from passagedex.operators.passages import flatten_articles
from passagedex.plans.lexical import build_index, open_index
from passagedex.streaming import ingest


def put(folder, name, articles):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [a if isinstance(a, str) else json.dumps(a) for a in articles]
    (folder / name).write_bytes(bz2.compress("\n".join(lines).encode()))


def article(number):
    return {"id": number, "title": f"Title {number}", "text": [[f"word{number}", "same"]]}


def test_folder_is_ingested_file_by_file_and_once(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "ix")
    put(source / "a", "1.bz2", [article(1), "broken", article(2)])
    put(source / "b", "2.bz2", [article(3)])
    index = ingest.ingest_folder(spark, str(source), path, max_files_per_batch=1)
    assert index.document_count() == 6
    assert sorted(r["n_passages"] for r in ingest.progress(index).collect()) == [2, 4]
    assert [r["rel_path"] for r in ingest.quarantine(index).collect()] == ["a/1.bz2"]

    again = ingest.ingest_folder(spark, str(source), path)
    assert again.document_count() == 6 and again.version == index.version

    extra = spark.createDataFrame([("x", "9", "Nine", [])],
                                  "rel_path string, id string, title string, text array<array<string>>")
    build_index(spark, flatten_articles(extra), path, "append")
    put(source / "b", "3.bz2", [article(4), article(4)])
    index = ingest.ingest_folder(spark, str(source), path)
    assert index.document_count() == 11
    assert {r["rel_path"] for r in ingest.processed_files(index).collect()} == {
        "a/1.bz2", "b/2.bz2", "b/3.bz2",
    }
    best = index.records(index.search_one("word3", 1)).first()
    assert (best["document"], best["metadata"]["id"]) == ("word3 same", "3")

    fresh = ingest.ingest_folder(spark, str(source), path, mode="rebuild")
    assert fresh.document_count() == 10
    assert open_index(spark, path).document_count() == 10


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ingest.ingest_folder(spark, str(tmp_path / "no"), str(tmp_path / "ix"))


def test_each_batch_can_be_published(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "ix")
    put(source, "1.bz2", ["broken", "also broken"])
    index = ingest.ingest_folder(spark, str(source), path)
    assert index.document_count() == 0 and index.version == 0
    assert index.search_one("title", 3).collect() == []
    assert ingest.quarantine(index).count() == 2
    for number in (1, 2, 3):
        put(source, f"{number + 1}.bz2", [article(number)])
    index = ingest.ingest_folder(
        spark, str(source), path, max_files_per_batch=1, publish_each_batch=True
    )
    assert index.version == 3 and index.document_count() == 6
    assert index.records(index.search_one("word2", 1)).first()["metadata"]["id"] == "2"
    assert index.statistics().first()["average_document_length"] == 2.0


def test_damaged_files_are_set_aside_and_end_nothing(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "ix")
    put(source / "a", "1.bz2", [article(1)])
    put(source / "a", "cut.bz2", [article(n) for n in range(100, 400)])
    whole = (source / "a" / "cut.bz2").read_bytes()
    (source / "a" / "cut.bz2").write_bytes(whole[: len(whole) // 2])
    (source / "a" / "junk [x].bz2").write_bytes(b"not compressed at all")
    put(source / "b", "none.bz2", [])
    (source / "b" / "two.bz2").write_bytes(
        b"".join(bz2.compress((json.dumps(article(n)) + "\n").encode()) for n in (2, 3))
    )
    index = ingest.ingest_folder(spark, str(source), path)
    assert index.document_count() == 6
    assert {r["rel_path"] for r in ingest.damaged(index).collect()} == {"a/cut.bz2", "a/junk [x].bz2"}
    assert ingest.taken_files(index).count() == 5
    assert "b/none.bz2" in {r["rel_path"] for r in ingest.processed_files(index).collect()}

    (source / "a" / "whole.bz2").write_bytes(whole)
    index = ingest.ingest_folder(spark, str(source), path)
    assert index.document_count() == 6 + 600
    assert ingest.taken_files(index).where("batch_id = 1").count() == 1
    assert ingest.ingest_folder(spark, str(source), path).version == index.version


def test_a_folder_of_damaged_files_gives_an_empty_index(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "ix")
    source.mkdir()
    (source / "1.bz2").write_bytes(b"BZh9 nothing")
    index = ingest.ingest_folder(spark, str(source), path)
    assert index.document_count() == 0 and ingest.damaged(index).count() == 1


def test_the_damaged_file_is_one_tasks_file(spark, tmp_path, monkeypatch):
    rows = [
        (i, f"title {i}\nwords of {i}. more", "fr" if i % 3 else "de", f"s{i % 2}", 20)
        for i in range(200)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    tasks = []
    write = registry._write_lines

    def noted(docs, folder):
        tasks.append(docs.rdd.getNumPartitions())
        write(docs, folder)

    monkeypatch.setattr(registry, "_write_lines", noted)
    found = registry.quarantine_damaged_files(spark, str(tmp_path)).collect()
    french = sum(row[2] == "fr" for row in rows)
    # A title and a paragraph each.
    assert sorted(map(tuple, found)) == [(0, 2 * (200 - french), 1), (1, 2 * french, 0)]
    assert min(tasks) > 1
