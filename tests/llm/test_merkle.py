"""The manifest against a plain tree, on small tables with nulls, ties and repeated rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from passagedex.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _key int, pos int"
NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(
        *["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[: len(NAMES)]]
    )


def plain_tree(hashes, fanout):
    """Root, and per leaf the (left, right) siblings of every level."""
    proofs = [[] for _ in hashes]
    owners = [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        parents, parent_owners = [], []
        for low in range(0, len(hashes), fanout):
            run = hashes[low : low + fanout]
            for k in range(len(run)):
                for i in owners[low + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(digest(*run))
            parent_owners.append([i for o in owners[low : low + fanout] for i in o])
        hashes, owners = parents, parent_owners
    return hashes[0], proofs


def plain_manifest(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made, subroots = [], []
    for name in names:
        leaves = sorted(
            ((r[0], plain_leaf(r)) for r in groups[name]),
            key=lambda x: (x[0] is not None, x[0] or 0, x[1]),
        )
        subroot, proofs = plain_tree([h for _, h in leaves], fanout)
        subroots.append(subroot)
        made.append([(i, h, subroot, p) for (i, h), p in zip(leaves, proofs, strict=True)])
    root, above = plain_tree(subroots, fanout)
    return [
        (i, h, subroot, root, p + upper)
        for group, upper in zip(made, above, strict=True)
        for i, h, subroot, p in group
    ]


def rows_of(n):
    langs = ["en", "en", "en", None, "de", "", "ä", "en"]
    rows = [
        (i // 2 * 2 if i % 9 == 0 else i, "s", langs[i % 8] if i < 40 else "en", i, f"té xt\n{i}", 1, 2)
        for i in range(n)
    ]
    rows += [(None, None, "en", None, None, None, None), (7, None, "en", None, "", 1, 1)]
    return rows + [rows[5]] * 3 + [(1, "s", "solo", 0, "x" * 30_000, 0, 0)]


def collected(df):
    return sorted(
        [
            (r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["proof"]])
            for r in df.collect()
        ],
        key=str,
    )


@pytest.mark.parametrize(("fanout", "chunk_rows"), [(2, 4), (2, 4096), (3, 10), (5, 5)])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, fanout, chunk_rows):
    monkeypatch.setattr(merkle, "CHUNK_ROWS", chunk_rows)
    rows = rows_of(150)
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), NAMES, fanout=fanout)
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof"]
    assert collected(made) == sorted(plain_manifest(rows, fanout), key=str)


def test_proofs_fold_to_the_root_and_only_for_the_right_leaf(spark):
    docs = spark.createDataFrame(rows_of(60), SCHEMA)
    wrong = merkle.leaf(F.lit("another"), F.col("text"))
    made = merkle.manifest(docs, NAMES, wrong=wrong).select(
        (merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("right"),
        (merkle.folded(F.col("wrong"), F.col("proof")) == F.col("root")).alias("wrong"),
    )
    assert {tuple(r) for r in made.collect()} == {(True, False)}


@pytest.mark.parametrize("lang", ["en", None])
def test_a_single_row_is_its_own_root(spark, lang):
    (row,) = merkle.manifest(
        spark.createDataFrame([(3, "a", lang, 1, "t", 1, 1)], SCHEMA), NAMES
    ).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == plain_leaf((3, "a", lang, 1, "t"))
    assert row["proof"] == []


def test_rows_alike_in_all_keys_and_an_empty_table(spark):
    rows = [(5, "a", "en", 1, "t", 1, 1)] * 37
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), NAMES)
    assert collected(made) == sorted(plain_manifest(rows, 2), key=str)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), NAMES).collect() == []


def test_fanout_below_two_is_an_error(spark):
    with pytest.raises(ValueError, match="fanout"):
        merkle.manifest(spark.createDataFrame([], SCHEMA), NAMES, fanout=1)
