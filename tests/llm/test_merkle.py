"""The Merkle manifest against a tree built in memory."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  functions travel by value
from bitloom.llm import merkle, queries

SMALL = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place int, hash string, block long"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def lower(text):
    return None if text is None else "".join(c.lower() if c in UPPER else c for c in text)


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def siblings(tree, k):
    for nodes in tree[:-1]:
        start = k // 16 * 16
        run = nodes[start : start + 16]
        yield run[: k - start], run[k - start + 1 :]
        k //= 16


def brute(rows):
    """One tuple for each row, in the order of the trees."""
    trees = {}
    for row in rows:
        trees.setdefault(row["source"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row, row["text"]), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    top = levels([built[s][-1][0] for s in names])
    root = top[-1][0]
    for t, s in enumerate(names):
        for k, (_, _, own, row) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            touched = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
            node = leaf(row, lower(row["text"])) if touched else own
            proof, made = "", [node]
            for before, after in [*siblings(built[s], k), *siblings(top, t)]:
                proof += "".join(before + after)
                node = h(*before, node, *after)
                made.append(node)
            yield row["doc_id"], own, built[s][-1][0], root, h(proof), node, node == root, made if touched else []


def run(df):
    found = merkle.manifest(df, FIELDS, "doc_id", "source", {"text": F.translate("text", UPPER, UPPER.lower())}, queries.remainder(5) == 0)
    return found, [(r.id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified, r.copied) for r in found.collect()]


@pytest.mark.parametrize("height", [3, 1])
def test_manifest_equals_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 16**height)
    rng = random.Random(4)
    rows = []
    for i in range(420):
        source = "hot" if i % 2 else rng.choice([None, "", "b", "ß", "a", *[f"s{k}" for k in range(20)]])
        text = rng.choice([None, "", "lower only", f"Mixed Case {i}", "É Ü only", "A" * 30_000 if i == 7 else "B c"])
        rows.append({"doc_id": i * 3, "text": text, "lang": rng.choice([None, "en"]), "source": source, "n_chars": None if i % 9 == 0 else i})
    rows += [rows[5], rows[5], {**rows[6], "text": "another"}, {**rows[6], "doc_id": None}, {**rows[8], "doc_id": None, "source": None}]
    rows.append({"doc_id": 1 << 60, "text": "Alone", "lang": "de", "source": "single", "n_chars": 5})
    df = spark.createDataFrame([(*[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")], "x", 1, "y", 2) for r in rows], SCHEMA).repartition(3)
    found, got = run(df)
    expected = list(brute(rows))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert {x[6] for x in got} == {True, False}


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "Text", "en", "s", 4, "x", 1, "y", 2)], SCHEMA)
    _, got = run(one)
    row = {"doc_id": 5, "text": "Text", "lang": "en", "source": "s", "n_chars": 4}
    assert got == list(brute([row])) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == h("")
    assert run(one.limit(0))[1] == []


def test_without_changes(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = merkle.manifest(docs, ["text"], "doc_id", "lang")
    assert found.filter("not verified or size(copied) > 0").count() == 0 and found.count() == docs.count()


def test_query(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = queries.op11_merkle_manifest(spark, SMALL)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert {tuple(r) for r in found.collect()} == {x[:7] for x in brute(rows)}
