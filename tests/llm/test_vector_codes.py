"""Vector codes against brute force in Python integers."""

import hashlib
import math

import numpy as np
import pytest

import __spark_entry__  # noqa: F401  functions travel by value
from bitloom.llm import queries, vector_codes

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, dim string, codes string"


def _brute(rows, parts, entries, rounds, scale=256):
    """codes and errors by row, codebooks: rows are (id, vector) of one length."""
    cut = lambda v: [tuple(v[p * len(v) // parts : (p + 1) * len(v) // parts]) for p in range(parts)]
    whole = [(i, cut([max(-(1 << 24), min(1 << 24, math.floor(scale * x))) for x in v])) for i, v in rows]
    first = {}
    for i, v in whole:
        first[i] = min(first.get(i, v), v)
    ids = sorted((i for i in first if i is not None)) + [i for i in first if i is None]
    books = [[first[i][p] for i in ids[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda book, x: min(range(len(book)), key=lambda e: (gap(book[e], x), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for _, v in whole:
                mine[nearest(books[p], v[p])].append(v[p])
            books[p] = [tuple(sum(c) // len(m) for c in zip(*m, strict=True)) if m else old for m, old in zip(mine, books[p], strict=True)]
    codes = [[nearest(books[p], v[p]) for p in range(parts)] for _, v in whole]
    errors = [sum(gap(books[p][c], v[p]) for p, c in enumerate(code)) for code, (_, v) in zip(codes, whole, strict=True)]
    return codes, errors, books


def _usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block,group", [(64, 2_000_000), (4, 90)])
def test_codes_equal_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    monkeypatch.setattr(vector_codes, "GROUP", group)
    rng = np.random.default_rng(3)
    make = lambda n: [float(np.float32(x)) for x in rng.normal(size=n)]
    rows = [(int(i), make(8), int(i) % 3) for i in rng.permutation(150)]
    rows += [(1000 + i, rows[i][1], None) for i in range(20)] + [rows[4], rows[4], (rows[5][0], make(8), 1), (None, make(8), 0)]
    rows += [(2000 + i, [1.0] * 8, 2) for i in range(90)]
    rows += [(3000, None, 0), (3001, [], 0), (3002, [float("nan")] + [0.0] * 7, 0), (3003, [None] * 8, 0), (3004, [float("inf")] * 8, 1), (3005, make(7), 0)]
    rows += [(-5, [3e30] + [-3e30] * 7, 0)] + [(i, make(4), 1) for i in range(9)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    found = vector_codes.compress(df, parts=4, entries=16, rounds=2)
    got = vector_codes.with_label_error(found.rows).collect()
    expected, labels = [], {}
    for dim in (0, 4, 8):
        own = [r for r in rows if _usable(r[1]) and len(r[1]) == dim]
        codes, errors, books = _brute([r[:2] for r in own], 4, 16, 2)
        assert found.codebooks[dim].tolist() == [[list(e) for e in book] for book in books]
        expected += [(r[0], r[2], c, e) for r, c, e in zip(own, codes, errors, strict=True)]
    for _, label, _, error in expected:
        labels[label] = labels.get(label, 0) + error
    key = repr
    assert sorted(((r.id, r.label, r.codes, r.error) for r in got), key=key) == sorted(expected, key=key)
    assert all(r.label_error == labels[r.label] for r in got)
    back = vector_codes.restore(found.rows.filter("dim = 8"), found.codebooks).collect()
    for r in back:
        parts = [found.codebooks[8][p][c] for p, c in enumerate(r.codes)]
        assert r.vector == [x / 256 for part in parts for x in part]


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    found = vector_codes.compress(none)
    assert found.codebooks == {} and vector_codes.with_label_error(found.rows).count() == 0
    unusable = spark.createDataFrame([(1, None, None), (2, [None], "a")], none.schema)
    assert vector_codes.compress(unusable).rows.count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(a, b) for a in range(16) for b in range(16)])
    np.random.default_rng(1).shuffle(grid)
    scaled = grid * (1 << 20)
    walk = grid[vector_codes.hilbert_order(scaled)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
    for dims in (0, 1, 3, 70):
        points = np.random.default_rng(dims).integers(-99, 99, (50, dims))
        assert sorted(vector_codes.hilbert_order(points)) == list(range(50))


def test_shortlists_hold_the_nearest():
    rng = np.random.default_rng(8)
    for _ in range(30):
        points = rng.integers(-30, 30, (rng.integers(1, 300), 3)).astype(np.int32)
        book = rng.integers(-30, 30, (rng.integers(1, 20), 3))
        blocks = vector_codes.Blocks.of(points[vector_codes.hilbert_order(points)])
        entries, distances = vector_codes.assign(blocks, book)
        flat = blocks.points.reshape(-1, 3)[: len(points)]
        every = ((flat[:, None] - book) ** 2).sum(-1)
        assert (entries == every.argmin(1)).all() and (distances == every.min(1)).all()
        count, sums = vector_codes.totals(blocks, book)
        assert count.tolist() == np.bincount(entries, minlength=len(book)).tolist()
        assert sums.tolist() == [flat[entries == e].sum(0).tolist() for e in range(len(book))]


def test_query(spark):
    rows = [r for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect() if _usable(r.embedding)]
    codes, errors, books = _brute([(r.vec_id, r.embedding) for r in rows], 16, 64, 2)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    sums = {}
    for r, e in zip(rows, errors, strict=True):
        sums[r.label] = sums.get(r.label, 0) + e
    expected = {
        (r.vec_id, "".join(f"{c:02x}" for c in code), e, sums[r.label], digest)
        for r, code, e in zip(rows, codes, errors, strict=True)
    }
    found = queries.op13_vector_codes(spark, SMALL)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert {tuple(r) for r in found.collect()} == expected
