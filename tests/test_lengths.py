import random

import numpy as np
import pytest

from bitloom.operators import lengths


@pytest.fixture(scope="module")
def values():
    rng = random.Random(9)
    return [int(rng.lognormvariate(3, 0.8)) for _ in range(3000)]


@pytest.fixture(scope="module")
def table(spark, values):
    return spark.createDataFrame([("a", v) for v in values] + [("b", 5)] * 3 + [("c", None)], "g string, len int")


def test_length_stats(table, values):
    rows = {r.g: r for r in lengths.length_stats(table, "len", ["g"]).collect()}
    a = rows["a"]
    assert (a.n, a.min, a.max, a.median) == (len(values), min(values), max(values), np.median(values))
    assert a["mean"] == pytest.approx(np.mean(values))
    for name, p in lengths.PERCENTILES.items():
        assert a[name] == int(np.percentile(values, p * 100))
    assert rows["b"].p999 == 5 and "c" not in rows
    everything = lengths.length_stats(table, "len").first()
    assert everything.n == len(values) + 3
    near = {r.g: r for r in lengths.length_stats(table, "len", ["g"], exact=False).collect()}["a"]
    assert abs(near.p90 - a.p90) <= 1


def test_length_histogram_matches_numpy(table, values):
    rows = lengths.length_histogram(table, "len", 50, ["g"]).collect()
    for g, data in (("a", values), ("b", [5, 5, 5])):
        heights, edges = np.histogram(data, bins=50)
        found = sorted((r for r in rows if r.g == g), key=lambda r: r.bin)
        assert [r.n for r in found] == list(heights)
        assert [r.lo for r in found] == pytest.approx(edges[:-1])
        assert [r.hi for r in found] == pytest.approx(edges[1:])
    assert sum(r.n for r in lengths.length_histogram(table, "len", 10).collect()) == len(values) + 3


def test_length_kde(table, values):
    rows = lengths.length_kde(table.filter("g = 'a'"), "len", 40).orderBy("point").collect()
    data = np.array(values, float)
    width = len(data) ** -0.2 * data.std(ddof=1)
    x = np.linspace(data.min(), data.max(), 40)
    density = np.exp(-0.5 * ((x[:, None] - data) / width) ** 2).sum(1) / (len(data) * width * np.sqrt(2 * np.pi))
    assert [r.x for r in rows] == pytest.approx(x)
    assert [r.density for r in rows] == pytest.approx(density)


def test_suggest_max_len(spark, values):
    pairs = [(v, v // 2) for v in values]
    row = lengths.suggest_max_len(spark.createDataFrame(pairs, "s int, t int"), "s", "t").first()
    assert (row.suggested, row.global_max) == (int(np.percentile(values, 99.9)), max(values))


def test_filters(spark):
    rows = [("x", ["a"] * n, ["b"] * m) for n, m in ((126, 1), (127, 1), (1, 127), (0, 0))]
    pairs = spark.createDataFrame(rows, "split string, src_tokens array<string>, tgt_tokens array<string>")
    assert sorted(len(r.src_tokens) for r in lengths.filter_by_length(pairs, 128).collect()) == [0, 126]
    assert tuple(lengths.length_filter_report(pairs, 128).first()) == ("x", 2, 2)
    encoded = spark.createDataFrame([([1, 5, 6, 7, 2], [1, 2]), ([1, 5, 2], [1, 2])], "src_ids array<int>, tgt_ids array<int>")
    assert lengths.filter_bpe_length(encoded, 4, "filter").count() == 1
    assert sorted(r.src_ids for r in lengths.filter_bpe_length(encoded, 4).collect()) == [[1, 5, 2], [1, 5, 6, 2]]
    with pytest.raises(ValueError):
        lengths.filter_bpe_length(encoded, 4, "other")


def test_drop_blank_sources(spark):
    df = spark.createDataFrame([("a",), (" ",), ("",), (None,), ("　\n",), (" b",)], "src string")
    assert [r.src for r in lengths.drop_blank_sources(df).collect()] == ["a", " b"]


def test_kde_beyond_the_range_of_a_long(spark):
    rows = spark.createDataFrame([(50_000, 80_000_000), (49_999, 80_000_000)], "len int, n long")
    # 8 * 10**12 tokens; length_counts is replaced by the counts themselves
    ranged = lengths._with_range(rows, [])
    first = ranged.first()
    assert first["_sum"] == 7_999_920_000_000 and int(first["_square"]) == 80_000_000 * (50_000**2 + 49_999**2)
    few = spark.createDataFrame([(50_000,)] * 60_000 + [(70_000,)] * 60_000, "len int")
    points = lengths.length_kde(few, "len", 5).orderBy("point").collect()
    assert len(points) == 5 and all(p.density > 0 for p in points)
